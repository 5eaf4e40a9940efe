"""Row transformations and classification by functions on batches of texts."""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.text import SEPARATOR, serialize
from ..plans.storage import stash

BatchFunction = Callable[[list[str], dict], Sequence]


def apply_in_chunks(items: Sequence, fn: BatchFunction, fn_kwargs: dict | None = None, chunk_size: int = 50) -> list:
    """``fn`` over chunks, in order; it must give one result an item."""
    if chunk_size < 1:
        raise ValueError("a chunk has at least one item")
    out: list = []
    for first in range(0, len(items), chunk_size):
        chunk = list(items[first : first + chunk_size])
        found = list(fn(chunk, dict(fn_kwargs or {})))
        if len(found) != len(chunk):
            raise ValueError(f"{len(found)} results for {len(chunk)} items")
        out += found
    return out


def transform_column(df: DataFrame, column: str, transform_fn: BatchFunction, fn_kwargs: dict | None = None, chunk_size: int = 50, output_column: str | None = None) -> DataFrame:
    """``df`` with the function's results for a column's texts, by default as
    ``{column}_transformed``. Nulls are passed on as None."""
    if column not in df.columns:
        raise KeyError(column)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [None if pd.isna(t) else str(t) for t in part]
            found = apply_in_chunks(texts, transform_fn, fn_kwargs, chunk_size)
            yield pd.Series([None if x is None else str(x) for x in found], dtype=object)

    return df.withColumn(output_column or f"{column}_transformed", run(col(column).cast("string")))


def transform_rows(df: DataFrame, on: str | list[str], transform_fn: BatchFunction, fn_kwargs: dict | None = None, batch_size: int = 50, output_column: str | None = None, sep: str = SEPARATOR) -> DataFrame:
    """``df`` with ``transformed_{key}``. Rows with a null key are dropped; keys
    of several columns are serialised, so none of them is null."""
    keys = [on] if isinstance(on, str) else list(on)
    out = output_column or "transformed_" + "-".join(keys)
    if len(keys) == 1:
        return transform_column(df.dropna(subset=keys), keys[0], transform_fn, fn_kwargs, batch_size, out)
    return transform_column(df.withColumn("__key", serialize(keys, sep)), "__key", transform_fn, fn_kwargs, batch_size, out).drop("__key")


def classify_rows(df: DataFrame, on: str | list[str], classify: BatchFunction, num_labels: int = 2, label_map: dict[str, int] | None = None, batch_size: int = 128, sep: str = SEPARATOR) -> DataFrame:
    """``df`` with ``clf_preds_{keys}``, the label of each row.

    ``classify`` gives label numbers or names. With a ``label_map`` (name to
    number; its size is ``num_labels``) numbers become names. A row without an
    answer (None) has a null prediction; an answer that is no label raises.
    """
    if label_map is not None and len(label_map) != num_labels:
        raise ValueError(f"the label map has {len(label_map)} labels, not {num_labels}")
    keys = [on] if isinstance(on, str) else list(on)
    names = {v: k for k, v in (label_map or {}).items()}
    limit = num_labels

    def labels(texts: list[str], options: dict) -> list:
        out = []
        for x in classify(texts, options):
            if x is None or x in (label_map or {}):
                out.append(x)
            elif int(x) in range(limit):
                out.append(names.get(int(x), str(int(x))))
            else:
                raise ValueError(f"{x!r} is no label")
        return out

    return transform_column(df.withColumn("__key", serialize(keys, sep)), "__key", labels, None, batch_size, "clf_preds_" + "-".join(keys)).drop("__key")


def to_numbers(df: DataFrame, column: str, label_map: dict[str, int]) -> DataFrame:
    """The column's names as numbers if all of them are in the map; otherwise
    the names stay, all of them."""
    lookup = F.create_map(*[F.lit(x) for pair in label_map.items() for x in pair]) if label_map else None
    known = col(column).isin(list(label_map))
    strange = df.where(col(column).isNotNull() & ~known)
    if lookup is None or not strange.isEmpty():
        return df
    return df.withColumn(column, lookup[col(column)])


#: A client's answer to messages (role and content) under parameters.
Ask = Callable[[list[dict], dict], str]
#: An answer of one token, as likely as can be, if nothing else is said.
PARAMETERS = {"temperature": 0, "max_tokens": 1, "top_p": 0, "frequency_penalty": 0, "presence_penalty": 0}


def system_prompt(topic: str | None = None, prompt: str | None = None) -> str:
    """The prompt itself, or the question whether a text is about a topic."""
    if prompt is None and topic is None:
        raise ValueError("a topic or a prompt is needed")
    return prompt if prompt is not None else f"Is the text about {topic}? Answer Yes or No."


def messages(prompt: str, text: str) -> list[dict]:
    return [{"role": "system", "content": prompt}, {"role": "user", "content": text}]


def _patient(request: Callable[[], object], retries: int, pause: float):
    """The result of the first try that succeeds; after the last one its problem."""
    for attempt in range(retries):
        try:
            return request()
        except Exception:
            if attempt == retries - 1:
                raise
            time.sleep(pause * 2**attempt)
    raise ValueError("at least one try is needed")


def classify_by_requests(df: DataFrame, on: str | list[str], ask: Ask, topic: str | None = None, prompt: str | None = None, label_map: dict[str, int] | None = None, num_labels: int = 2, parameters: dict | None = None, retries: int = 5, pause: float = 15.0, at_once: int = 4) -> DataFrame:
    """``df`` with ``clf_preds_{keys}``, a client's answer for every row, and
    ``clf_error_{keys}``: why there is none.

    Each row is one request, tried ``retries`` times with pauses that double;
    one that fails to the end has a null prediction and the last problem's text,
    and the others go on. A task sends at most ``at_once`` requests together.
    The answers are written once, so no later action asks again. If all of them
    are names in ``label_map`` (Yes 1 and No 0, if none is given) they become
    its numbers; otherwise they stay as they are, all of them. Columns of a key
    are joined by a space; a null is an empty text.
    """
    said = system_prompt(topic, prompt)
    if label_map is None:
        label_map = {"Yes": 1, "No": 0}
        if prompt is not None:
            warnings.warn("a prompt of your own with the labels Yes and No", stacklevel=2)
    if len(label_map) != num_labels:
        raise ValueError(f"the label map has {len(label_map)} labels, not {num_labels}")
    keys = [on] if isinstance(on, str) else list(on)
    chosen = PARAMETERS | (parameters or {})
    name, error = (f"clf_{x}_" + "-".join(keys) for x in ("preds", "error"))

    @F.pandas_udf("answer string, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> tuple[str | None, str | None]:
            try:
                return str(_patient(lambda: ask(messages(said, text), chosen), retries, pause)), None
            except Exception as problem:
                return None, f"{type(problem).__name__}: {problem}"

        with ThreadPoolExecutor(at_once) as pool:
            for part in parts:
                yield pd.DataFrame(list(pool.map(one, part)), columns=["answer", "error"])

    answered = df.withColumn("__a", run(serialize(keys, " ")))
    kept = [col(c) for c in df.columns if c not in (name, error)]
    written = stash(answered.select(*kept, F.col("__a.answer").alias(name), F.col("__a.error").alias(error)), "answers")
    return to_numbers(written, name, label_map)


def array_transform(ask: Ask, prompt: str, parameters: dict | None = None, retries: int = 5, pause: float = 15.0) -> BatchFunction:
    """For ``transform_rows`` and ``transform_column``: a chunk of texts goes to a
    client as one JSON array and comes back as one of the same length. Another
    answer, or a failure, is tried again; the last one's problem is raised."""
    said = f"{prompt}\n\nThe texts are a JSON array. Answer with a JSON array of as many strings, in the same order, and nothing else."

    def request(texts: list[str]) -> list[str]:
        found = json.loads(ask(messages(said, json.dumps(texts)), parameters or {}))
        if not isinstance(found, list) or len(found) != len(texts):
            raise ValueError(f"no array of {len(texts)} results")
        return found

    return lambda texts, options: _patient(lambda: request(texts), retries, pause)


def label_of_scores(df: DataFrame, scores: str, label_map: dict[str, int] | None = None, out: str = "prediction") -> DataFrame:
    """``df`` with the label of the greatest of an array of scores (the first of
    equals): its number, or its name if there is a map. Null without scores."""
    best = F.array_position(col(scores), F.array_max(col(scores))) - 1
    if label_map is None:
        return df.withColumn(out, F.when(F.size(col(scores)) > 0, best))
    names = F.create_map(*[F.lit(x) for name, n in label_map.items() for x in (n, name)])
    return df.withColumn(out, F.when(F.size(col(scores)) > 0, names[best.cast("int")]))
