"""Candidates from a search, each judged by a model: a plug-in that answers a
prompt. The parser of its answers and the routing of providers are here."""

from __future__ import annotations

import json
import re
import time
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from ..plans.storage import stash
from .linkage import Keys, merge_knn, resolve_keys

PROMPT = "Do the two records describe the same entity? Answer with JSON: is_match (true or false) and confidence (0 to 1)."
_YES = {"yes", "true", "1", "match"}
_NUMBER = re.compile(r"([01](?:\.\d+)?)")


def _confidence(value: object) -> float:
    try:
        found = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0
    return min(1.0, max(0.0, found)) if found == found else 0.0


def parse_verdict(answer: str | None) -> tuple[int, float]:
    """(match 0 or 1, confidence 0 to 1) of an answer: a JSON object, a JSON
    pair, or prose. An empty or unclear answer is (0, 0)."""
    text = (answer or "").strip()
    if not text:
        return 0, 0.0
    try:
        found = json.loads(text)
    except ValueError:
        low = text.lower()
        numbers = _NUMBER.findall(text)
        return int(any(w in low for w in ("yes", "true", "match"))), _confidence(numbers[-1]) if numbers else 0.0
    if isinstance(found, dict):
        match = next((found[k] for k in ("is_match", "match", "label") if k in found), 0)
        sure = next((found[k] for k in ("confidence", "score", "probability") if k in found), 0)
        if isinstance(match, bool):
            verdict = int(match)
        elif isinstance(match, int | float):
            verdict = int(match > 0)
        else:
            verdict = int(str(match).strip().lower() in _YES)
        return verdict, _confidence(sure)
    if isinstance(found, list) and len(found) >= 2:
        return int(_confidence(found[0]) > 0), _confidence(found[1])
    return 0, 0.0


def judged(df: DataFrame, answer: str) -> DataFrame:
    """``df`` with ``llm_is_match`` and ``llm_confidence`` of a column of answers."""

    @F.pandas_udf("llm_is_match int, llm_confidence double")
    def run(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_verdict(None if pd.isna(x) else x) for x in parts], columns=["llm_is_match", "llm_confidence"])

    return df.withColumn("__v", run(col(answer))).select(*[col(c) for c in df.columns], "__v.llm_is_match", "__v.llm_confidence")


@dataclass(frozen=True)
class Judge:
    """``ask`` answers a prompt and a payload, two records as JSON. A failure is
    tried again after 1, 2, 4, ... times ``pause`` seconds; with ``retries`` 0
    nothing is asked and the answer is empty. A task asks ``at_once`` times together."""

    ask: Callable[[str, str], str]
    prompt: str = PROMPT
    retries: int = 5
    pause: float = 15.0
    at_once: int = 4

    def answer(self, payload: str) -> str:
        for attempt in range(self.retries):
            try:
                return self.ask(self.prompt, payload)
            except Exception as problem:
                if attempt == self.retries - 1:
                    raise RuntimeError(f"the judge failed: {problem}. Use merge_knn for candidates without a judge") from problem
                time.sleep(self.pause * 2**attempt)
        return ""


def judge_provider(model: str | None, provider: str = "auto", keys: dict[str, str] | None = None) -> str:
    """The provider of a judge's model. It must be named and have a key."""
    if provider not in ("auto", "openai", "gemini"):
        raise ValueError(f"unknown provider {provider!r}")
    if not model:
        raise ValueError("a judge needs a model")
    found = provider if provider != "auto" else "gemini" if "gemini" in model.lower() else "openai"
    if not (keys or {}).get(found):
        raise ValueError(f"no key for {found}")
    return found


def merge_k_judge(left: DataFrame, right: DataFrame, judge: Judge, on: Keys = None, k: int = 3, left_on: Keys = None, right_on: Keys = None, suffixes: tuple[str, str] = ("_x", "_y"), confidence_threshold: float | None = None, **options) -> DataFrame:
    """The ``k`` nearest right rows of every left row with the judge's
    ``llm_is_match``, ``llm_confidence`` and ``llm_raw_response``. The answers are
    written once, so no later action asks again."""
    l, r = resolve_keys(left, right, on, left_on, right_on)
    found = merge_knn(left, right, on, k, left_on=left_on, right_on=right_on, suffixes=suffixes, **options)

    def side(columns: list[str], suffix: str) -> F.Column:
        named = [col(c + suffix if c + suffix in found.columns else c).alias(c) for c in columns]
        return F.struct(*named)

    asked = found.withColumn("__payload", F.to_json(F.struct(side(l, suffixes[0]).alias("left"), side(r, suffixes[1]).alias("right")), {"ignoreNullFields": "false"}))
    schema = T.StructType([*found.schema, T.StructField("llm_raw_response", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(judge.at_once) as pool:
            for part in parts:
                yield part.drop(columns="__payload").assign(llm_raw_response=list(pool.map(judge.answer, part["__payload"])))

    verdicts = judged(stash(asked.mapInPandas(run, schema), "verdicts"), "llm_raw_response")
    order = [*found.columns, "llm_is_match", "llm_confidence", "llm_raw_response"]
    verdicts = verdicts.select(*[col(c) for c in order])
    return verdicts if confidence_threshold is None else verdicts.where(F.col("llm_confidence") >= confidence_threshold)


def merge_knn_with_llm(left: DataFrame, right: DataFrame, judge: Judge, **options) -> DataFrame:
    """An older name of ``merge_k_judge``."""
    return merge_k_judge(left, right, judge, **options)


def merge_knn_openai(left: DataFrame, right: DataFrame, judge: Judge, **options) -> DataFrame:
    """An older name of ``merge_k_judge``."""
    warnings.warn("merge_k_judge is the name now", DeprecationWarning, stacklevel=2)
    return merge_k_judge(left, right, judge, **options)
