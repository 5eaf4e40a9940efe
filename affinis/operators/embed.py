"""What turns keys into vectors: precomputed columns, n-gram counts, functions.

A neural encoder is a plug-in: any function from a list of strings to an array
of numbers, run in batches by an Arrow UDF. The rules by which a model's name
and the keys at hand choose a provider are kept here too.
"""

from __future__ import annotations

import functools
import os
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import col


@dataclass(frozen=True)
class Precomputed:
    """The vector is in a column already."""

    column: str


@dataclass(frozen=True)
class Ngrams:
    """Counts of character n-grams: sparse, exact and inside the JVM."""

    n: int = 3


@dataclass(frozen=True)
class Encoder:
    """A function that encodes a batch of strings, such as a model's."""

    encode: Callable[[list[str]], np.ndarray]
    batch_size: int = 128

    def column(self, key: Column) -> Column:
        encode, size = self.encode, self.batch_size

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                rows: list[list[float]] = []
                for first in range(0, len(part), size):
                    texts = ["" if t is None else t for t in part.iloc[first : first + size]]
                    found = np.asarray(encode(texts), float)
                    if len(found) != len(texts):
                        raise ValueError("the encoder gave another number of vectors than of texts")
                    rows += found.tolist()
                yield pd.Series(rows)

        return run(key)


Embedder = Precomputed | Ngrams | Encoder


def embed(df: DataFrame, columns: list[str], encoder: Encoder, out: str = "embedding", sep: str = "</s>") -> DataFrame:
    """``df`` with the encoder's vectors; every distinct text is encoded once."""
    from ..functions.text import serialize

    keyed = df.withColumn("_key", serialize(columns, sep))
    vectors = keyed.select("_key").distinct().withColumn(out, encoder.column(F.col("_key")))
    return keyed.join(vectors, "_key").select(*[col(c) for c in df.columns], out)


def is_openai_embedding(model: str) -> bool:
    return "text-embedding" in model or "ada-002" in model


def is_gemini_embedding(model: str) -> bool:
    return any(x in model for x in ("gemini", "text-embedding-004", "embedding-001"))


def gemini_name(model: str) -> str:
    return model if model.startswith("models/") else f"models/{model}"


def gemini_key(gemini: str | None = None, openai: str | None = None) -> str:
    """The key given, else the environment's, else (as older callers do) the other provider's."""
    found = gemini or os.environ.get("GEMINI_API_KEY") or openai
    if not found:
        raise ValueError("a Gemini key is needed: pass it or set GEMINI_API_KEY")
    return found


def provider(model: str) -> str:
    """``gemini``, ``openai`` or ``local``; Gemini's names are looked at first."""
    return "gemini" if is_gemini_embedding(model) else "openai" if is_openai_embedding(model) else "local"


def retrieval(sbert: str | None = None, api: str | None = None, gemini: str | None = None, openai: str | None = None, default: str = "all-MiniLM-L6-v2") -> tuple[str, str]:
    """(mode, model) for the candidates of a judged merge: a local model, or an
    API's, never both. ``api="auto"`` takes Gemini if it has a key, else the
    other provider. With neither, ``default`` (the judge's own model) is taken,
    with a warning."""
    if sbert is not None and api is not None:
        raise ValueError("candidates come from a local model or from an API's, not from both")
    if sbert is not None:
        return "local", sbert
    if api == "auto":
        if gemini or os.environ.get("GEMINI_API_KEY"):
            return "gemini", "gemini-embedding-001"
        if openai or os.environ.get("OPENAI_API_KEY"):
            return "openai", "text-embedding-3-small"
        raise ValueError("no key that chooses a model for the candidates")
    if api is None:
        warnings.warn(f"no model is named for the candidates; {default} is taken", stacklevel=2)
        api = default
    return provider(api), api


def character_batches(texts: list[str], most: int = 5000) -> list[list[str]]:
    """Requests of bounded size: a batch ends before it would exceed ``most``
    characters; a longer text goes alone, and no batch is empty."""
    out: list[list[str]] = []
    size = most + 1
    for text in texts:
        if size + len(text) > most:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out


def remote_encoder(request: Callable[[list[str]], list[list[float]]], most_characters: int = 5000) -> Encoder:
    """An encoder over an API client, with requests bounded by characters."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([v for part in character_batches(texts, most_characters) for v in request(part)])

    return Encoder(encode)


@functools.lru_cache(4)
def _loaded(load: Callable, arguments: tuple):
    return load(*arguments)


def load_encoder(load: Callable[..., Callable[[list[str]], np.ndarray]], *arguments, batch_size: int = 128) -> Encoder:
    """An encoder whose model each worker loads once, when it first needs it:
    ``load(*arguments)`` gives the function that encodes. What ``load`` raises is
    raised by the query."""

    def encode(texts: list[str]) -> np.ndarray:
        return _loaded(load, arguments)(texts)

    return Encoder(encode, batch_size)


def onnx_model(folder: str) -> Callable[[list[str]], np.ndarray]:
    """For ``load_encoder``: the mean of the last hidden states, over a text's
    tokens, of ``model.onnx`` with ``tokenizer.json``, both in a folder that all
    workers see. A missing file raises FileNotFoundError."""
    for name in ("model.onnx", "tokenizer.json"):
        if not os.path.exists(os.path.join(folder, name)):
            raise FileNotFoundError(f"{folder} has no {name}")
    import onnxruntime
    from tokenizers import Tokenizer

    session = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"))
    tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
    tokenizer.enable_padding()
    wanted = {x.name for x in session.get_inputs()}

    def encode(texts: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch(texts)
        mask = np.array([x.attention_mask for x in found], np.int64)
        feed = {"input_ids": np.array([x.ids for x in found], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        hidden = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
        return (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)

    return encode


@functools.lru_cache(4)
def _tokenizer(path: str, length: int):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.enable_truncation(length)
    found.enable_padding(length=length)
    return found


def tokenize(df: DataFrame, column: str, tokenizer: str, length: int = 512) -> DataFrame:
    """``df`` with ``input_ids`` and ``attention_mask``, cut and filled up to
    ``length``, by a tokenizer file that all workers see. A null is an empty text."""

    @F.pandas_udf("input_ids array<int>, attention_mask array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = _tokenizer(tokenizer, length).encode_batch(["" if pd.isna(t) else t for t in part])
            yield pd.DataFrame({"input_ids": [x.ids for x in found], "attention_mask": [x.attention_mask for x in found]})

    kept = [c for c in df.columns if c not in ("input_ids", "attention_mask")]
    return df.withColumn("__t", run(col(column))).select(*[col(c) for c in kept], "__t.input_ids", "__t.attention_mask")
