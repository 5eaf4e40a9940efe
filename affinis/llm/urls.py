"""URL filter: logistic regression on hashed character n-grams of host and path.

The small labelled table of ``url_table`` (or one that is given) trains the
model, on the driver. N-grams of host and path are hashed apart, so that a word
weighs in the place where it was seen. The weights (a quarter of a megabyte) are
broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import url_table
from .shared import col, fresh, map_arrow, mix, only, steps, utf8

BITS = 16
SIZES = (2, 3, 4, 5)


def parts(url: str) -> tuple[bytes, bytes]:
    """Host and path of a URL, lower case, without scheme, port, user, query and fragment."""
    rest = url.strip().lower()
    rest = rest.split("://", 1)[-1] if "://" in rest else rest.removeprefix("//")
    for stop in "#?":
        rest = rest.split(stop, 1)[0]
    host, _, path = rest.partition("/")
    host = host.rpartition("@")[2].split(":", 1)[0]
    return ("^" + host.removeprefix("www.") + "$").encode(), ("/" + path + "$").encode()


def features(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashed features, each once a row, of all n-grams."""
    rows, found = [], []
    for which in (0, 1):
        texts = [parts(u)[which] for u in urls]
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(at))
        for n in SIZES:
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, 1469598103934665603 + 131 * n + 7919 * which, np.uint64)
            for k in range(n):
                h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(1099511628211)
            inside = row[: len(h)] == row[n - 1 :]
            rows.append(row[: len(h)][inside])
            found.append((mix(h[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique((np.concatenate(rows) << BITS) | np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _scores(weights: np.ndarray, bias: float, urls: list[str]) -> np.ndarray:
    row, col = features(urls)
    n = np.maximum(np.bincount(row, minlength=len(urls)), 1)
    z = bias + np.bincount(row, weights[col].astype(np.float64), minlength=len(urls)) / np.sqrt(n)
    return 1 / (1 + np.exp(-z))


def gradient(weights: np.ndarray, bias: float, row: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray, decay: float) -> tuple[np.ndarray, float]:
    """Of the mean log-likelihood of labels ``y``, less half of ``decay`` times
    the squared weights: for the weights and the bias."""
    z = bias + np.bincount(row, weights[column] * scale, minlength=len(y))
    miss = y - 1 / (1 + np.exp(-z))
    return np.bincount(column, miss[row] * scale, minlength=len(weights)) / len(y) - decay * weights, float(miss.mean())


def train(table: list[tuple[str, int]], rounds: int = 300, rate: float = 160.0, decay: float = 5e-6) -> tuple[np.ndarray, float]:
    """Weights and bias, by gradient ascent on the whole table; deterministic.
    Without rows all are 0, so that every probability is a half."""
    urls, y = [u for u, _ in table], np.array([v for _, v in table], np.float64)
    row, column = features(urls)
    scale = (1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(urls)), 1)))[row]
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(rounds if len(y) else 0):
        step, shift = gradient(weights, bias, row, column, scale, y, decay)
        weights += rate * step
        bias += rate / 20 * shift
    return weights.astype(np.float32), float(bias)


def fit(labelled: DataFrame, url: str = "url", label: str = "unwanted", most: int = 20_000) -> tuple[np.ndarray, float]:
    """A model from a table of labelled URLs: at most ``most`` rows (a documented
    bound, by the order of a hash of the URL). A label above 0 is unwanted. Rows
    of null URL or label are left out."""
    known = labelled.select(col(url).alias("url"), (col(label) > 0).cast("int").alias("y")).where("url is not null and y is not null")
    return train([(r["url"], r["y"]) for r in known.orderBy(F.xxhash64("url"), "url", "y").limit(most).collect()])


@functools.lru_cache(1)
def _default_model() -> tuple[np.ndarray, float]:
    return train(url_table.rows())


def filter_urls(pages: DataFrame, url: str = "url", threshold: float = 0.6, model: tuple[np.ndarray, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (its columns ``keep``; None: all) with ``p_unwanted``, the
    model's probability to 6 decimals, and ``blocked``: whether it is at least
    ``threshold``. ``model`` None: that of the table in ``url_table``.

    A null URL has null in both and so is not blocked. An empty URL, or one
    without n-grams, has the probability of the bias alone. Rows are
    independent; repeated rows have equal results. An empty table gives an
    empty table. If a kept column has one of the new names, the new one gets an
    underscore before its name.
    """
    keep = pages.columns if keep is None else keep
    source = pages.select(*[col(c) for c in dict.fromkeys([*keep, url])])
    p_name, b_name = fresh(source, "p_unwanted", "blocked")
    kept = [f for f in source.schema if f.name in keep]
    schema = T.StructType([*kept, T.StructField(p_name, T.DoubleType()), T.StructField(b_name, T.BooleanType())])
    sent = pages.sparkSession.sparkContext.broadcast(model or _default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for whole in batches:
            for first, last in steps(utf8(only(whole, url))[1]):
                batch = whole.slice(first, last - first)
                known = np.asarray(only(batch, url).is_valid())
                p = np.round(_scores(weights, bias, [u or "" for u in only(batch, url).to_pylist()]), 6)
                yield pa.RecordBatch.from_arrays([*[only(batch, f.name) for f in kept], pa.array(p, mask=~known), pa.array(p >= threshold, mask=~known)], names=schema.names)

    return map_arrow(source, run, schema)
