"""Quality classifier: votes of the nearest labelled documents.

A document's terms are its words and the shapes of its white-space tokens (which
kinds of characters follow one another), hashed, and the degree to which it
repeats itself. A bounded sample of labelled
documents gives term weights and a truncated singular value decomposition; its
right vectors map any document to a latent-semantic vector. The labelled
vectors are broadcast, every document's cosines with all of them are computed
exactly, block by block, and the nearest vote with their similarities as weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, fresh, map_arrow, mix, only, steps, tokens, utf8, words

WORD_BITS, SHAPE_BITS = 15, 11
#: Eighths of a text's three-word runs that have stood in it before; each level has so many terms.
LEVELS, LEVEL_TERMS, LEVEL_COUNT = 8, 32, 8
FIRST_LEVEL = (1 << WORD_BITS) + (1 << SHAPE_BITS)
TERMS = FIRST_LEVEL + LEVELS * LEVEL_TERMS
DIMENSIONS = 48
#: White space 0; capitals, small letters (and all beyond ASCII), digits; other characters are their own kind.
_KINDS = np.array([0 if b in b" \t\r\n\v\f\0" else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b > 127 else 3 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all texts, sorted by row and term."""
    parts = []
    n = len(at) - 1
    for (hashes, ends), bits, base in ((words(data, at), WORD_BITS, 0), (tokens(data, at, _KINDS, True), SHAPE_BITS, 1 << WORD_BITS)):
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        parts.append(row * TERMS + base + (hashes >> np.uint64(64 - bits)).astype(np.int64))
        if not base:
            level = _repetition(hashes, row, n)
    for step in range(LEVELS):
        high = np.flatnonzero(level > step)
        ids = FIRST_LEVEL + step * LEVEL_TERMS + np.arange(LEVEL_TERMS)
        parts.append(np.repeat((high[:, None] * TERMS + ids).ravel(), LEVEL_COUNT))
    found, count = np.unique(np.concatenate(parts), return_counts=True)
    return found // TERMS, found % TERMS, count


def _repetition(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each text the eighths, rounded down, of its runs of three words that are repeats."""
    if len(hashes) < 3:
        return np.zeros(n, np.int64)
    inside = row[2:] == row[:-2]
    runs = mix(hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(7))[inside]
    row = row[2:][inside]
    # the row's number in the upper bits, so that one sort parts the texts
    keys = np.sort((row.astype(np.uint64) << np.uint64(44)) | (runs >> np.uint64(20)))
    again = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(44)).astype(np.int64), minlength=n)
    return LEVELS * again // (np.bincount(row, minlength=n) + 40)  # a short text that repeats a line is no junk


class Model:
    """``right`` [TERMS, dimensions]: term weights times right singular vectors;
    ``labelled`` [n, dimensions]: unit vectors; ``good``: their labels, 0 or 1."""

    def __init__(self, right: np.ndarray, labelled: np.ndarray, good: np.ndarray) -> None:
        self.right, self.labelled, self.good = right, labelled, good

    def vectors(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Unit vectors of n documents; zero for one that shares no term."""
        out = np.zeros((n, self.right.shape[1]), np.float32)
        weight = np.log1p(count).astype(np.float32)
        edges = np.searchsorted(row, np.arange(n + 1))
        for a, b in steps(edges, 1 << 16):
            part = slice(edges[a], edges[b])
            some = a + np.flatnonzero(np.diff(edges[a : b + 1]))
            if len(some):
                out[some] = np.add.reduceat(self.right[term[part]] * weight[part, None], edges[some] - edges[a])
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=out, where=size > 1e-9)

    def score(self, vectors: np.ndarray, neighbours: int) -> np.ndarray:
        """The share of the nearest neighbours' similarity that speaks for the
        document; nan without evidence. All that tie with the last one vote."""
        out = np.full(len(vectors), np.nan)
        if not len(self.good):
            return out
        k = min(neighbours, len(self.good))
        for a in range(0, len(vectors), 1024):
            near = vectors[a : a + 1024] @ self.labelled.T
            last = np.partition(near, -k, axis=1)[:, -k]
            near[near < np.maximum(last - 1e-6, 1e-6)[:, None]] = 0
            total = near.sum(1, dtype=np.float64)
            some = total > 0
            out[a : a + 1024][some] = (near @ self.good)[some] / total[some]
        return out


def train(documents: list[tuple[np.ndarray, np.ndarray]], good: list[int], dimensions: int = DIMENSIONS) -> Model:
    """From (terms, counts) and a label of each document. The decomposition goes
    by the documents' products with one another, in blocks of terms."""
    n = len(documents)
    if not n:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    row = np.repeat(np.arange(n), [len(t) for t, _ in documents])
    term = np.concatenate([t for t, _ in documents]).astype(np.int64)
    count = np.concatenate([c for _, c in documents])
    spread = np.log((1 + n) / (1 + np.bincount(term, minlength=TERMS))) + 1
    value = np.log1p(count) * spread[term]
    value /= np.sqrt(np.bincount(row, value * value, minlength=n))[row]
    order = np.argsort(term, kind="stable")
    row, term, value = row[order], term[order], value[order]

    used, column = np.unique(term, return_inverse=True)

    def blocks(width: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, len(used), width):
            part = slice(*np.searchsorted(column, [low, low + width]))
            block = np.zeros((n, min(width, len(used) - low)), np.float32)
            block[row[part], column[part] - low] = value[part]
            yield used[low : low + width], block

    products = np.zeros((n, n))
    for _, block in blocks():
        products += block @ block.T
    values, left = np.linalg.eigh(products)
    best = np.argsort(-values)[:dimensions]
    best = best[values[best] > 1e-9]
    scaled = (left[:, best] / np.sqrt(values[best])).astype(np.float32)
    right = np.zeros((TERMS, len(best)), np.float32)
    for ids, block in blocks():
        right[ids] = block.T @ scaled
    right *= spread[:, None].astype(np.float32)
    model = Model(right, np.zeros((0, len(best)), np.float32), np.array(good, np.float32))
    ends = np.cumsum([len(t) for t, _ in documents])
    model.labelled = model.vectors(np.repeat(np.arange(n), np.diff(np.append(0, ends))), np.concatenate([t for t, _ in documents]).astype(np.int64), count, n)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 600, text: str = "text", id: str = "doc_id", label: str = "quality") -> Model:
    """A model from labelled documents: at most ``per_class`` of each label (a
    documented bound, by the order of a hash of the id). A label above 0 is
    good. Rows of null id, label or text are left out; a document with several
    different labels counts with each. Without labels the model knows nothing.
    """
    known = labels.select(col(id).alias("id"), (col(label) > 0).cast("int").alias("good")).where("id is not null and good is not null")
    rank = F.row_number().over(Window.partitionBy("good").orderBy(F.xxhash64(F.col("id").cast("string")), "id"))
    chosen = known.withColumn("rank", rank).where(F.col("rank") <= per_class).select("id", "good").distinct()
    texts = docs.select(col(id).alias("id"), col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, term, count = terms(*utf8(only(batch, "text").slice(i, 1)))
                yield pa.RecordBatch.from_arrays([only(batch, "good").slice(i, 1), pa.array([term], pa.list_(pa.int32())), pa.array([count], pa.list_(pa.int32()))], names=["good", "term", "count"])

    found = texts.mapInArrow(run, "good int, term array<int>, count array<int>").toPandas()
    found = [(tuple(t), tuple(c), int(g)) for t, c, g in zip(found["term"], found["count"], found["good"]) if len(t)]
    found = sorted(set(found))  # the same whatever order the rows came in
    return train([(np.array(t), np.array(c)) for t, c, _ in found], [g for _, _, g in found])


def classify(docs: DataFrame, model: Model, neighbours: int = 15, threshold: float = 0.4, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``; None: all) with ``quality_score``, between
    0 and 1, to 6 decimals, and ``kept``: whether the score is at least
    ``threshold``.

    A document without evidence (null or empty text, no term in common with
    labelled ones, a model without labels) has score null and is kept. Labelled
    documents at the same distance as the last neighbour all vote. Whole texts
    count. How far a text repeats itself is the share of its runs of three words
    that have stood before, among all of them and 40 more, so that a short text
    which repeats a line is not taken for junk. Rows are independent; repeated rows have equal results; an empty
    table gives an empty table. If a kept column has one of the new names, the
    new one gets an underscore before its name.
    """
    keep = docs.columns if keep is None else keep
    source = docs.select(*[col(c) for c in dict.fromkeys([*keep, text])])
    s_name, k_name = fresh(source, "quality_score", "kept")
    kept = [f for f in source.schema if f.name in keep]
    schema = T.StructType([*kept, T.StructField(s_name, T.DoubleType()), T.StructField(k_name, T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in steps(utf8(only(whole, text))[1]):
                batch = whole.slice(first, last - first)
                m: Model = sent.value
                score = m.score(m.vectors(*terms(*utf8(only(batch, text))), batch.num_rows), neighbours)
                score = np.round(score, 6)
                none = np.isnan(score)
                yield pa.RecordBatch.from_arrays([*[only(batch, f.name) for f in kept], pa.array(score, mask=none), pa.array(none | (score >= threshold))], names=schema.names)

    return map_arrow(source, run, schema)
