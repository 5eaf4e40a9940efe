"""Approximate nearest neighbours by an adaptive scan of dimensions.

Vectors get unit length and a random rotation, after which the first d of D
dimensions estimate a whole distance. They are put into inverted lists around
centroids. A query probes the lists whose centroids are nearest. A list is
scanned in column blocks: after each block, a hypothesis test on the partial
distance abandons the candidates that will not come below the query's bound;
only survivors see the next block. The bound is the k-th least distance so far,
at first that to some seeds, vectors which every query is compared with and
which lie in no list.

Centroids have two levels, coarse cells and the lists of each cell, both fitted
to a bounded sample; every vector is put into a list, by two short comparisons.
How many lists to probe is calibrated: the true neighbours, among all rows, of
a sample of queries show how far down the order of lists they lie.

Lists are scanned in groups of neighbouring ones, and a list with very many
vectors in several; a task holds one group and a share of the queries that probe
it, so memory is bounded whatever the lists' sizes, and every row may be a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import col, fresh, grouped, only, stash, utf8

#: Columns of a block; the test runs after each.
BLOCK = 16
#: Vectors of a group of lists, and queries that a task matches with them.
GROUP_ROWS, TASK_QUERIES = 8192, 16384
#: The sample to which centroids are fitted has at most so many bytes of floats.
SAMPLE_BYTES = 32 << 20
#: Vectors of that sample with which every query is compared.
SEEDS = 512


def rotation(dimensions: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    return np.frombuffer(utf8(column)[0].tobytes(), np.float32).reshape(-1, dimensions)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, np.float32)
    width = 4 * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid next to each row, by squared distance."""
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(x[a : a + 4096] @ centroids.T - half).argmax(1) for a in range(0, len(x), 4096)]])


def _means(x: np.ndarray, centroids: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Lloyd's rounds from the given centroids; one without rows stays."""
    for _ in range(rounds):
        at = _nearest(x, centroids)
        order = np.argsort(at, kind="stable")
        some, first, count = np.unique(at[order], return_index=True, return_counts=True)
        centroids = centroids.copy()
        centroids[some] = np.add.reduceat(x[order], first) / count[:, None]
    return centroids


class Lists:
    """``coarse`` [cells, dimensions], ``fine`` [lists, dimensions], the lists of
    a cell one after the other from ``first``."""

    def __init__(self, sample: np.ndarray, count: int, dimensions: int) -> None:
        self.coarse = np.zeros((1, dimensions), np.float32)
        if len(sample):
            self.coarse = _means(sample, sample[: max(1, math.isqrt(count))])
        cell = _nearest(sample, self.coarse)
        fine = []
        for c in range(len(self.coarse)):
            own = sample[cell == c]
            share = min(len(own), max(1, round(count * len(own) / max(1, len(sample)))))
            fine.append(_means(own, own[:share]) if share else self.coarse[c : c + 1])
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in fine])])
        self.fine = np.concatenate(fine).astype(np.float32)
        self.half = (self.fine * self.fine).sum(1) / 2

    def place(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the next one of the next cell."""
        cell = _nearest(x, self.coarse)
        out = np.zeros(len(x), np.int64)
        order = np.argsort(cell, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(x) else ():
            a, b = self.first[cell[rows[0]]], self.first[cell[rows[0]] + 1]
            out[rows] = a + _nearest(x[rows], self.fine[a:b])
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.fine.T - self.half


def scan(queries: np.ndarray, candidates: np.ndarray, bound: np.ndarray, epsilon: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, squared distance) of the pairs that no test abandoned
    and that lie within ``bound``, each query's squared distance so far.

    While many pairs survive, a block is one matrix product; then the survivors
    go pair by pair.
    """
    n, dimensions = queries.shape
    limit = bound.astype(np.float32)[:, None]
    partial, pairs = np.zeros((n, len(candidates)), np.float32), None
    for low in range(0, dimensions, block):
        high = min(dimensions, low + block)
        q, c = queries[:, low:high], candidates[:, low:high]
        scale = high / dimensions * ((1 + epsilon / math.sqrt(high)) ** 2 if high < dimensions else 1 + 1e-5)
        if pairs is None:
            partial += (q * q).sum(1)[:, None]
            partial += (c * c).sum(1)
            partial -= 2 * (q @ c.T)
            alive = partial <= limit * scale
            if high == dimensions or np.count_nonzero(alive) < 0.05 * alive.size:
                pairs = np.nonzero(alive)
                distance = partial[pairs]
        else:
            gap = q[pairs[0]] - c[pairs[1]]
            distance = distance + np.einsum("ij,ij->i", gap, gap)
            alive = distance <= bound[pairs[0]] * scale
            pairs, distance = (pairs[0][alive], pairs[1][alive]), distance[alive]
    return pairs[0], pairs[1], np.maximum(distance, 0)


def _search(batches: Iterator[pa.RecordBatch], k: int, dimensions: int, lists: Lists, epsilon: float, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", id_type), ("neighbour", id_type), ("cosine", pa.float64())])
    for table in grouped(batches, "part", 1):
        part = table.column("part").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        for a, b in zip(edges, edges[1:]):
            own = table.slice(a, b - a)
            of = own.column("list").to_numpy()
            n = int((of >= 0).sum())  # candidates come first, by list
            x, ids = _matrix(own.column("v"), dimensions), own.column("id").combine_chunks()
            c, q, bars, bounds = x[:n], x[n:], own.column("bar").to_numpy()[n:], own.column("bound").to_numpy()[n:]
            if not n or not len(q):
                continue
            order = np.empty(len(ids), np.int64)
            order[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            same = pa.compute.rank(ids, tiebreaker="dense").to_numpy()
            best_d = np.full((len(q), k), np.inf)
            best_c = np.full((len(q), k), -1, np.int64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(of[:n])) + 1, [n]])
            for s, e in zip(starts, starts[1:]):
                asks = np.flatnonzero(q @ lists.fine[of[s]] - lists.half[of[s]] >= bars - 1e-6)
                for first in range(0, len(asks), 4096):
                    rows = asks[first : first + 4096]
                    i, j, d = scan(q[rows], c[s:e], np.minimum(best_d[rows, -1], bounds[rows]), epsilon)
                    i, j = rows[i], j + s
                    other = same[n + i] != same[j]
                    i, j, d = i[other], j[other], np.round(d[other].astype(np.float64), 6)
                    touched = np.unique(i)
                    at = np.repeat(touched, k)
                    i, j, d = np.concatenate([at, i]), np.concatenate([best_c[touched].ravel(), j]), np.concatenate([best_d[touched].ravel(), d])
                    sort = np.lexsort((np.where(j >= 0, order[j], len(order)), d, i))
                    i, j, d = i[sort], j[sort], d[sort]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    top = nth < k
                    best_d[i[top], nth[top]], best_c[i[top], nth[top]] = d[top], j[top]
            i, nth = np.nonzero(best_c >= 0)
            j = best_c[i, nth]
            cosine = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[i[a : a + 65536]].astype(np.float64), c[j[a : a + 65536]].astype(np.float64)) for a in range(0, len(i), 65536)]])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(n + i)), ids.take(pa.array(j)), pa.array(np.round(cosine, 6))], schema=schema)


def _prepared(vectors: DataFrame, id: str, vector: str, asks: Column | None) -> tuple[DataFrame, int]:
    asking = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    found = vectors.select(col(id).alias("id"), col(vector).cast("array<float>").alias("v"), asking.alias("asks")).where("id is not null and size(v) > 0")
    sizes = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dimensions = sizes[0]["n"] if sizes else 1
    one = found.where(F.size("v") == dimensions).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"), F.max("asks").alias("asks"))
    turn = rotation(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = only(batch, "v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            size = np.sqrt((x * x).sum(1))
            good = np.isfinite(size) & (size > 0)
            turned = (x[good] / size[good, None]).astype(np.float32) @ turn
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([only(kept, "id"), _binary(turned), only(kept, "asks")], names=["id", "v", "asks"])

    return stash(one.mapInArrow(run, T.StructType([found.schema["id"], T.StructField("v", T.BinaryType()), T.StructField("asks", T.BooleanType())])), "vectors"), dimensions


def _sample(base: DataFrame, n: int, dimensions: int) -> tuple[np.ndarray, list, np.ndarray]:
    """Vectors in the order of a hash of their ids, as many as SAMPLE_BYTES hold
    (or all): a share of the hash's range, so no task sorts or sends more; and
    of the first SEEDS ones the ids, in order, and the vectors."""
    most = max(1, SAMPLE_BYTES // (4 * dimensions))
    h = F.xxhash64(F.lit("sample"), F.col("id").cast("string"))
    steps = 1 << 40
    some = base if n <= most else base.where(F.pmod(h, F.lit(steps)) < int(steps * most / n))
    rows = sorted((r["h"], r["id"], bytes(r["v"])) for r in some.select(h.alias("h"), "id", "v").collect())
    seeds = sorted(rows[:SEEDS], key=lambda r: r[1])
    whole, part = (np.frombuffer(b"".join(v for _, _, v in x), np.float32).reshape(-1, dimensions) for x in (rows, seeds))
    return whole, [i for _, i, _ in seeds], part


def _calibrate(placed: DataFrame, lists: Lists, dimensions: int, k: int, recall: float, sample: int) -> tuple[int, np.ndarray]:
    """The number of lists that hold the share ``recall`` of the true neighbours,
    among all rows, of ``sample`` queries; and those queries."""
    asked = placed.where("asks").orderBy(F.xxhash64(F.lit("query"), F.col("id").cast("string"))).limit(sample).select("v").collect()
    q = np.frombuffer(b"".join(r["v"] for r in asked), np.float32).reshape(-1, dimensions)
    if not len(q):
        return 1, q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.full((len(q), k + 1), -9.0, np.float32), np.full((len(q), k + 1), -1)
        for batch in batches:
            near = np.hstack([best, q @ _matrix(only(batch, "v"), dimensions).T])
            of = np.hstack([where, np.broadcast_to(only(batch, "list").to_numpy(), (len(q), batch.num_rows))])
            top = np.argpartition(-near, k, axis=1)[:, : k + 1]
            best, where = np.take_along_axis(near, top, 1), np.take_along_axis(of, top, 1)
        i, j = np.nonzero(where >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[i, j].astype(np.float64)), pa.array(where[i, j])], names=["q", "near", "list"])

    found = placed.select("v", "list").mapInArrow(run, "q long, near double, list long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "list"))
    true = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).where("nth > 1").toPandas()  # the first is the query itself
    if not len(true):
        return len(lists.fine), q
    place = np.argsort(np.argsort(-lists.scores(q), axis=1), axis=1)[true["q"], true["list"]]
    return int(np.quantile(place, recall, method="higher")) + 1, q


def _groups(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each list, and in how many groups it is: short lists
    share one with their neighbours, a longer one than a group has some alone."""
    first, shares = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    group, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > GROUP_ROWS:
            group, held = group + 1, 0
        first[i], shares[i] = group, max(1, -(-n // GROUP_ROWS))
        group, held = group + shares[i] - 1, held + n if shares[i] == 1 else GROUP_ROWS
    return first, shares


def _hits(scores: np.ndarray, bar: np.ndarray, first: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) of the groups in which each row probes a list."""
    row, of = np.nonzero(scores >= bar[:, None] - 1e-6)
    many = shares[of]
    ends = np.cumsum(many)
    row, group = np.repeat(row, many), np.repeat(first[of], many) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
    groups = int((first + shares).max())
    both = np.unique(row * groups + group)
    return both // groups, both % groups


def _bars(scores: np.ndarray, probes: int) -> np.ndarray:
    """Each row's ``probes``-th best score."""
    return -np.partition(-scores, probes - 1, axis=1)[:, probes - 1]


def nearest(vectors: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", recall: float = 0.96, sample: int = 400, epsilon: float = 2.1, asks: Column | None = None) -> DataFrame:
    """``id``, ``neighbour``, ``cosine`` (to 6 decimals) and ``rank`` 1 to ``k``
    for the rows of ``vectors`` that meet the condition ``asks`` (None: every
    row), each against all other rows.

    ``recall`` is the share of true neighbours for which lists are probed, by a
    calibration with ``sample`` queries; ``epsilon`` is the caution of the tests.
    Centroids are fitted to a sample of at most SAMPLE_BYTES; every row is in a
    list. Ties (squared distances equal to 6 decimals) go to the lesser neighbour
    id. With fewer than k + 1 vectors there are fewer ranks. Rows of null id, of
    null, empty or zero vector, of a null or infinite component, or of another
    size than most, are left out. Of rows with one id the one with the least
    hash of its vector counts, and it asks if one of them does. An empty table,
    or one in which no row asks, gives an empty table. If ``id`` has one of the
    new names, the new one gets an underscore before its name.
    """
    base, dimensions = _prepared(vectors, id, vector, asks)
    n, n_asks = base.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).collect()[0]
    drawn, seed_ids, seeds = _sample(base, n, dimensions)
    lists = Lists(drawn, max(1, math.isqrt(n)), dimensions)
    id_field = base.schema["id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.place(_matrix(only(batch, "v"), dimensions)))], names=["id", "v", "asks", "list"])

    placed = stash(base.mapInArrow(place, T.StructType([*base.schema, T.StructField("list", T.LongType())])), "placed")
    probes, tried = _calibrate(placed, lists, dimensions, k, recall, sample)
    sizes = np.zeros(len(lists.fine), np.int64)
    for r in placed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    first, shares = _groups(sizes)
    # how many queries will come to each group, by those of the calibration
    expected = np.bincount(_hits(lists.scores(tried), _bars(lists.scores(tried), probes), first, shares)[1], minlength=int((first + shares).max())) if len(tried) else np.zeros(int((first + shares).max()))
    salts = np.maximum(1, np.ceil((expected + 1) / max(1, len(tried)) * n_asks / TASK_QUERIES)).astype(np.int64)
    base_part = np.cumsum(salts) - salts
    schema = T.StructType([T.StructField("part", T.LongType()), id_field, placed.schema["v"], T.StructField("list", T.LongType()), T.StructField("bar", T.DoubleType()), T.StructField("bound", T.DoubleType())])
    id_type = to_arrow_type(id_field.dataType)
    sent = placed.sparkSession.sparkContext.broadcast((lists, first, shares, salts, base_part, seeds, pa.array(seed_ids, id_type)))  # grows with the root of the rows

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, first, shares, salts, base_part, near, _ = sent.value
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                x = _matrix(only(batch, "v"), dimensions)
                score = lists.scores(x)
                bar = _bars(score, probes)
                bound = np.full(len(x), 8.0)
                if len(near) > k:  # one of them may be the query itself
                    bound = np.minimum(bound, 2 - 2 * _bars(x @ near.T, k + 1).astype(np.float64) + 1e-5)
                row, group = _hits(score, bar, first, shares)
                part = base_part[group] + only(batch, "salt").to_numpy()[row] % salts[group]
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(part), only(batch, "id").take(taken), only(batch, "v").take(taken), pa.array(np.full(len(row), -1)), pa.array(bar[row].astype(np.float64)), pa.array(bound[row])], names=schema.names)

    salted = placed.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), F.col("id").cast("string")), F.lit(1 << 30)))
    queries = salted.where("asks").mapInArrow(ask, schema)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, shares, salts, base_part, _, seed_ids = sent.value
        for batch in batches:
            batch = batch.filter(pa.compute.invert(pa.compute.is_in(only(batch, "id"), seed_ids)))
            of, salt = only(batch, "list").to_numpy(), only(batch, "salt").to_numpy()
            group = first[of] + salt % shares[of]
            for low in range(int(salts[group].max()) if len(group) else 0):
                row = np.flatnonzero(salts[group] > low)
                some, none = batch.take(pa.array(row)), pa.nulls(len(row), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(base_part[group[row]] + low), only(some, "id"), only(some, "v"), only(some, "list"), none, none], names=schema.names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, seed_ids = sent.value[-2:]
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                x, ids = _matrix(only(batch, "v"), dimensions), only(batch, "id")
                own = pa.compute.index_in(ids, seed_ids).fill_null(-1).to_numpy(zero_copy_only=False)
                d = np.round(2 - 2 * (x @ near.T).astype(np.float64), 6)
                d[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
                j = np.argsort(d, axis=1, kind="stable")[:, :k]  # seeds are in the order of their ids
                i = np.repeat(np.arange(len(x)), j.shape[1])
                j = j.ravel()
                i, j = i[j != own[i]], j[j != own[i]]
                cosine = np.einsum("ij,ij->i", x[i].astype(np.float64), near[j].astype(np.float64))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), seed_ids.take(pa.array(j)), pa.array(np.round(cosine, 6))], names=found_schema.names)

    found_schema = T.StructType([id_field, T.StructField("neighbour", id_field.dataType), T.StructField("cosine", T.DoubleType())])
    both = salted.mapInArrow(offer, schema).union(queries).repartition("part").sortWithinPartitions(F.col("part"), F.col("list") < 0, F.col("list"))
    found = both.mapInArrow(lambda b: _search(b, k, dimensions, sent.value[0], epsilon, id_type), found_schema)
    found = found.union(placed.where("asks").select("id", "v").mapInArrow(compare, found_schema))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    new = fresh(vectors.select(col(id)), "neighbour", "cosine", "rank")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).toDF(id, *new)
