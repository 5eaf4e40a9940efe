"""Near-duplicate removal with SetSketch registers.

A document is the set of its shingles (runs of three words). Each of M
registers holds the least of the shingles' exponentially distributed hash
values, on an exponential scale with base B, truncated to 16 bits; the union of
two sets has the maxima of their registers. Registers are locality-sensitive:
two sets agree in one with a probability close to their Jaccard similarity.

1. Sketch every document. Documents of the same words in the same order have
   one key and are one content from here on.
2. Band the registers; contents that agree in a band share a bucket.
3. Inside a bucket, estimate similarities by maximum likelihood from the counts
   of greater, smaller and equal registers. A bucket passes on only as many
   links as keep its connected contents connected.
4. Bring together the texts of connected contents and compare exact shingle
   sets where the estimate allows it; the groups are the connected components
   under the exact similarity.
5. The document with the least id of each group stays.

A task compares all contents of a bucket or of a component only up to LIMIT of
them. In a larger one every content is compared with the least one first, which
settles a group of copies of one text; those that are not similar to it are then
compared with all, in blocks of which a task holds two. The links are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from .shared import col, fresh, grouped, lean, mix, only, stash, steps, utf8, words

M, ROWS = 160, 4
BASE, RATE, TOP = 1.001, 20.0, 65535
SHINGLE = 3
_A = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_W = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
#: Rows of a table that may be broadcast; larger ones are joined by a shuffle.
SMALL = 400_000
#: Contents of a bucket or component that one task compares, the bytes of their
#: texts, and the same for a block of a larger one.
LIMIT, LIMIT_BYTES = 2048, 64 << 20
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: One content of so many is counted to find the large buckets.
SAMPLED = 16


def shingles(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and their offsets. A text of fewer
    words than a shingle has is one shingle; one without words has none."""
    sizes = np.diff(at)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1] - at[:-1], counts)
    limit = np.repeat(at[1:], counts)
    out = np.zeros(len(place), np.uint64)
    for k in range(SHINGLE):
        inside = place + k < limit
        out[inside] += hashes[place[inside] + k] * _W[k]
    return mix(out), ends


def sketch(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers [texts, M] as uint16; a text without shingles has zeros."""
    out = np.zeros((len(at) - 1, M), np.uint16)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    starts = at[:-1][some]
    least = np.empty((M, len(some)), np.uint64)
    buffer = np.empty_like(grams)
    for i in range(M):
        np.multiply(grams, _A[i], out=buffer)
        np.bitwise_xor(buffer, _B[i], out=buffer)
        least[i] = np.minimum.reduceat(buffer, starts)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
    out[some] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def cardinality(registers: np.ndarray) -> np.ndarray:
    return M * (1 - 1 / BASE) / (RATE * np.log(BASE) * (BASE ** -registers.astype(np.float64)).sum(-1))


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows, from the
    numbers of registers in which the first is greater, less, or equal."""
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    same = M - more - less
    n, k = cardinality(a), cardinality(b)
    u, v = n / (n + k), k / (n + k)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _p(u - v * j), _p(v - u * j)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(16):
        c, d = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(c) > likelihood(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return np.where(same == M, 1.0, (low + high) / 2)


def _sketches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    id, text_hash, text, key, registers, size = names
    for whole in batches:
        for first, last in steps(utf8(only(whole, text))[1], 1 << 19):
            batch = whole.slice(first, last - first)
            hashes, at = words(*utf8(only(batch, text)))
            found = sketch(*shingles(hashes, at))
            known = np.diff(at) > 0
            keys = np.zeros((len(known), 2), np.uint64)
            place = (np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
            for k in range(2):
                if len(hashes):
                    salted = mix(hashes ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (2**64 - 1))) * (mix(place * np.uint64(2) + np.uint64(k)) | np.uint64(1))
                    keys[known, k] = np.add.reduceat(salted, at[:-1][known])
            mask = pa.array(~known)
            key_column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(known), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            sig_column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * M), len(known), [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
            empty = pa.scalar(None, pa.binary())
            yield pa.RecordBatch.from_arrays([only(batch, id), only(batch, text_hash), pa.compute.if_else(mask, empty, key_column), pa.compute.if_else(mask, empty, sig_column), pa.array(np.diff(utf8(only(batch, text))[1]))], names=[id, text_hash, key, registers, size])


def _span(n: int, similar) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``n`` things, where
    ``similar(i, rest)`` says which of the rest are linked to i. Every pair of
    things in different components is compared."""
    rest, links = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = similar(i, rest)
            links += [(i, int(j)) for j in rest[hit]]
            queue += [int(j) for j in rest[hit]]
            rest = rest[~hit]
    return links


def _fixed(column: pa.Array | pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    return np.frombuffer(utf8(column)[0].tobytes(), dtype).reshape(-1, width)


def _bucket_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    for table in grouped(batches, "bucket"):
        bucket = table.column("bucket").to_numpy()
        keys = table.column("key").combine_chunks()
        sig = _fixed(table.column("sig"), np.uint16, M)
        new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(bucket)))
        head = np.repeat(starts, sizes)
        close = np.zeros(len(bucket), bool)
        for a in range(0, len(bucket), 4096):
            part = slice(a, a + 4096)
            close[part] = similarity(sig[head[part]], sig[part]) >= least
        left, right = [head[close & ~new]], [np.flatnonzero(close & ~new)]
        missed = np.add.reduceat((~close & ~new).astype(np.int64), starts)
        for s, n in zip(starts[missed > 0], sizes[missed > 0]):
            mine = sig[s : s + n]
            for i, j in _span(n, lambda i, rest: np.concatenate([similarity(np.broadcast_to(mine[i], (len(r), M)), mine[r]) for r in np.array_split(rest, 1 + len(rest) // 4096)]) >= least):
                left.append([s + i])
                right.append([s + j])
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(x), pa.int64())) for x in (left, right)], schema=schema)


def _estimated(one: np.ndarray, many: np.ndarray, least: float) -> np.ndarray:
    """Whether the likeliest similarity of one register row with each of many is ``least``."""
    return np.concatenate([similarity(np.broadcast_to(one, (len(x), M)), x) for x in np.array_split(many, 1 + len(many) // 4096)]) >= least


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """The exact similarity of two sets of shingles."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both >= threshold * (len(a) + len(b) - both)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    out = []
    for first, last in steps(utf8(texts)[1]):
        grams, at = shingles(*words(*utf8(texts.slice(first, last - first))))
        out += [np.unique(grams[a:b]) for a, b in zip(at, at[1:])]
    return out


def _exact_groups(batches: Iterator[pa.RecordBatch], threshold: float, least: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("group", pa.binary())])
    for table in grouped(batches, "component", 1):
        component = [x.as_py() for x in table.column("component").combine_chunks()]
        keys = table.column("key").to_pylist()
        edges = [0, *[i for i in range(1, len(keys)) if component[i] != component[i - 1]], len(keys)]
        texts, sig = table.column("text").combine_chunks(), _fixed(table.column("sig"), np.uint16, M)
        for first, last in zip(edges, edges[1:]):
            rows = [i for i in range(first, last) if i == first or keys[i] != keys[i - 1]]
            own, mine = _sets(texts.take(pa.array(rows))), sig[rows]
            sizes = np.array([len(x) for x in own])

            def similar(i: int, rest: np.ndarray) -> np.ndarray:
                out = np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i])
                out[out] = _estimated(mine[i], mine[rest[out]], least)
                for j in np.flatnonzero(out):
                    out[j] = _alike(own[i], own[rest[j]], threshold)
                return out

            label = np.arange(len(rows))
            for i, j in _span(len(rows), similar):
                label[j] = label[i]  # links come from their component's first on
            yield pa.RecordBatch.from_arrays([pa.array([keys[r] for r in rows], pa.binary()), pa.array([keys[rows[k]] for k in label], pa.binary())], schema=schema)


def _near_centre(batches: Iterator[pa.RecordBatch], threshold: float | None, least: float) -> Iterator[pa.RecordBatch]:
    """For rows of two contents whether they are similar: by the estimate, and
    with a threshold by their texts too."""
    known: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        near = similarity(_fixed(only(batch, "centre_sig"), np.uint16, M), _fixed(only(batch, "sig"), np.uint16, M)) >= least if batch.num_rows else np.zeros(0, bool)
        centre = only(batch, "centre").to_pylist()
        hits = np.flatnonzero(near) if threshold else np.zeros(0, np.int64)
        for i, own in zip(hits.tolist(), _sets(only(batch, "text").take(pa.array(hits))) if len(hits) else ()):
            if centre[i] != known[0]:
                known = centre[i], _sets(only(batch, "centre_text").slice(i, 1))[0]
            near[i] = _alike(known[1], own, threshold)
        yield pa.RecordBatch.from_arrays([*[only(batch, c) for c in ("of", "centre", "key")], pa.array(near)], names=["of", "centre", "key", "near"])


def _cross(batches: Iterator[pa.RecordBatch], threshold: float | None, least: float) -> Iterator[pa.RecordBatch]:
    """Links that connect what is connected among the rows of a task, where a row
    that asks is compared with all."""
    for table in grouped(batches, "task", 1):
        task = table.column("task").to_numpy()
        for first, last in zip(*(lambda e: (e, np.append(e[1:], len(task))))(np.flatnonzero(np.diff(task, prepend=task[0] - 1)))):
            own = table.slice(first, last - first)
            key, asks, sig = own.column("key").to_pylist(), own.column("asks").to_numpy(zero_copy_only=False), _fixed(own.column("sig"), np.uint16, M)
            number: dict[bytes, int] = {}
            row = np.array([number.setdefault(k, len(number)) for k in key])
            label, sets, found = np.arange(len(number)), {}, []
            texts = own.column("text").combine_chunks() if threshold else None
            rest = np.flatnonzero(~asks)
            for i in np.flatnonzero(asks):
                for j in rest[_estimated(sig[i], sig[rest], least)] if len(rest) else ():
                    if label[row[i]] == label[row[j]]:
                        continue
                    if threshold:
                        for k in (i, j):
                            if row[k] not in sets:
                                sets[row[k]] = _sets(texts.slice(int(k), 1))[0]
                        if not _alike(sets[row[i]], sets[row[j]], threshold):
                            continue
                    label[label == label[row[j]]] = label[row[i]]
                    found.append((key[i], key[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in found], pa.binary()) for s in (0, 1)], names=["a", "b"])


def _if_small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _large_links(rows: DataFrame, contents: DataFrame, threshold: float | None, least: float) -> DataFrame:
    """Links ``a``, ``b`` among the contents of large sets (``rows``: of, key) that
    connect what is connected. ``contents`` has the registers of a key, and its
    text if there is a threshold for the exact similarity."""
    more = ["sig", "text"] if threshold else ["sig"]
    size = F.sum("size") if threshold else F.lit(0)
    sized = rows.join(contents.select("key", "size"), "key") if threshold else rows
    sets = stash(sized.groupBy("of").agg(F.min("key").alias("centre"), F.count("*").alias("n"), size.alias("bytes")), "large")
    tagged = rows.join(_if_small(sets), "of")
    centres = contents.join(_if_small(stash(sets.select(F.col("centre").alias("key")).distinct(), "centres")), "key").select(F.col("key").alias("centre"), *[F.col(c).alias(f"centre_{c}") for c in more])
    # a content in many large buckets is compared once with a centre that they share
    pairs = tagged.groupBy("centre", "key").agg(F.min("of").alias("of")).join(contents.select("key", *more), "key").join(centres, "centre")
    stars = stash(pairs.mapInArrow(lean(lambda b: _near_centre(b, threshold, least)), T.StructType([rows.schema["of"], T.StructField("centre", T.BinaryType()), T.StructField("key", T.BinaryType()), T.StructField("near", T.BooleanType())])), "stars")
    links = stars.where("near and centre <> key").select(F.col("centre").alias("a"), F.col("key").alias("b"))
    apart = stash(tagged.join(stars.where("not near").select("centre", "key"), ["centre", "key"]).select("of", "key", "n", "bytes"), "apart")
    asking = stash(apart.groupBy("of").agg(F.count("*").alias("asking")), "asking")
    if asking.isEmpty():
        return links

    def blocks(n: str) -> F.Column:
        return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col("bytes") / F.col("n") * F.col(n) / BLOCK_BYTES), F.lit(1)).cast("int")

    def own(count: F.Column) -> F.Column:
        return F.pmod(F.hash(F.lit("block"), "key"), count)

    def every(count: F.Column) -> F.Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    few = _if_small(asking)
    first = apart.join(few, "of").select("of", "key", F.lit(True).alias("asks"), own(blocks("asking")).alias("x"), every(blocks("n")).alias("y"))
    second = tagged.join(few, "of").select("of", "key", F.lit(False).alias("asks"), own(blocks("n")).alias("y"), every(blocks("asking")).alias("x")).select(*first.columns)
    both = first.union(second).join(contents.select("key", *more), "key").withColumn("task", F.xxhash64("of", "x", "y")).select("task", "asks", "key", *more)
    crossed = both.repartition("task").sortWithinPartitions("task", "asks", "key").mapInArrow(lean(lambda b: _cross(b, threshold, least)), "a binary, b binary")
    return links.union(crossed)


def near_groups(docs: DataFrame, threshold: float = 0.5, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, ``text_hash``, ``group`` (a binary key) for every document with words.

    A group is a connected component of documents under Jaccard similarity of
    at least ``threshold`` between their sets of three-word shingles (words are
    runs of letters and digits, in lower case within ASCII). Rows of null text,
    or of a text without words, are in no group. Rows with the same id and text
    are one document. An empty table gives an empty table.
    """
    named = docs.select(col(id).alias("id"), F.xxhash64(col(text)).alias("text_hash"), col(text).alias("text"))
    names = ["id", "text_hash", "text", "key", "sig", "size"]
    schema = T.StructType([named.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("size", T.LongType())])
    base = stash(named.where("text is not null").mapInArrow(lean(lambda b: _sketches(b, names)), schema).where("key is not null"), "sketches")
    contents = stash(base.groupBy("key").agg(F.min(F.struct("id", "text_hash")).alias("one"), F.first("sig").alias("sig"), F.max("size").alias("size")), "contents")
    least = threshold - 3 * (threshold * (1 - threshold) / M) ** 0.5

    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(M // ROWS)])
    members = contents.select("key", F.explode(bands).alias("of"))
    some = contents.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(SAMPLED)) == 0).select(F.explode(bands).alias("of"))
    large = stash(some.groupBy("of").count().where(F.col("count") * SAMPLED * 2 > LIMIT).select("of"), "large")
    links = None
    if not large.isEmpty():
        side = _if_small(large)
        links = _large_links(stash(members.join(side, "of"), "members").select("of", "key"), contents, None, least)
        members = members.join(side, "of", "left_anti")
    buckets = members.groupBy("of").agg(F.sort_array(F.collect_set("key")).alias("keys")).where("size(keys) > 1").select("keys").distinct()
    few = buckets.select(F.xxhash64("keys").alias("bucket"), F.explode("keys").alias("key"))
    sorted_members = few.join(contents.select("key", "sig"), "key").repartition("bucket").sortWithinPartitions("bucket", "key")
    small_links = sorted_members.mapInArrow(lean(lambda b: _bucket_links(b, least)), "a binary, b binary")
    found = connected_components(small_links.union(links) if links else small_links, "a", "b").withColumnRenamed("node", "key")

    wanted = stash(found.join(contents, "key").select("key", "component", "sig", "size", F.col("one.id").alias("one_id"), F.col("one.text_hash").alias("one_hash")), "wanted")
    texts = named.join(_if_small(wanted.drop("sig")), (F.col("text_hash") == F.col("one_hash")) & F.col("id").eqNullSafe(F.col("one_id"))).select("component", "key", "size", "text")
    many = stash(wanted.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > LIMIT) | (F.col("bytes") > LIMIT_BYTES)).select("component"), "many")
    sigs = wanted.select("key", "sig")
    if many.isEmpty():
        exact = _in_one_task(texts.join(sigs, "key"), threshold, least)
    else:
        side = _if_small(many)
        own = stash(texts.join(side, "component").dropDuplicates(["key"]).join(sigs, "key"), "texts")
        verified = _large_links(own.select(F.col("component").alias("of"), "key"), own, threshold, least)
        joined = connected_components(verified, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("group"))
        exact = _in_one_task(texts.join(side, "component", "left_anti").join(sigs, "key"), threshold, least).union(joined)
    return base.select("id", "text_hash", "key").join(exact, "key", "left").select("id", "text_hash", F.coalesce("group", "key").alias("group"))


def _in_one_task(texts: DataFrame, threshold: float, least: float) -> DataFrame:
    """``key``, ``group`` of components that a task may hold."""
    return texts.repartition("component").sortWithinPartitions("component", "key").mapInArrow(lean(lambda b: _exact_groups(b, threshold, least)), "key binary, group binary")


def near_dedup(docs: DataFrame, threshold: float = 0.5, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of ``near_groups``, all columns.

    The document with the least id stays; a null id is greater than any other,
    and of documents with the same id the one with the least hash of its text
    stays. Rows equal in id and text are one document and stay or go together.
    Documents in no group stay, among them those of null or wordless text.
    """
    groups = near_groups(docs, threshold, text, id)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    least = groups.groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("group", "first")
    hash_name, gone_id, gone_hash = fresh(docs, "text_hash", "gone_id", "gone_hash")
    gone = stash(groups.join(least, "group").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash")))).select(F.col("id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct(), "gone")
    side = _if_small(gone)
    hashed = docs.withColumn(hash_name, F.xxhash64(col(text)))
    kept = hashed.join(side, (F.col(hash_name) == F.col(gone_hash)) & col(id).eqNullSafe(F.col(gone_id)), "left_anti")
    return kept.select(*[col(c) for c in docs.columns])
