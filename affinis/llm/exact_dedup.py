"""Exact deduplication by Grace hashing.

The shuffle on a content hash is the first level of partitioning. Each task
then fills an open-addressing table that compares complete contents. When the
table outgrows its memory, what it holds and the rest of the stream go to spill
files by further bits of the hash, and every file is treated in the same way,
until its bucket fits. Spill files lie in the folder that all executors share.

A pass of the same table runs before the shuffle and drops the copies that one
input split holds, so a content with very many copies does not send them all
to one task. That pass never spills: when full it empties itself downstream.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, file_system, fresh, map_arrow, only, shared_dir

#: Bits of the hash that one level of partitioning takes.
LEVEL_BITS = 3
#: Beyond this depth a bucket is one hash value and can't be split.
DEEPEST = 20


class ContentTable:
    """Open addressing with linear probing; an entry is one distinct content
    and the least row, by (id, tie), that has it."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.orders: list[tuple] = []
        self.places: list[tuple[int, int]] = []
        self.rests: list[pa.RecordBatch] = []
        self.live: list[int] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = (h ^ (h >> 29)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of this content, and whether it is new."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 29)) & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.orders.append(())
        self.places.append((-1, -1))
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return entry, True

    def add(self, batch: pa.RecordBatch, names: dict[str, str]) -> None:
        hashes = only(batch, names["hash"]).to_pylist()
        contents = only(batch, names["text"]).cast(pa.binary()).to_pylist()
        ids, ties = only(batch, names["id"]).to_pylist(), only(batch, names["tie"]).to_pylist()
        changed = {}
        for row, (h, content) in enumerate(zip(hashes, contents)):
            entry, new = self.find(h, content)
            order = (ids[row] is None, ids[row] if ids[row] is not None else 0, ties[row])
            if new or order < self.orders[entry]:
                self.orders[entry] = order
                changed[entry] = row
        if not changed:
            return
        rest = batch.select([n for n in batch.schema.names if n != names["text"]]).take(pa.array(list(changed.values())))
        for k, entry in enumerate(changed):
            if self.places[entry][0] >= 0:
                self.live[self.places[entry][0]] -= 1
            self.places[entry] = (len(self.rests), k)
        self.rests.append(rest)
        self.live.append(len(changed))
        self.bytes += rest.nbytes
        if sum(x.num_rows for x in self.rests) > 4 * len(self.hashes) + 10_000:
            self._compact()

    def _gather(self, entries: list[int]) -> pa.RecordBatch:
        starts, total = [], 0
        for x in self.rests:
            starts.append(total)
            total += x.num_rows
        joined = pa.Table.from_batches(self.rests).take(pa.array([starts[a] + b for a, b in (self.places[e] for e in entries)]))
        return joined.combine_chunks().to_batches()[0]

    def _compact(self) -> None:
        self.bytes -= sum(x.nbytes for x in self.rests)
        self.rests = [self._gather(list(range(len(self.hashes))))]
        self.places = [(0, e) for e in range(len(self.hashes))]
        self.live = [len(self.hashes)]
        self.bytes += self.rests[0].nbytes

    def rows(self, schema: pa.Schema, names: dict[str, str], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        """The kept rows with their contents, in batches of bounded size."""
        first, size = 0, 0
        for entry in range(len(self.hashes)):
            size += len(self.contents[entry])
            if size > most or entry == len(self.hashes) - 1 or entry - first >= 8192:
                entries = list(range(first, entry + 1))
                rest = self._gather(entries)
                text = pa.array(self.contents[first : entry + 1], pa.binary()).cast(schema.field(names["text"]).type)
                yield pa.RecordBatch.from_arrays([text if f.name == names["text"] else only(rest, f.name) for f in schema], schema=schema)
                first, size = entry + 1, 0


class Spill:
    """Files of one level of partitioning, in a folder of their own."""

    def __init__(self, root: str, schema: pa.Schema) -> None:
        self.fs, path = file_system(root)
        self.path = f"{path}/grace-{uuid.uuid4().hex}"
        self.fs.create_dir(self.path, recursive=True)
        self.schema, self.files, self.written = schema, {}, set()

    def write(self, batch: pa.RecordBatch, level: int, hash_name: str) -> None:
        h = only(batch, hash_name).to_numpy(zero_copy_only=False)
        bucket = (h >> (level * LEVEL_BITS)) & ((1 << LEVEL_BITS) - 1)
        for b in range(1 << LEVEL_BITS):
            part = batch.filter(pa.array(bucket == b))
            if part.num_rows:
                if b not in self.files:
                    stream = self.fs.open_output_stream(f"{self.path}/{b}")
                    self.files[b] = (pa.ipc.new_stream(stream, self.schema), stream)
                    self.written.add(b)
                self.files[b][0].write_batch(part)

    def close(self) -> None:
        for writer, stream in self.files.values():
            writer.close()
            stream.close()
        self.files = {}

    def read(self, bucket: int) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_stream(f"{self.path}/{bucket}") as stream:
            yield from pa.ipc.open_stream(stream)

    def remove(self) -> None:
        self.close()
        self.fs.delete_dir(self.path)


def _grace(batches: Iterator[pa.RecordBatch], level: int, names: dict[str, str], root: str, memory_bytes: int) -> Iterator[pa.RecordBatch]:
    kept, spill, schema = ContentTable(), None, None
    try:
        for batch in batches:
            schema = schema or batch.schema
            known = only(batch, names["text"]).is_valid()
            unknown = batch.filter(pa.compute.invert(known))
            if unknown.num_rows:
                yield unknown
            batch = batch.filter(known)
            if not batch.num_rows:
                continue
            if spill:
                spill.write(batch, level, names["hash"])
                continue
            kept.add(batch, names)
            if kept.bytes > memory_bytes and level < DEEPEST:
                spill = Spill(root, schema)
                for part in kept.rows(schema, names):
                    spill.write(part, level, names["hash"])
                kept.clear()
        if spill:
            spill.close()
            for bucket in sorted(spill.written):
                yield from _grace(spill.read(bucket), level + 1, names, root, memory_bytes)
        elif schema is not None:
            yield from kept.rows(schema, names)
    finally:
        if spill:
            spill.remove()


def _combine(batches: Iterator[pa.RecordBatch], names: dict[str, str], memory_bytes: int) -> Iterator[pa.RecordBatch]:
    kept, schema = ContentTable(), None
    for batch in batches:
        schema = schema or batch.schema
        known = only(batch, names["text"]).is_valid()
        unknown = batch.filter(pa.compute.invert(known))
        if unknown.num_rows:
            yield unknown
        if unknown.num_rows < batch.num_rows:
            kept.add(batch.filter(known), names)
        if kept.bytes > memory_bytes:
            yield from kept.rows(schema, names)
            kept.clear()
    if schema is not None:
        yield from kept.rows(schema, names)


def _unhashed(kind: T.DataType) -> bool:
    """Whether Spark has no hash for values of this type, at any depth."""
    if isinstance(kind, T.ArrayType):
        return _unhashed(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unhashed(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", memory_bytes: int = 48 << 20) -> DataFrame:
    """One row of ``docs`` for each distinct text, with all its columns.

    Of the rows with the same text, byte for byte, the one with the least id
    stays; a null id is greater than any other. Rows that share text and id
    are ordered by a hash of all their columns, and one of them stays, so
    repeated rows become one. An empty text is a text like any other. A null
    text is unknown and equals nothing: all its rows stay. An empty table
    gives an empty table. Other columns are carried along, whatever their
    names. ``memory_bytes`` is what a task's table may hold before it spills;
    it changes where the work is done, never the result.
    """
    hash_name, tie = fresh(docs, "content_hash", "row_tie")
    names = {"hash": hash_name, "tie": tie, "text": text, "id": id}
    every = F.xxhash64(*[col(f.name).cast("string") if _unhashed(f.dataType) else col(f.name) for f in docs.schema])
    keyed = docs.withColumn(tie, every).withColumn(hash_name, F.when(col(text).isNull(), col(tie)).otherwise(F.xxhash64(col(text))))
    root = shared_dir(docs.sparkSession)
    schema = keyed.schema
    few = map_arrow(keyed, lambda batches: _combine(batches, names, memory_bytes), schema)
    buckets = few.repartition(col(hash_name))
    return map_arrow(buckets, lambda batches: _grace(batches, 0, names, root, memory_bytes), schema).select(*[col(c) for c in docs.columns])


SQL = """
SELECT doc_id, text, lang, source, n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS nth FROM {documents})
WHERE nth = 1 OR text IS NULL
"""
