"""What the operators have in common: Arrow text buffers, names, tokens."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.names import col as col
from ..plans.storage import shared_dir as shared_dir
from ..plans.storage import stash as stash
from ..plans.storage import until_exit as until_exit

#: Bytes of text that one vectorised step works on; bounds a worker's memory.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def file_uri(path: str) -> str:
    """A path as the cluster's file systems name it, as Arrow's name it."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        return "s3:" + rest
    if colon and scheme == "dbfs":  # mounted on every machine
        return "file:///dbfs/" + rest.lstrip("/")
    return path


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path in it. A
    scheme that Arrow lacks is left to fsspec, if that is there."""
    uri = file_uri(path)
    try:
        return pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, ValueError):
        try:
            import fsspec
        except ModuleNotFoundError:
            raise ValueError(f"no file system for {path}") from None
        fs, where = fsspec.core.url_to_fs(path)
        return pafs.PyFileSystem(pafs.FSSpecHandler(fs)), where


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run) -> Run:
    """``run``, after which a worker, which lives on, gives back the memory that
    it no longer needs."""

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps what it keeps
            pass

    return then_release


def map_arrow(df: DataFrame, run: Run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow``, which by itself fails for column names with dots or
    backquotes; ``run`` sees and gives the names as they are."""
    run = lean(run)
    if not any(set(".`") & set(c) for c in [*df.columns, *schema.names]):
        return df.mapInArrow(run, schema)
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])

    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes; a longer row is alone."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble of uint64 values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def only(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def grouped(batches, name: str, most: int = 1 << 14):
    """Tables of whole groups from batches in which the rows of a group, by the
    column ``name``, follow one another; small groups come together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        column = only(batch, name)
        if rows >= most and column[0] != column[-1]:
            values = column.to_numpy(zero_copy_only=False)
            cut = batch.num_rows - int(np.argmax(values[::-1] != values[-1]))
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held, rows = [batch.slice(cut)], batch.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


#: Bytes that make words: ASCII letters (as lower case), digits, and all beyond ASCII; 0 parts words.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _POWERS[0], np.uint64))
    return _POWERS


def _cuts(letters: np.ndarray, most: int = 1 << 22) -> list[int]:
    """Places between tokens, some ``most`` bytes apart."""
    out = [0]
    while len(letters) - out[-1] > most:
        gap = np.flatnonzero(letters[out[-1] + most :] == 0)
        if not len(gap):
            break
        out.append(out[-1] + most + int(gap[0]))
    return [*out, len(letters)]


def tokens(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, collapse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, in order, and the offsets
    (texts + 1) of each text's tokens. A token is a run of bytes for which
    ``letters`` is not 0, taken for what ``letters`` makes of them; with
    ``collapse``, equal neighbours count once. Long texts go piece by piece."""
    whole = letters[data]
    found, firsts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    cuts = _cuts(whole)
    for a, b in zip(cuts, cuts[1:]):
        part = whole[a:b]
        is_token = part > 0
        first = is_token.copy()
        first[1:] &= ~is_token[:-1]
        heads = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        first[heads] = is_token[heads]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        if collapse:
            is_token[1:] &= (part[1:] != part[:-1]) | first[1:]
        at = np.flatnonzero(is_token)
        heads = np.searchsorted(at, starts)
        sizes = np.diff(np.append(heads, len(at)))
        place = np.arange(len(at)) - np.repeat(heads, sizes)
        value = part[at].astype(np.uint64)
        value *= _powers(int(sizes.max()) + 1)[place]
        found.append(mix(np.add.reduceat(value, heads) ^ sizes.astype(np.uint64)))
        firsts.append(starts + a)
    return np.concatenate(found), np.searchsorted(np.concatenate(firsts), offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of letters and digits; case counts only beyond ASCII."""
    return tokens(data, offsets, _LETTERS)
