"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text's bytes are coded bit by bit. Two predictors, of orders 2 and 4, look up
the log-odds of a 1 in tables of the corpus, under a hash of the bytes before and
of the bits of the byte so far; an entry holds a check of its context, and where
two want one place the more frequent stays. Two predictors move with the text:
counters of its bits under the bits of the byte so far, and a match model, which
guesses the byte that followed where the four bytes before stood last, if the
five before are the same; its trust grows with the length of the match and with
its success. A mixer adds all log-odds with weights that are gated by the kind of
the byte before and the bit's place. An adaptive probability map refines the sum:
a shift for each kind, place and level of the sum. Weights, map, counters and
trust begin alike for every text and learn online from its own bits, block by
block; the cost of all bits is the text's score.

The tables are counts over all documents. Documents are in two folds by a hash
of their text, and a document is scored by the counts of the other fold, so
neither it nor its exact copies tell about it. Tables are wider for a larger
corpus, without an end. Counts travel in pages (a range of contexts of one order
and fold), and a task turns the counts of a page into a segment of the table.
Where an order has more entries than a worker may hold, its pages are written in
shards, and a worker gathers the log-odds of some texts from one shard after the
other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, file_system, fresh, lean, map_arrow, only, steps, until_exit, utf8

ORDERS = (2, 4)
#: Log-odds of the tables are kept in steps of 1/SCALE, as one byte.
SCALE = 14.0
#: Entries of a page, as a power of 2; the least of an order and fold.
PAGE_BITS = 16
#: Entries of an order and fold that a worker holds at once, as a power of 2.
MOST_BITS = 24
#: Pairs of context and byte that a task counts before it sends them on.
PAIRS = 3_000_000
#: Bytes of text whose log-odds a worker gathers from the shards at a time.
SPAN = 1 << 22
#: Bytes of a block; beyond so many bytes of a text a block is four times as long.
BLOCK, EARLY, TOGETHER = 256, 4096, 64
#: At first, of the tables' orders, of the counters and of the match model.
START_WEIGHTS = (0.35, 0.65, 0.3, 0.3)
RATE, MAP_RATE = 0.002, 0.005
#: Levels of the map, from -LEVEL to LEVEL.
LEVELS, LEVEL = 24, 8.0
#: Counters start at FEW, and are halved beyond MANY.
FEW, MANY = 0.4, 400.0
#: The right bits by which the match model first believes a guess, where no, and
#: at least 5, 8, 16, 24 and 32 bytes before are the same.
_BELIEF = np.array([1, 2, 5, 12, 30, 80], np.float32)
_EIGHT = np.arange(-8, 0)
_HASH = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
#: The kind of the byte before: letter or digit, other ASCII, beyond ASCII.
_KIND = np.array([0 if chr(b).isalnum() and b < 128 else 1 if b < 128 else 2 for b in range(256)], np.uint8)
_BIT = np.arange(8, dtype=np.uint8)[:, None]
_ONE = np.uint8(1)
#: By the difference of a guess and a byte (256 for no guess): the leading bits that are right.
_RIGHT = np.array([8 - x.bit_length() for x in range(256)] + [0], np.float32)


def spread(total_bytes: int) -> int:
    """The entries of an order and fold, as a power of 2: nearly as the bytes to
    the power 0.6, as the contexts that matter grow more slowly than the text."""
    return min(PAGE_BITS + 32, max(PAGE_BITS, math.ceil(0.6 * math.log2(max(2, total_bytes)) + 5.2)))


def _contexts(before: list[np.ndarray]) -> list[np.ndarray]:
    """Per order the context's hash, from the bytes before (1, 2, ... back)."""
    out = []
    h, done = np.zeros(before[0].shape, np.uint32), 0
    for order in ORDERS:
        for k in range(done, order):
            late = h >> np.uint32(15)
            h += before[k]
            h *= _HASH[k]
            h += late
        done = order
        c = h * np.uint32(0x9E3779B1)
        c ^= c >> np.uint32(16)
        c *= np.uint32(0x85EBCA77)
        out.append(c)
    return out


def _paths(byte: np.ndarray) -> np.ndarray:
    """The nodes that bytes [.., n] pass [.., 8, n]: a 1, and the bits so far."""
    out = byte[..., None, :] >> 8 - _BIT
    out |= _ONE << _BIT
    return out


def _signs(byte: np.ndarray) -> np.ndarray:
    """1 for a bit that is 1, else -1 [.., 8, n]."""
    out = ((byte[..., None, :] & np.uint8(128) >> _BIT) > 0).view(np.int8)
    out += out
    out -= np.int8(1)
    return out


def _lines(contexts: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 15 nodes of half a byte lie together, in a line of 16 places. For
    hashes of contexts and what stands before the half (1, or 16 and the first
    half): where in the page the line begins, with how its places are mixed in
    the lowest four bits, and a number with the check in its lowest byte."""
    h = (contexts * np.uint32(0xC2B2AE3D)) ^ (prefix * np.uint32(0x9E3779B1))
    h *= np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    line = h >> np.uint32(32 - PAGE_BITS)
    line &= np.uint32((1 << PAGE_BITS) - 16)
    turn = h >> np.uint32(8)
    turn &= np.uint32(15)
    line |= turn
    return line.astype(np.int64), h.astype(np.int16)


def _place(contexts: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes (of one level: a 1, and the bits before) the place in the
    context's page, and the check."""
    late = node >= 16
    level = np.floor(np.log2(node)).astype(np.int64) - np.where(late, 4, 0)
    line, check = _lines(contexts, np.where(late, node >> level, 1).astype(np.uint32))
    return (1 << level | node & (1 << level) - 1) ^ line, check & 0xFF


def _windows(data: np.ndarray, at: np.ndarray, first: int, last: int) -> Iterator[tuple[slice, np.ndarray, int, int, list[np.ndarray]]]:
    """Pieces of the texts' bytes from ``first`` to ``last``: their rows, the
    bytes of each, the piece's ends, and per byte those before it in its text."""
    for low in range(first, last, 1 << 20):
        high = min(last, low + (1 << 20))
        rows = slice(int(np.searchsorted(at, low, side="right")) - 1, int(np.searchsorted(at, high)))
        starts = at[rows]
        sizes = np.minimum(at[1:][rows], high) - np.maximum(starts, low)
        before = []
        for k in range(1, max(ORDERS) + 1):
            b = np.zeros(high - low, np.uint8)
            b[max(0, k - low) :] = data[max(0, low - k) : max(0, high - k)]
            for j in range(k):  # no byte of the text before; the next text, if one is so short, has none there either
                b[(where := starts + j - low)[(where >= 0) & (where < high - low)]] = 0
            before.append(b)
        yield rows, sizes, low, high, before


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for whole in batches:
        folds, (data, at) = only(whole, "fold").to_numpy(), utf8(only(whole, "text"))
        for rows, sizes, low, high, before in _windows(data, at, 0, len(data)):
            fold = np.repeat(folds[rows].astype(np.int64), sizes) << 40
            for o, c in enumerate(_contexts(before)):
                ids, counts = np.unique(fold | c.astype(np.int64) << 8 | data[low:high], return_counts=True)
                held.append((ids + (o << 41), counts))
                size += len(ids)
            if size > PAIRS:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > PAIRS // 2:
                    yield from _packed(*held[0], bits)
                    held, size = [], 0
    if held:
        yield from _packed(*_merged(held), bits)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    if len(ids) and ids.max() < 1 << 42 and counts.max() < 1 << 21:  # one number sorts faster than two
        both = np.sort(ids << 21 | counts)
        ids, counts = both >> 21, both & ((1 << 21) - 1)
    else:
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    return ids[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(ids: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of a page each: contexts, bytes and counts. Ids are of the order, the
    fold, the context and the byte, from the highest bit to the lowest."""
    pages = ids >> 40 - (bits - PAGE_BITS)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(pages)) + 1, [len(pages)]])
    for first in range(0, len(edges) - 1, 64):
        parts = [slice(a, b) for a, b in zip(edges[first : first + 64], edges[first + 1 : first + 65])]
        packed = [(ids[p] >> 8 & 0xFFFFFFFF).astype(np.uint32).tobytes() + counts[p].astype(np.uint32).tobytes() + (ids[p] & 255).astype(np.uint8).tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([int(pages[p.start]) for p in parts], pa.int64()), pa.array(packed, pa.binary())], names=["page", "counts"])


def segment(contexts: np.ndarray, byte: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A page's entries, from the counts of bytes after contexts, which are sorted
    and distinct: log-odds in the upper byte, check in the lower. Of the nodes
    that want one place the one of the highest count has it (of equal ones the
    first by level and context)."""
    places, checks, odds, totals = [], [], [], []
    for k in range(8):
        prefix = byte >> 8 - k if k else np.zeros_like(byte)
        first = np.flatnonzero((np.diff(contexts, prepend=0) != 0) | (np.diff(prefix.astype(np.int16), prepend=-1) != 0)) if len(byte) else np.zeros(0, np.int64)
        if not len(first):
            continue
        both = np.add.reduceat(counts, first)
        one = np.add.reduceat(counts * (byte >> 7 - k & 1), first)
        place, check = _place(contexts[first], (1 << k) | prefix[first].astype(np.int64))
        places.append(place)
        checks.append(check)
        odds.append(np.clip(np.round(np.log((one + 0.4) / (both - one + 0.4)) * SCALE), -127, 127).astype(np.int16))
        totals.append(both)
    out = np.zeros(1 << PAGE_BITS, np.int16)
    if places:
        place, check, odd, total = (np.concatenate(x) for x in (places, checks, odds, totals))
        order = np.argsort(-total, kind="stable")
        place, at = np.unique(place[order], return_index=True)
        out[place] = odd[order][at] << 8 | check[order][at]
    return out


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a page follow one another."""
    now, held, size = None, [], 0

    def done() -> pa.RecordBatch:
        ids, counts = _merged(held)
        odds = segment((ids >> 8).astype(np.uint32), (ids & 255).astype(np.uint8), counts)
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([odds.tobytes()], pa.binary())], names=["page", "odds"])

    for batch in batches:
        for page, packed in zip(only(batch, "page").to_pylist(), only(batch, "counts").to_pylist()):
            if page != now:
                if now is not None:
                    yield done()
                now, held, size = page, [], 0
            n = len(packed) // 9
            ids = np.frombuffer(packed, np.uint32, n).astype(np.int64) << 8 | np.frombuffer(packed, np.uint8, n, 8 * n)
            held.append((ids, np.frombuffer(packed, np.uint32, n, 4 * n).astype(np.int64)))
            size += n
            if size > PAIRS:
                held = [_merged(held)]
                size = len(held[0][0])
    if now is not None:
        yield done()


def fit(docs: DataFrame, text: str = "text", held: int = MOST_BITS, bits: int | None = None) -> tuple[str, int, int]:
    """Count all of ``docs``; the model is a table in the shared folder (its
    path), the entries of an order and fold, and those of a shard, at most
    ``held`` (of a page at least), as powers of 2. ``bits`` None: as ``spread``
    says. Null and empty texts add nothing."""
    known = docs.select(col(text).alias("text")).where("text is not null")
    bits = bits or spread(known.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0)
    held = min(bits, max(PAGE_BITS, held))
    counts = known.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2))).select("fold", "text").mapInArrow(lean(lambda b: _count(b, bits)), "page long, counts binary")
    path = until_exit(docs.sparkSession, "lm")
    pages = counts.repartition("page").sortWithinPartitions("page").mapInArrow(lean(_pages), "page long, odds binary")
    if held == bits:
        pages.write.parquet(path)
    else:  # a shard has a range of contexts of an order, of both folds
        top, more = bits - PAGE_BITS, bits - held
        order = F.shiftright("page", top + 1)
        range_ = F.shiftright(F.col("page").bitwiseAND(F.lit((1 << top) - 1)), top - more)
        pages.withColumn("shard", F.shiftleft(order, more) + range_).write.partitionBy("shard").parquet(path)
    return path, bits, held


_loaded: dict[str, np.ndarray] = {}


def _read(path: str, entries: int, where: Callable[[int], int]) -> np.ndarray:
    """The table of the pages in a folder, if there is one: ``where`` says how
    many pages lie before a page."""
    table = np.zeros(entries, np.int16)
    fs, folder = file_system(path)
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(64):
                    for page, odds in zip(batch.column(0).to_pylist(), batch.column(1)):
                        at = where(page) << PAGE_BITS
                        table[at : at + (1 << PAGE_BITS)] = np.frombuffer(odds.as_buffer(), np.int16)
    return table


def _nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bytes [.., n]: what stands before each half [.., 2, n], and the nodes
    that the halves pass [.., 2, 4, n]."""
    nodes = _paths(byte)
    prefix = nodes[..., ::4, :].astype(np.uint32)
    late = nodes[..., 4:, :]
    late &= (_ONE << _BIT[:4]) - _ONE
    late |= _ONE << _BIT[:4]
    return prefix, nodes.astype(np.int64).reshape(*byte.shape[:-1], 2, 4, byte.shape[-1])


def _odds(table: np.ndarray, base: np.ndarray, contexts: np.ndarray, prefix: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Log-odds in steps [.., 8, n] on the way of bytes (``_nodes``) under contexts
    [.., n], whose pages begin at ``base``; 0 for what the table doesn't know."""
    line, check = _lines(contexts[..., None, :], prefix)
    line += base[..., None, :]
    found = table.take(nodes ^ line[..., None, :], mode="clip")  # none lies outside
    known = found ^ check[..., None, :]
    known &= np.int16(0xFF)
    found >>= np.int16(8)
    found *= known == 0
    return found.reshape(*found.shape[:-3], 8, found.shape[-1])


class Table:
    """All entries, once a worker."""

    def __init__(self, path: str, bits: int, held: int) -> None:
        self.bits = bits
        if path not in _loaded:
            _loaded.clear()
            _loaded[path] = _read(path, len(ORDERS) * 2 << bits, lambda page: page)
        self.table = _loaded[path]

    def look(self, o: int, contexts: np.ndarray, way: tuple[np.ndarray, np.ndarray], folds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of order ``o``: log-odds in steps, by the other fold's counts."""
        top = contexts.astype(np.int64) >> 32 - (self.bits - PAGE_BITS) << PAGE_BITS
        top += ((o * 2 + 1 - folds) << self.bits)[:, None]
        return _odds(self.table, top, contexts, *way)


class Shards:
    """The log-odds for some texts, gathered from one shard after the other;
    texts of more than SPAN bytes together are one text, which is read from its
    start to its end."""

    def __init__(self, path: str, bits: int, held: int, data: np.ndarray, at: np.ndarray, folds: np.ndarray) -> None:
        self.path, self.bits, self.held = path, bits, held
        self.data, self.at, self.folds = data, at, folds
        self.low = self.high = 0

    def _fill(self, first: int) -> None:
        self.low, self.high = first, min(len(self.data), first + SPAN)
        n, more, top = self.high - first, self.bits - self.held, self.bits - PAGE_BITS
        contexts, fold = np.empty((len(ORDERS), n), np.uint32), np.empty(n, np.int64)
        for rows, sizes, low, high, before in _windows(self.data, self.at, first, self.high):
            for o, c in enumerate(_contexts(before)):
                contexts[o, low - first : high - first] = c
            fold[low - first : high - first] = np.repeat(1 - self.folds[rows], sizes)
        self.odds = np.empty((len(ORDERS), 8, n), np.int8)
        own = (1 << top - more) - 1  # pages of a fold in a shard, less one
        for o in range(len(ORDERS)):
            shard = (contexts[o].astype(np.int64) >> 32 - more).astype(np.uint32)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange((1 << more) + 1))
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if a == b:
                    continue
                table = _read(f"{self.path}/shard={(o << more) + k}", 2 << self.held, lambda page: (page >> top & 1) << top - more | page & own)
                for low in range(a, b, 1 << 18):
                    some = order[low : min(b, low + (1 << 18))]
                    page = (contexts[o, some].astype(np.int64) >> 32 - top) & own
                    base = fold[some] << self.held | page << PAGE_BITS
                    self.odds[o][:, some] = _odds(table, base, contexts[o, some], *_nodes(self.data[first + some]))

    def look(self, o: int, contexts: np.ndarray, way: tuple[np.ndarray, np.ndarray], folds: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(self.data) <= SPAN:
            if not self.high:
                self._fill(0)
        elif at[0, 0] >= self.high:  # SPAN is a number of blocks
            self._fill(int(at[0, 0]))
        return self.odds[o].take(at - self.low, axis=1, mode="clip").swapaxes(0, 1)  # places that don't count lie outside


def _eights(data: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function from places to the eight bytes before each, as one number with
    the last byte highest; what lies before the data doesn't count."""
    if len(data) > 1 << 24:
        return lambda at: data.take(at[..., None] + _EIGHT, mode="clip").view("<u8")[..., 0]
    padded = np.concatenate([np.zeros(8, np.uint8), data])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).copy()
    return lambda at: words.take(at, mode="clip")


def _histogram(row: np.ndarray, byte: np.ndarray, live: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's live bytes: how often each node's bit was 0 and 1 [n, 256]."""
    leaf = row + byte
    leaves = np.bincount(leaf.ravel() if live.all() else leaf[live], minlength=n << 8).reshape(n, 256).astype(np.float32)
    zero, one = np.zeros((n, 256), np.float32), np.zeros((n, 256), np.float32)
    for low in (128, 64, 32, 16, 8, 4, 2, 1):
        zero[:, low : 2 * low], one[:, low : 2 * low] = leaves[:, ::2], leaves[:, 1::2]
        leaves = leaves[:, ::2] + leaves[:, 1::2]
    return zero, one


def _wide(values: np.ndarray, width: int) -> np.ndarray:
    """Values [.., n] with zeros up to a block's whole width: sums over blocks of
    one width come out alike, however long a text's neighbours are."""
    n = values.shape[-1]
    if n == width:
        return values
    out = np.zeros((*values.shape[:-1], width), values.dtype)
    out[..., :n] = values
    return out


def cost(model: Table | Shards, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Bits that each of some texts costs, from the longest to the shortest, under
    the other fold's counts. Texts advance together, a block at a time, each with
    its own weights, map, counters and matches, which change after the block."""
    out = np.zeros(len(sizes))
    step, eights = np.float32(1 / SCALE), _eights(data)
    for first in range(0, len(sizes), TOGETHER):
        rows = slice(first, first + TOGETHER)
        start, size, fold = starts[rows], sizes[rows], folds[rows]
        n = len(size)
        weights = np.tile(np.repeat(np.array(START_WEIGHTS, np.float32), 8)[:, None], (n, 1, 3))
        shifts, total = np.zeros((n, 24 * LEVELS), np.float32), np.zeros(n)
        zero, one = np.full((n, 256), FEW, np.float32), np.full((n, 256), FEW, np.float32)
        wrong, right = np.ones((n, len(_BELIEF)), np.float32), np.tile(_BELIEF, (n, 1))
        own_bits = np.array([min(18, max(8, int(x).bit_length())) for x in size])  # of a text's table of matches
        most_bits = int(own_bits.max()) if n else 0
        seen = np.zeros((n, 1 << most_bits), np.int32)
        room = np.empty((2, n * len(START_WEIGHTS) * 8 * min(int(size[0]), 4 * BLOCK)) if n else 0, np.float32)
        high = 0
        while n and high < size[0]:
            low, high = high, high + (BLOCK if high < EARLY else 4 * BLOCK)
            n = int(np.searchsorted(-size, -low))  # those that are longer
            each = np.arange(n)[:, None]
            place = np.arange(low, min(high, int(size[0])))  # beyond, no text has bytes
            live = place < size[:n, None]
            every = bool(live.all())
            at = start[:n, None] + (place if every else np.where(live, place, 0))
            byte = data.take(at)
            before = []
            for k in range(1, max(ORDERS) + 1):
                before.append(data.take(at - k, mode="clip"))
                if low == 0:
                    before[-1][:, :k] = 0
            contexts = _contexts(before)
            turn = _signs(byte)
            path, sign = _paths(byte).astype(np.int64), turn.astype(np.float32)
            path += (each << 8)[..., None]
            kind = _KIND.take(before[0])
            gate = (kind[:, None, :] == np.arange(3, dtype=np.uint8)[:, None]).astype(np.float32)
            way = _nodes(byte)
            many = len(START_WEIGHTS) - (not low)  # of the predictors; before the first block, nothing has stood
            x, part = (r[: n * many * path[0].size].reshape(n, many, *path.shape[1:]) for r in room)
            for o, c in enumerate(contexts):
                x[:, o] = model.look(o, c, way, fold[:n], at)
                x[:, o] *= step
            x[:, len(ORDERS)] = np.log(one[:n] / zero[:n]).take(path, mode="clip")

            slot = (each << most_bits) + (contexts[-1] >> (32 - own_bits[:n, None]).astype(np.uint32))
            if low:
                last = seen.take(slot, mode="clip")  # the place after the one where the context stood
                there = start[:n, None] + last - 1
                apart = eights(there) ^ eights(at)
                length = ((last > 5) & (apart < 1 << 24)).astype(np.int64)
                same = np.flatnonzero((last > 8) & (apart == 0))
                length.reshape(-1)[same] += 1
                for k in (8, 16, 24):
                    a, b = there.take(same) - k, at.take(same) - k
                    same = same[(last.take(same) > k + 8) & (eights(a) == eights(b))]
                    length.reshape(-1)[same] += 1
                off = data.take(there, mode="clip") ^ byte  # of the guess
                guessed = (length > 0) & live
                differ = np.where(guessed, off, np.uint16(256))
                belief = np.log(right[:n] / wrong[:n]).take(each * len(_BELIEF) + length) * guessed
                hit = (off[:, None, :] <= np.uint8(127) >> _BIT).view(np.int8)
                hit += hit
                hit -= (off[:, None, :] <= np.uint8(255) >> _BIT).view(np.int8)
                turn *= hit  # against the bit, if it is the first that is wrong; none after it
                np.multiply(belief[:, None, :], turn, out=x[:, -1])

            np.matmul(weights[:n, : many * 8], gate, out=part.reshape(n, many * 8, -1))
            part *= x
            z = part.sum(1)
            scaled = z * np.float32(LEVELS / (2 * LEVEL))
            scaled += np.float32(LEVELS / 2)
            level = np.clip(scaled, 0, LEVELS - 1, out=scaled).astype(np.int32)
            level += ((each * 24 + kind * np.int64(8)) * LEVELS).astype(np.int32)[:, None, :]
            level += _BIT * np.int32(LEVELS)
            level = level.astype(np.int64)
            e = shifts.take(level, mode="clip")
            e += z
            e *= sign
            np.negative(e, out=e)
            if e.max() > 30:
                np.minimum(e, 30, out=e)
            np.exp(e, out=e)
            if not every:
                e *= live[:, None, :]
            miss = e + 1
            total[:n] += _wide(np.log(miss), high - low).sum(2).sum(1, dtype=np.float64)
            np.divide(e, miss, out=miss)
            miss *= sign

            turned, damp = np.swapaxes(_wide(gate, high - low), 1, 2), BLOCK / (high - low)  # a longer block doesn't take a longer step
            for i in range(many):
                np.multiply(miss, x[:, i], out=part[:, i])
            weights[:n, : many * 8] += np.float32(RATE * damp) * np.matmul(_wide(part.reshape(n, many * 8, -1), high - low), turned)
            moved = np.bincount(level.ravel(), miss.ravel(), minlength=n * 24 * LEVELS)
            shifts[:n] += np.float32(MAP_RATE * damp) * moved.reshape(n, -1).astype(np.float32)
            for old, new in zip((zero, one), _histogram(each << 8, byte, live, n)):
                old[:n] += new
            much = zero[:n] + one[:n] > MANY
            if much.any():
                zero[:n][much], one[:n][much] = zero[:n][much] / 2 + FEW / 2, one[:n][much] / 2 + FEW / 2
            if low:
                which = (each * len(_BELIEF) + length).ravel()
                for old, new in ((right, _RIGHT.take(differ)), (wrong, (differ & 255) > 0)):
                    old[:n] += np.bincount(which, new.ravel(), minlength=n * len(_BELIEF)).reshape(n, -1)
            if high < size[0]:
                after = np.broadcast_to(place.astype(np.int32) + np.int32(1), live.shape)
                if every:
                    seen.reshape(-1)[slot] = after
                else:
                    seen.reshape(-1)[slot[live]] = after[live]
        out[rows] = total / math.log(2)
    return out


def _together(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches of at least SPAN bytes of text, but for the last."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        kept.append(batch)
        size += int(utf8(only(batch, text))[1][-1])
        if size >= SPAN:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, size = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def score(docs: DataFrame, model: tuple[str, int, int], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``; None: all but the text) with ``n_bytes``,
    ``bits``, the cost of the whole text to 2 decimals, and ``bits_per_byte``,
    to 4.

    A null text has null in all three, an empty one 0, 0 and null. Repeated rows
    have equal results. An empty table gives an empty table. If a kept column has
    one of the new names, the new one gets an underscore before its name.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    wanted = docs.select(*[col(c) for c in dict.fromkeys([*keep, text])])
    n_name, b_name, p_name, fold_name = fresh(wanted, "n_bytes", "bits", "bits_per_byte", "fold")
    source = wanted.withColumn(fold_name, F.pmod(F.xxhash64(col(text)), F.lit(2)))
    kept = [f for f in wanted.schema if f.name in keep]
    schema = T.StructType([*kept, T.StructField(n_name, T.LongType()), T.StructField(b_name, T.DoubleType()), T.StructField(p_name, T.DoubleType())])
    where, bits, held = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches if held == bits else _together(batches, text):
            whole_table = Table(where, bits, held) if held == bits else None
            for first, last in steps(utf8(only(whole, text))[1], 1 << 22 if held == bits else SPAN):
                batch = whole.slice(first, last - first)
                known = np.asarray(only(batch, text).is_valid())
                data, at = utf8(only(batch, text))
                sizes = np.diff(at)
                order = np.argsort(-sizes, kind="stable")
                found = np.zeros(len(sizes))
                folds = only(batch, fold_name).to_numpy(zero_copy_only=False)
                found[order] = cost(whole_table or Shards(where, bits, held, data, at, folds), data, at[:-1][order], sizes[order], folds[order])
                per = found / np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays([*[only(batch, f.name) for f in kept], pa.array(sizes, mask=~known), pa.array(np.round(found, 2), mask=~known), pa.array(np.round(per, 4), mask=~known | (sizes == 0))], names=schema.names)

    return map_arrow(source, run, schema)
