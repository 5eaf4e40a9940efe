"""BPE encoding and decoding with tree concatenation.

Ordinary text is cut into pieces by the vocabulary's pattern and each piece is
merged by itself, all in the tokenizer library. A long unsplit piece (a run
without white space, say) is a tree instead: its halves, down to leaves, are
encoded in parallel by threads that hold no lock, and a growing window around the join is encoded again until both of
its ends agree with the tokens on either side. Agreement means that the outer
tokens of the window are the ones that stood there, and that each of the two
pairs of neighbours across the window's ends is what BPE makes of its bytes; a
sequence whose neighbouring pairs are all such is the encoding of the whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import col, fresh, map_arrow, only, utf8

#: How the byte-level vocabularies cut text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a leaf of the tree; longer pieces are halved.
LEAF = 4096


class Coder:
    """One vocabulary: ranks of byte strings, from the content of its file."""

    def __init__(self, content: bytes, leaf: int = LEAF, threads: int = 2) -> None:
        pairs = [line.split() for line in content.splitlines() if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.encoding = tiktoken.Encoding("affinis", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf
        self.long = regex.compile(r"\S{%d,}|\s{%d,}" % (leaf, leaf))
        self.pieces = regex.compile(PIECES)
        self.words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(self.words), np.uint8)
        self.pool = ThreadPoolExecutor(threads) if threads > 1 else None

    @functools.cached_property
    def whole(self) -> tiktoken.Encoding:
        """Takes a text for one piece; unlike a piece's own encoder, it lets other
        threads run. Made when the first long piece comes."""
        return tiktoken.Encoding("affinis-leaf", pat_str=r"[\s\S]+", mergeable_ranks={w: i for i, w in enumerate(self.words) if w}, special_tokens={})

    def piece(self, data: bytes) -> list[int]:
        return self.encoding._core_bpe.encode_single_piece(data)

    def stretch(self, text: str) -> list[int]:
        """The encoding of a text as one piece."""
        return np.frombuffer(self.whole._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32).tolist()

    def _fits(self, a: int, b: int) -> bool:
        return self.piece(self.words[a] + self.words[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches from their own encodings."""
        if not left or not right:
            return left + right
        width = 4
        while True:
            lw, rw = min(width, len(left)), min(width, len(right))
            middle = self.piece(b"".join(self.words[t] for t in left[-lw:] + right[:rw]))
            start = lw == len(left) or (middle[0] == left[-lw] and self._fits(left[-lw - 1], middle[0]))
            end = rw == len(right) or (middle[-1] == right[rw - 1] and self._fits(middle[-1], right[rw]))
            if start and end:
                return left[: len(left) - lw] + middle + right[rw:]
            width *= 2

    def tree(self, text: str) -> list[int]:
        """The encoding of one unsplit piece, however long."""
        leaves = 1
        while len(text) > leaves * self.leaf:
            leaves *= 2
        cuts = [len(text) * i // leaves for i in range(leaves + 1)]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
        self.whole  # before the threads need it
        level = list(self.pool.map(self.stretch, parts)) if self.pool and len(parts) > 1 else [self.stretch(x) for x in parts]
        while len(level) > 1:
            joined = [self.join(a, b) for a, b in zip(level[::2], level[1::2])]  # a few tokens each
            level = joined + level[len(level) // 2 * 2 :]
        return level[0] if level else []

    def encode(self, text: str) -> np.ndarray:
        """Token ids of ``text``; special tokens' strings are ordinary text."""
        if len(text) < self.leaf or not self.long.search(text):
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        out: list[np.ndarray] = []
        short: list[int] = []
        for m in self.pieces.finditer(text):
            if len(m.group()) > self.leaf:
                out += [np.array(short, np.int32), np.array(self.tree(m.group()), np.int32)]
                short = []
            else:
                short += self.piece(m.group().encode())
        return np.concatenate([*out, np.array(short, np.int32)])

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of token ids, as uint8."""
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.uint8)
        shift = np.repeat(self.starts[tokens] - (ends - sizes), sizes)
        shift += np.arange(ends[-1])
        return self.blob[shift]


_coders: dict[tuple, Coder] = {}


def _coder(content: bytes, leaf: int) -> Coder:
    key = (hash(content), leaf)
    if key not in _coders:
        _coders[key] = Coder(content, leaf)
    return _coders[key]


def _vocabulary(docs: DataFrame, path: str):
    """The file's content as a broadcast; its size is the vocabulary's, below 2 MB."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", keep: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """``docs`` (its columns ``keep``; None: all but the text) with ``tokens``,
    the ids of the whole text, ``n_tokens``, and ``exact``: whether decoding
    the ids gives the text again, byte for byte.

    A null text has null in all three; an empty one has no tokens, 0 and true.
    Texts of any length are encoded whole. Rows are independent, so repeated
    rows have equal results. An empty table gives an empty table. If ``keep``
    has a column of one of the new names, the new one gets an underscore before
    its name. ``vocabulary`` is a file of base64 tokens and ranks, read by the
    driver and sent to the executors.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    source = docs.select(*[col(c) for c in keep if c != text], col(text))
    tokens, n_tokens, exact = fresh(source, "tokens", "n_tokens", "exact")
    kept = [f for f in source.schema if f.name != text or text in keep]
    schema = T.StructType([*kept, T.StructField(tokens, T.ArrayType(T.IntegerType(), False)), T.StructField(n_tokens, T.LongType()), T.StructField(exact, T.BooleanType())])
    sent = _vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, leaf)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                column = only(batch, text)
                known = np.asarray(column.is_valid())
                data, at = utf8(column)
                ids = [coder.encode(data[a:b].tobytes().decode()) if ok else np.zeros(0, np.int32) for a, b, ok in zip(at, at[1:], known)]
                sizes = np.array([len(x) for x in ids], np.int64)
                same = [np.array_equal(coder.decode(x), data[a:b]) for x, a, b in zip(ids, at, at[1:])]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=pa.array(~known))
                new = [lists, pa.array(sizes, mask=~known), pa.array(np.array(same, bool), mask=~known)]
                yield pa.RecordBatch.from_arrays([only(batch, f.name) for f in kept] + new, names=schema.names)

    return map_arrow(source, run, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its ``tokens`` in the column ``text``.

    Null tokens give a null text, no tokens an empty one. Ids outside the
    vocabulary, or null ones, raise ValueError; bytes that are not UTF-8, which
    only ids cut from a longer list can give, become replacement characters.
    A column of the name ``text`` is replaced.
    """
    kept = [f for f in encoded.schema if f.name != text]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])
    sent = _vocabulary(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, LEAF)
        for batch in batches:
            out = []
            for ids in only(batch, tokens):
                if not ids.is_valid:
                    out.append(None)
                    continue
                if ids.values.null_count:
                    raise ValueError("a token id is null")
                values = ids.values.to_numpy()
                if len(values) and (values.min() < 0 or values.max() >= len(coder.words)):
                    raise ValueError("a token id is outside the vocabulary")
                out.append(coder.decode(values).tobytes().decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*[only(batch, f.name) for f in kept], pa.array(out, pa.string())], names=schema.names)

    return map_arrow(encoded, run, schema)
