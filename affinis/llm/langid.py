"""Language identification by interpolated Kneser-Ney character models.

For each language a character model of order 4 is trained on a bounded sample
of labelled documents. All the n-grams seen in any language lie in one array of
sorted hashes per order, beside a row of log-probabilities, one per language,
interpolated already down to the uniform distribution. A text's n-grams are
looked up from the longest order down; the first order that knows the n-gram
gives all languages' values at once, scaled by what each language leaves for
n-grams it has not seen in that context.

The language of the lowest cross-entropy per character wins, if that is not
above the language's own threshold, calibrated on held-out labelled text and
higher for short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, fresh, map_arrow, mix, only, steps, utf8

ORDER = 4
DISCOUNT = 0.75
#: A short text's entropy is uncertain: the threshold is higher by this over the root of its characters.
SHORT = 2.0
#: Characters of a text that one step scores; longer texts go in pieces.
PIECE = 1 << 17


def _points(text: bytes) -> np.ndarray:
    """The characters that count: lower case, digits as one, white space as one, runs of these once."""
    s = text.decode(errors="replace").lower()
    c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    c = np.where((c >= 48) & (c <= 57), np.uint64(48), np.where(c <= 32, np.uint64(32), c))
    if len(c) > 1:
        c = c[np.concatenate([[True], (c[1:] != c[:-1]) | ((c[1:] != 32) & (c[1:] != 48))])]
    return c


def _grams(c: np.ndarray, n: int, start: np.ndarray) -> np.ndarray:
    """Hashes of the n characters that end at each position; 0 where a text has begun later than that."""
    h = np.full(len(c), 0x9E3779B97F4A7C15 + n, np.uint64)
    for k in range(n - 1, -1, -1):
        h *= np.uint64(0x100000001B3)
        h[k:] ^= c[: len(c) - k] if k else c
    h = mix(h)
    h[start < n - 1] = 0
    return h


def _positions(sizes: np.ndarray) -> np.ndarray:
    """For concatenated texts: each character's distance from its text's start."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class SortedHashes:
    """Sorted distinct hashes with an index on the leading bits, so that a
    search is a few vectorised steps."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.bits = max(1, int(np.ceil(np.log2(max(2, len(hashes))))) + 1)
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.concatenate([np.searchsorted(hashes, edges), [len(hashes)]]).astype(np.int32)
        self.widest = int(np.diff(self.first).max()) if len(hashes) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted hashes; -1 where there is none."""
        bucket = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(wanted), -1, np.int32)
        todo = np.flatnonzero(at < end)
        step = 0
        while len(todo):
            here = at[todo] + step
            hit = self.hashes[here] == wanted[todo]
            out[todo[hit]] = here[hit]
            step += 1
            todo = todo[~hit & (here + 1 < end[todo])]
        return out


class Model:
    """``languages``; per order n: sorted n-gram hashes with log-probabilities
    [n-grams, languages], and sorted context hashes with the log of what is left
    for unseen characters [contexts, languages]; ``unseen``, the log-probability
    of a character that no language has; thresholds by language."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.grams: list[tuple[SortedHashes, np.ndarray]] = []
        self.left: list[tuple[SortedHashes, np.ndarray]] = []
        self.unseen = np.zeros(len(languages))
        self.thresholds = np.full(len(languages), np.inf)

    def sums(self, c: np.ndarray, row: np.ndarray, pos: np.ndarray, n: int, skip: np.ndarray | None = None) -> np.ndarray:
        """For ``n`` texts in ``c``: the sums of log-probabilities [n, languages].
        ``skip``: characters that are context only."""
        value = np.zeros((len(c), len(self.languages)), np.float32)
        todo = np.arange(len(c)) if skip is None else np.flatnonzero(~skip)
        hashes = [_grams(c, k, pos) for k in range(1, ORDER + 1)]
        for k in range(ORDER, 0, -1):
            table, logs = self.grams[k - 1]
            place = table.find(hashes[k - 1][todo])
            hit = place >= 0
            value[todo[hit]] += logs[place[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k > 1:
                table, logs = self.left[k - 1]
                context = np.where(pos[todo] >= k - 1, hashes[k - 2][todo - 1], np.uint64(0))
                place = table.find(context)
                known = place >= 0
                value[todo[known]] += logs[place[known]]
        value[todo] += self.unseen
        return np.stack([np.bincount(row, value[:, j], minlength=n) for j in range(len(self.languages))], 1)


def _count(c: np.ndarray, pos: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: distinct n-gram hashes, their counts, their contexts' and their suffixes' hashes."""
    out = []
    hashes = [_grams(c, k, pos) for k in range(1, ORDER + 1)]
    for k in range(1, ORDER + 1):
        ok = np.flatnonzero(pos >= k - 1)
        h, first, n = np.unique(hashes[k - 1][ok], return_index=True, return_counts=True)
        at = ok[first]
        context = hashes[k - 2][at - 1] if k > 1 else np.zeros(len(h), np.uint64)
        suffix = hashes[k - 2][at] if k > 1 else np.zeros(len(h), np.uint64)
        out.append((h, n.astype(np.float64), context, suffix))
    return out


def train(texts: dict[str, list[bytes]], held: dict[str, list[bytes]], quantile: float = 0.995, margin: float = 0.6) -> Model:
    """A model of the languages in ``texts``; ``held`` calibrates: a language's
    threshold is the quantile of the cross-entropies of its held-out texts of 50
    characters or more, plus ``margin`` nats a character; without such texts it
    rejects nothing."""
    model = Model(sorted(texts))
    per = []
    for language in model.languages:
        points = [_points(t) for t in texts[language]]
        c = np.concatenate([np.zeros(0, np.uint64), *points])
        per.append(_count(c, _positions(np.array([len(x) for x in points], np.int64))))
    alphabet = len(np.unique(np.concatenate([p[0][0] for p in per]))) + 1 if per else 1
    lower: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1, np.uint64), np.full((1, len(per)), 1 / alphabet))]
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([p[k - 1][0] for p in per])) if per else np.zeros(0, np.uint64)
        contexts = np.unique(np.concatenate([p[k - 1][2] for p in per])) if per else np.zeros(0, np.uint64)
        context_of = np.zeros(len(union), np.int64)
        suffix_of = np.zeros(len(union), np.uint64)
        probability = np.zeros((len(union), len(per)))
        left = np.ones((len(contexts), len(per)))
        for j, p in enumerate(per):
            h, n, context, suffix = p[k - 1]
            at = np.searchsorted(union, h)
            context_of[at], suffix_of[at] = np.searchsorted(contexts, context), suffix
            if k < ORDER:  # how many different characters stand before the n-gram
                longer = p[k]
                where = np.searchsorted(h, longer[3])
                n = np.maximum(np.bincount(where, minlength=len(h))[: len(h)], 1).astype(np.float64)
            inside = np.searchsorted(contexts, context)
            total = np.bincount(inside, n, minlength=len(contexts))
            kinds = np.bincount(inside, minlength=len(contexts))
            seen = total > 0
            left[seen, j] = DISCOUNT * kinds[seen] / total[seen]
            probability[at, j] = (n - DISCOUNT) / total[inside]
        if k == 1:
            below = np.full((len(union), len(per)), 1 / alphabet)
        else:
            below = lower[k - 1][1][np.searchsorted(lower[k - 1][0], suffix_of)]
        probability += left[context_of] * below
        lower.append((union, probability))
        model.grams.append((SortedHashes(union), np.log(probability).astype(np.float32)))
        model.left.append((SortedHashes(contexts), np.log(left).astype(np.float32)))
    model.unseen = np.full(len(per), -np.log(alphabet))
    if len(model.left[0][1]):  # what each language leaves for characters it has never seen
        model.unseen = model.left[0][1][0].astype(np.float64) - np.log(alphabet)
    for j, language in enumerate(model.languages):
        entropies = [-s[j] / len(x) for t in held.get(language, []) if len(x := _points(t)) >= 50 for s in model.sums(x, np.zeros(len(x), np.int64), np.arange(len(x)), 1)]
        if entropies:
            model.thresholds[j] = float(np.quantile(entropies, quantile)) + margin
    return model


def fit(docs: DataFrame, per_language: int = 400, text: str = "text", lang: str = "lang", id: str = "doc_id") -> Model:
    """A model from labelled rows of ``docs``: at most ``per_language``
    documents of each language (a documented bound, by the order of a hash of
    the id), of which every fifth is held out for calibration. Rows
    without language or text are left out."""
    picked = _pick(docs, per_language, text, lang, id)
    texts: dict[str, list[bytes]] = {}
    held: dict[str, list[bytes]] = {}
    for k, r in enumerate(picked):
        (held if r["rank"] % 5 == 0 else texts).setdefault(r["lang"], []).append(r["text"].encode())
    for language in [x for x in held if x not in texts]:
        texts[language] = held[language]
    return train(texts, held)


def _pick(docs: DataFrame, most: int, text: str, lang: str, id: str) -> list:
    """Rows (lang, text, rank). The ranks are found without the texts; a small
    join then fetches the texts of the chosen rows alone."""
    named = docs.select(col(lang).cast("string").alias("lang"), F.xxhash64(col(id).cast("string")).alias("h"), col(text).alias("text")).where("lang is not null")
    by_hash = Window.partitionBy("lang").orderBy("h")
    first = named.select("lang", "h").withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= most)
    chosen = named.where("text is not null").join(F.broadcast(first.select("lang", "h").distinct()), ["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("lang", "rank").collect()


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``; None: all but the text) with ``lang_id``,
    the language or ``und``, and ``cross_entropy``, the lowest, in nats per
    character to 4 decimals.

    A null text has null in both. A text without characters is ``und`` with
    entropy null, as is every text under a model of no languages. Of languages
    with equal entropies the first by name wins. Whole texts are scored, long
    ones in pieces whose sums are added. Rows are independent; an empty table
    gives an empty table. If a kept column has one of the new names, the new
    one gets an underscore before its name.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    source = docs.select(*[col(c) for c in dict.fromkeys([*keep, text])])
    l_name, e_name = fresh(source, "lang_id", "cross_entropy")
    kept = [f for f in source.schema if f.name in keep]
    schema = T.StructType([*kept, T.StructField(l_name, T.StringType()), T.StructField(e_name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        names = np.array([*m.languages, "und"], object)
        for whole in batches:
            for first, last in steps(utf8(only(whole, text))[1], 1 << 18):
                batch = whole.slice(first, last - first)
                known = np.asarray(only(batch, text).is_valid())
                data, at = utf8(only(batch, text))
                points = [_points(data[a:b].tobytes()) for a, b in zip(at, at[1:])]
                sizes = np.array([len(x) for x in points], np.int64)
                c, pos = np.concatenate(points), _positions(sizes)
                row = np.repeat(np.arange(len(points)), sizes)
                total = np.zeros((len(points), len(m.languages)))
                for a in range(0, len(c), PIECE):
                    back = max(0, a - ORDER)
                    skip = np.arange(back, min(len(c), a + PIECE)) < a
                    total += m.sums(c[back : a + PIECE], row[back : a + PIECE], np.minimum(pos[back : a + PIECE], np.arange(len(skip)) + (0 if back else ORDER)) if back == 0 else pos[back : a + PIECE], len(points), skip) if m.languages else 0
                ok = known & (sizes > 0) & bool(m.languages)
                entropy = -total / np.maximum(sizes, 1)[:, None] if m.languages else np.zeros((len(points), 1))
                best = entropy.argmin(1)
                least = entropy[np.arange(len(points)), best]
                accepted = ok & (least <= m.thresholds[best] + SHORT / np.sqrt(np.maximum(sizes, 1)) if m.languages else False)
                name = names[np.where(accepted, best, len(m.languages))]
                yield pa.RecordBatch.from_arrays([*[only(batch, f.name) for f in kept], pa.array(name, pa.string(), mask=~known), pa.array(np.round(least, 4), mask=~ok)], names=schema.names)

    return map_arrow(source, run, schema)
