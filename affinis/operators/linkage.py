"""Semantic linkage joins and scores.

Keys are columns of text, serialised, or a column of vectors. Only ids and keys
go through the search, every distinct text once; the rows' other columns join
at the end. Rows are told apart by id columns, or by generated ids, which a
written table keeps stable.

Ties go to the lesser right id. A row whose key is empty, or whose vector is
null or zero, has no match.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions import vectors
from ..functions.text import SEPARATOR, edit_similarity, ngram_cosine, serialize
from ..plans import similarity
from ..plans.storage import stash
from .embed import Embedder, Encoder, Ngrams, Precomputed

LEFT, RIGHT = "__left_id", "__right_id"
Keys = str | list[str] | None


def _listed(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys or [])


def resolve_keys(left: DataFrame, right: DataFrame, on: Keys = None, left_on: Keys = None, right_on: Keys = None) -> tuple[list[str], list[str]]:
    """Key columns of both sides; by default all common columns in the left
    table's order. Missing columns raise ValueError."""
    l, r = _listed(left_on) or _listed(on), _listed(right_on) or _listed(on)
    if not l and not r:
        l = r = [c for c in left.columns if c in right.columns]
    l, r = l or r, r or l
    for df, keys in ((left, l), (right, r)):
        missing = [c for c in keys if c not in df.columns]
        if missing or not keys:
            raise ValueError(f"key columns are missing: {missing}" if missing else "no key columns")
    return l, r


def with_row_ids(df: DataFrame, name: str, id: str | None = None) -> DataFrame:
    """``df`` with a row id: a column's values, or generated and written once."""
    if name in df.columns:
        raise ValueError(f"column {name} exists already")
    if id is not None:
        return df.withColumn(name, col(id))
    return stash(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def glue(pairs: DataFrame, left: DataFrame, right: DataFrame, suffixes: tuple[str, str], how: str = "inner", row_ids: bool = False) -> DataFrame:
    """Pairs with both sides' columns; names that overlap get suffixes."""
    own = [c for c in left.columns if c != LEFT]
    other = [c for c in right.columns if c != RIGHT]
    both = set(own) & set(other)
    a = left.select(LEFT, *[col(c).alias(c + suffixes[0] if c in both else c) for c in own])
    b = right.select(RIGHT, *[col(c).alias(c + suffixes[1] if c in both else c) for c in other])
    named = pairs.select(F.col("left_id").alias(LEFT), F.col("right_id").alias(RIGHT), "score")
    whole = a.join(named.join(b, RIGHT), LEFT, "left" if how == "left" else "inner")
    ids = [F.col(LEFT).alias("id_lt" + suffixes[0]), F.col(RIGHT).alias("id_lt" + suffixes[1])] if row_ids else []
    return whole.select(*ids, *[col(c) for c in a.columns if c != LEFT], *[col(c) for c in b.columns if c != RIGHT], "score")


def _block(columns: list[str]):
    if not columns:
        return F.lit("")
    return F.when(F.greatest(*[col(c).isNull() for c in columns], F.lit(False)), F.lit(None)).otherwise(serialize(columns, "\x1f"))


def _vector_items(df: DataFrame, id: str, embedder: Precomputed, blocks: list[str] | None = None) -> DataFrame:
    return df.select(F.col(id).alias("id"), _block(blocks or []).alias("block"), col(embedder.column).alias("v"))


def _named_ids(pairs: DataFrame, ids: tuple[str, str], suffixes: tuple[str, str]) -> DataFrame:
    """Pairs under the names that ``glue`` gives to the id columns, without a join."""
    l, r = (name + s if ids[0] == ids[1] else name for name, s in zip(ids, suffixes))
    return pairs.select(F.col("left_id").alias(l), F.col("right_id").alias(r), "score")


def matches(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], embedder: Embedder, k: int | None, threshold: float | None = None, blocks: list[str] | None = None, sep: str = SEPARATOR) -> DataFrame:
    """(left_id, right_id, score) for tables with row ids, within equal blocks."""
    blocks = blocks or []
    block = _block(blocks).alias("block")
    if isinstance(embedder, Precomputed):
        return similarity.dense(_vector_items(left, LEFT, embedder, blocks), _vector_items(right, RIGHT, embedder, blocks), k, threshold)
    a = left.select(F.col(LEFT).alias("left_id"), block, serialize(left_on, sep).alias("text"))
    b = right.select(F.col(RIGHT).alias("right_id"), block, serialize(right_on, sep).alias("text"))
    # search by distinct texts; a right text stands for its rows, the least id first
    text_a, text_b = a.select("block", "text").where("block is not null").distinct(), b.where("block is not null").groupBy("block", "text").agg(F.min("right_id").alias("id"))
    if isinstance(embedder, Encoder):
        left_items = stash(text_a.where("text <> ''").withColumn("v", embedder.column(F.col("text"))), "left-vectors")
        right_items = stash(text_b.where("text <> ''").withColumn("v", embedder.column(F.col("text"))), "right-vectors")
        found = similarity.dense(left_items.withColumn("id", F.concat_ws("\x1e", "block", "text")), right_items, k, threshold)
    else:
        found = similarity.sparse(text_a.withColumn("id", F.concat_ws("\x1e", "block", "text")), text_b, embedder.n, k, threshold)
    spread = found.select(F.col("left_id").alias("key"), F.col("right_id").alias("first_id"), "score").join(text_b.select(F.col("id").alias("first_id"), "block", "text"), "first_id")
    if k is not None:  # of the rows of one text no more than k can count
        nth = F.row_number().over(Window.partitionBy("block", "text").orderBy("right_id"))
        b = b.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")
    rows = spread.join(b, ["block", "text"]).select("key", "right_id", "score")
    if k is not None:
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "right_id"))
        rows = rows.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")
    return a.withColumn("key", F.concat_ws("\x1e", "block", "text")).where("block is not null").join(rows, "key").select("left_id", "right_id", "score")


def merge_knn(left: DataFrame, right: DataFrame, on: Keys = None, k: int = 1, embedder: Embedder = Ngrams(), left_on: Keys = None, right_on: Keys = None, suffixes: tuple[str, str] = ("_x", "_y"), drop_sim_threshold: float | None = None, left_id: str | None = None, right_id: str | None = None, keep_row_ids: bool = False, sep: str = SEPARATOR, ids_only: bool = False) -> DataFrame:
    """Every left row with its ``k`` most similar right rows (all of them if
    there are fewer) and ``score``; a threshold drops rows below it. ``ids_only``
    gives the id columns and the score, and joins no others."""
    if k < 1:
        raise ValueError("k is at least 1")
    l, r = ([], []) if isinstance(embedder, Precomputed) else resolve_keys(left, right, on, left_on, right_on)
    a, b = with_row_ids(left, LEFT, left_id), with_row_ids(right, RIGHT, right_id)
    # a threshold is monotone in the rank, so it may go below the ranking
    found = matches(a, b, l, r, embedder, k, drop_sim_threshold, sep=sep)
    if ids_only:
        return _named_ids(found, _own_ids(left_id, right_id), suffixes)
    return glue(found, a, b, suffixes, row_ids=keep_row_ids)


def _own_ids(left_id: str | None, right_id: str | None) -> tuple[str, str]:
    if left_id is None or right_id is None:
        raise ValueError("ids_only needs id columns of both sides")
    return left_id, right_id


def merge(left: DataFrame, right: DataFrame, on: Keys = None, merge_type: str | None = None, **options) -> DataFrame:
    """Every left row with its most similar right row. ``merge_type`` is an
    older callers' hint; it warns if keys repeat where they shouldn't."""
    if merge_type not in (None, "1:1", "1:m", "m:1"):
        raise ValueError(f"unknown merge type {merge_type}")
    if merge_type:
        l, r = resolve_keys(left, right, on, options.get("left_on"), options.get("right_on"))
        for df, keys, one in ((left, l, merge_type[0]), (right, r, merge_type[-1])):
            if one == "1" and not repeated_keys(df, keys).isEmpty():
                warnings.warn(f"keys {keys} repeat, in a merge of type {merge_type}", stacklevel=2)
    return merge_knn(left, right, on, 1, **options)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their ``n_rows``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def merge_range(left: DataFrame, right: DataFrame, on: Keys = None, sim_threshold: float = 0.5, embedder: Embedder = Ngrams(), left_on: Keys = None, right_on: Keys = None, suffixes: tuple[str, str] = ("_x", "_y"), left_id: str | None = None, right_id: str | None = None, keep_row_ids: bool = False, sep: str = SEPARATOR, in_order: bool = False, ids_only: bool = False) -> DataFrame:
    """Every left row with all right rows of similarity >= the threshold; a left
    row without any is kept, with nulls. ``in_order`` sorts the result by the left
    row's id and then the right one's. ``ids_only`` gives the id columns, whose
    values are unique, and the score, and joins no others."""
    if not -1 <= sim_threshold <= 1:
        raise ValueError("a similarity is between -1 and 1")
    l, r = ([], []) if isinstance(embedder, Precomputed) else resolve_keys(left, right, on, left_on, right_on)
    a, b = with_row_ids(left, LEFT, left_id), with_row_ids(right, RIGHT, right_id)
    if ids_only:
        ids = _own_ids(left_id, right_id)
        if isinstance(embedder, Precomputed):
            found = similarity.dense(_vector_items(a, LEFT, embedder), _vector_items(b, RIGHT, embedder), None, sim_threshold, mode="outer")
        else:
            found = a.select(F.col(LEFT).alias("left_id")).join(matches(a, b, l, r, embedder, None, sim_threshold, sep=sep), "left_id", "left")
        out = _named_ids(found, ids, suffixes)
        return out.orderBy(*[col(c) for c in out.columns[:2]]) if in_order else out
    out = glue(matches(a, b, l, r, embedder, None, sim_threshold, sep=sep), a, b, suffixes, "left", keep_row_ids or in_order)
    if not in_order:
        return out
    ids = [f"id_lt{s}" for s in suffixes]
    out = out.orderBy(*[col(c) for c in ids])
    return out if keep_row_ids else out.drop(*ids)


def merge_blocking(left: DataFrame, right: DataFrame, on: Keys = None, blocking_vars: list[str] | None = None, embedder: Embedder = Ngrams(), left_on: Keys = None, right_on: Keys = None, suffixes: tuple[str, str] = ("_x", "_y"), left_id: str | None = None, right_id: str | None = None, keep_row_ids: bool = False, sep: str = SEPARATOR) -> DataFrame:
    """Every left row with its most similar right row of the same block. Rows of
    blocks that only one side has follow unmatched, under their plain names,
    with nulls elsewhere; rows with a null in a blocking column are dropped."""
    if not blocking_vars:
        return merge(left, right, on, embedder=embedder, left_on=left_on, right_on=right_on, suffixes=suffixes, left_id=left_id, right_id=right_id, keep_row_ids=keep_row_ids, sep=sep)
    for df in (left, right):
        missing = [c for c in blocking_vars if c not in df.columns]
        if missing:
            raise ValueError(f"blocking columns are missing: {missing}")
    l, r = ([], []) if isinstance(embedder, Precomputed) else resolve_keys(left, right, on, left_on, right_on)
    a, b = with_row_ids(left, LEFT, left_id), with_row_ids(right, RIGHT, right_id)
    matched = glue(matches(a, b, l, r, embedder, 1, None, blocking_vars, sep), a, b, suffixes, row_ids=keep_row_ids)
    own, other = left.dropna(subset=blocking_vars), right.dropna(subset=blocking_vars)
    left_only = own.join(other.select(*blocking_vars).distinct(), blocking_vars, "left_anti").select(*left.columns)
    right_only = other.join(own.select(*blocking_vars).distinct(), blocking_vars, "left_anti").select(*right.columns)
    return matched.unionByName(left_only, allowMissingColumns=True).unionByName(right_only, allowMissingColumns=True)


def aggregate_rows(df: DataFrame, ref_df: DataFrame, left_on: Keys, right_on: Keys, **options) -> DataFrame:
    """Each fine row with the reference row whose label is most similar."""
    return merge(df, ref_df, left_on=left_on, right_on=right_on, suffixes=("_x", "_y"), **options)


def evaluate_pairs(df: DataFrame, left_on: Keys, right_on: Keys, embedder: Embedder = Ngrams(), sep: str = SEPARATOR) -> DataFrame:
    """``df`` with ``score``, the cosine of two keys of the same row; null if a
    key is empty or a vector is zero. With precomputed vectors the keys are the
    two vector columns."""
    l, r = _listed(left_on), _listed(right_on)
    if isinstance(embedder, Precomputed):
        score = vectors.cosine(col(l[0]), col(r[0]))
    elif isinstance(embedder, Encoder):
        score = vectors.cosine(embedder.column(serialize(l, sep)), embedder.column(serialize(r, sep)))
    else:
        score = ngram_cosine(serialize(l, sep), serialize(r, sep), embedder.n)
    return df.withColumn("score", F.round(score, similarity.DIGITS))


def all_pair_combos_evaluate(df: DataFrame, left_on: str, right_on: str, embedder: Embedder = Ngrams()) -> DataFrame:
    """All left values with all right values of one table, and ``score``; every
    distinct value is embedded once."""
    a = df.select(col(left_on).alias("l"))
    b = df.select(col(right_on).alias("r"))
    values = df.select(col(left_on).alias("text")).union(df.select(col(right_on).alias("text"))).where("text is not null").distinct()
    items = values.select(F.col("text").alias("id"), F.lit("").alias("block"), "text")
    if isinstance(embedder, Encoder):
        items = stash(items.withColumn("v", embedder.column(F.col("text"))), "vectors")
        scores = similarity.dense(items, items)
    elif isinstance(embedder, Precomputed):
        raise ValueError("precomputed vectors belong to rows; use merge_knn or merge_range")
    else:
        scores = similarity.sparse(items, items, embedder.n, threshold=0.0)
    scores = scores.select(F.col("left_id").alias("l"), F.col("right_id").alias("r"), "score")
    # distinct values are paired and scored; the rows come last
    grid = a.distinct().crossJoin(b.distinct()).join(scores, ["l", "r"], "left")
    whole = a.alias("a").join(grid.alias("g"), F.col("a.l").eqNullSafe(F.col("g.l"))).select("g.*").alias("h").join(b.alias("b"), F.col("h.r").eqNullSafe(F.col("b.r"))).select("h.*")
    return whole.select(F.col("l").alias(left_on), F.col("r").alias(right_on if right_on != left_on else right_on + "_y"), "score")


def all_pair_dots(left: DataFrame, right: DataFrame, vector: str, left_id: str, right_id: str) -> DataFrame:
    """``left_id``, ``right_id`` and ``score``, the dot product of every left with
    every right vector."""
    a, b = (df.select(col(id).alias("id"), F.lit("").alias("block"), col(vector).alias("v")) for df, id in ((left, left_id), (right, right_id)))
    return similarity.dense(a, b, unit=False)


def block_counts(left: DataFrame, right: DataFrame, blocking_vars: list[str]) -> DataFrame:
    """One row: the number of blocks of either side and of those that both have.
    Rows with a null in a blocking column are in no block."""
    sides = [df.dropna(subset=blocking_vars).select(*[col(c) for c in blocking_vars]).distinct().withColumn(name, F.lit(1)) for df, name in ((left, "__l"), (right, "__r"))]
    both = sides[0].join(sides[1], blocking_vars, "full")
    return both.agg(F.count("__l").alias("n_left"), F.count("__r").alias("n_right"), F.count(F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), 1)).alias("n_both"))


def merge_edit(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_id: str, right_id: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Every left row with its right row of most edit similarity, the baseline
    for semantic merges: all distinct pairs of texts are compared. Left texts of
    more than 64 characters are compared inside the JVM."""
    a, b = with_row_ids(left, LEFT, left_id), with_row_ids(right, RIGHT, right_id)
    l = a.select(col(left_on).cast("string").alias("l")).where("l is not null").distinct()
    r = b.where(col(right_on).isNotNull()).groupBy(col(right_on).cast("string").alias("r")).agg(F.min(RIGHT).alias("right_id"))
    short = F.length("l") <= similarity.WORD
    best = similarity.edits(l.where(short), r).select(F.col("left_id").alias("l"), "right_id", "score")
    long = l.where(~short)
    if not long.isEmpty():
        score = F.round(edit_similarity(F.col("l"), F.col("r")), similarity.DIGITS)
        least = F.min(F.struct((-F.col("score")).alias("s"), "right_id")).alias("b")
        best = best.union(long.crossJoin(r).withColumn("score", score).groupBy("l").agg(least).select("l", "b.right_id", -F.col("b.s")))
    pairs = a.select(F.col(LEFT).alias("left_id"), col(left_on).cast("string").alias("l")).join(best, "l").select("left_id", "right_id", "score")
    return glue(pairs, a, b, suffixes)
