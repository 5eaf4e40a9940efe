"""Training data for linkage and classification, as relational pipelines.

Splits go by a hash of the key: the same row is always on the same side,
whatever the partitions, and shares are met in expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col, quoted
from ..functions.text import SEPARATOR, lower_strings, serialize
from ..plans.ranking import dense_ids
from ..plans.storage import stash
from .graph import connected_components


def _check(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")


def split_of(key: Column, train: float = 0.8, val: float = 0.1, seed: int = 22) -> Column:
    """``train``, ``val`` or ``test`` by a hash of the key."""
    if train < 0 or val < 0 or train + val > 1:
        raise ValueError("shares are at least 0 and add up to at most 1")
    digest = F.md5(F.concat_ws("#", F.lit(str(seed)), key.cast("string")))
    place = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return F.when(place < round(10_000 * train), "train").when(place < round(10_000 * (train + val)), "val").otherwise("test")


def group_numbers(df: DataFrame, columns: list[str], name: str = "group") -> DataFrame:
    """``df`` with the dense number of each row's key in key order."""
    _check(df, columns)
    keyed = df
    match = [F.col(f"l.{quoted(c)}").eqNullSafe(F.col(f"r.{quoted(c)}")) for c in columns]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return keyed.alias("l").join(dense_ids(df, columns, name).alias("r"), condition).select("l.*", f"r.{quoted(name)}")


def prepare_pairs(df: DataFrame, left_on: list[str], right_on: list[str], left_id: list[str] | None = None, right_id: list[str] | None = None, label: str | None = None, sep: str = SEPARATOR) -> DataFrame:
    """``left_id``, ``right_id`` (numbers of the id or key columns, with suffixes
    ``_l`` and ``_r``), ``left_text``, ``right_text`` and the label, if any. Rows
    whose keys are all null on a side, or with a null id, are dropped; of rows
    with the same keys the one of least id stays."""
    l_id, r_id = left_id or left_on, right_id or right_on
    _check(df, [*left_on, *right_on, *l_id, *r_id, *([label] if label else [])])
    rows = df.dropna(how="all", subset=left_on).dropna(how="all", subset=right_on)
    if left_id:
        rows = rows.dropna(how="any", subset=left_id)
    if right_id:
        rows = rows.dropna(how="any", subset=right_id)
    named = rows.select(
        serialize(left_on, sep).alias("left_text"), serialize(right_on, sep).alias("right_text"),
        serialize(l_id, "\x1f").alias("l"), serialize(r_id, "\x1f").alias("r"), *([col(label).alias("label")] if label else []),
    )
    first = Window.partitionBy("left_text", "right_text").orderBy("l", "r", *(["label"] if label else []))
    one = stash(named.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"), "pairs")
    numbered = one.join(dense_ids(one, ["l"], "ln"), "l").join(dense_ids(one, ["r"], "rn"), "r")
    return numbered.select(F.concat(F.col("ln").cast("string"), F.lit("_l")).alias("left_id"), F.concat(F.col("rn").cast("string"), F.lit("_r")).alias("right_id"), "left_text", "right_text", *(["label"] if label else []))


def prepare_clusters(df: DataFrame, on: list[str], cluster: list[str], sep: str = SEPARATOR) -> DataFrame:
    """``cluster_assignment`` (a number with suffix ``_g``) and ``text``; rows with
    all keys null or a null cluster are dropped, repeated ones stay once."""
    _check(df, [*on, *cluster])
    rows = df.dropna(how="all", subset=on).dropna(how="any", subset=cluster)
    named = stash(rows.select(serialize(on, sep).alias("text"), serialize(cluster, "\x1f").alias("c")).distinct(), "clusters")
    return named.join(dense_ids(named, ["c"], "n"), "c").select(F.concat(F.col("n").cast("string"), F.lit("_g")).alias("cluster_assignment"), "text")


def cluster_texts(df: DataFrame, cluster: str, text: str) -> DataFrame:
    """``cluster`` and its distinct ``texts``, sorted."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.sort_array(F.collect_set(text)).alias("texts"))


def paired_label_data(pairs: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 22) -> DataFrame:
    """Prepared pairs with their ``split``, by row."""
    return pairs.withColumn("split", split_of(F.concat_ws("|", "left_id", "right_id"), train, val, seed))


def positive_clusters(pairs: DataFrame) -> DataFrame:
    """``cluster`` and ``texts`` of the components of positive pairs."""
    positive = pairs.where("label = 1") if "label" in pairs.columns else pairs
    found = connected_components(positive, "left_id", "right_id")
    texts = positive.select(F.col("left_id").alias("node"), F.col("left_text").alias("text")).union(positive.select("right_id", "right_text"))
    named = texts.join(found, "node")
    return cluster_texts(named.join(dense_ids(found, ["component"], "n"), "component"), "n", "text")


def linkage_data(pairs: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 22, large_val: bool = False) -> dict[str, DataFrame]:
    """From prepared positive pairs: ``train`` (cluster, texts), and ``queries``
    (split, qid, text), ``corpus`` (split, cid, text), ``relevant`` (split, qid,
    cid) for the rest. Whole components go to one split, so nothing leaks. With
    ``large_val`` the training right sides join every corpus, ids ending in
    ``_train``."""
    positive = pairs.where("label = 1") if "label" in pairs.columns else pairs
    found = connected_components(positive, "left_id", "right_id")
    marked = stash(positive.join(found.withColumnRenamed("node", "left_id"), "left_id").withColumn("split", split_of(F.col("component"), train, val, seed)), "split-pairs")
    numbers = dense_ids(marked, ["component"], "n")
    training = marked.where("split = 'train'")
    texts = training.select("component", F.col("left_text").alias("text")).union(training.select("component", "right_text"))
    rest = marked.where("split <> 'train'")
    corpus = rest.select("split", F.col("right_id").alias("cid"), F.col("right_text").alias("text")).distinct()
    if large_val:
        extra = training.select(F.concat("right_id", F.lit("_train")).alias("cid"), F.col("right_text").alias("text")).distinct()
        both = rest.select("split").distinct()
        corpus = corpus.union(both.crossJoin(extra))
    return {
        "train": cluster_texts(texts.join(numbers, "component"), "n", "text"),
        "queries": rest.select("split", F.col("left_id").alias("qid"), F.col("left_text").alias("text")).distinct(),
        "corpus": corpus,
        "relevant": rest.select("split", F.col("left_id").alias("qid"), F.col("right_id").alias("cid")).distinct(),
    }


def cluster_data(clusters: DataFrame, train: float = 0.8, val: float = 0.1, query_share: float = 0.5, seed: int = 22, large_val: bool = False) -> dict[str, DataFrame]:
    """From prepared clusters: ``train`` (cluster, texts) and, for the clusters
    of the other splits, the first texts (by order, the share rounded down) as
    ``queries`` and the rest as ``corpus``, with ``relevant`` pairs. Whole
    clusters go to one split."""
    marked = stash(clusters.withColumn("split", split_of(F.col("cluster_assignment"), train, val, seed)), "split-clusters")
    own = Window.partitionBy("cluster_assignment")
    rest = marked.where("split <> 'train'").withColumn("i", F.row_number().over(own.orderBy("text")) - 1).withColumn("n", F.count("*").over(own))
    asked = F.col("i") < F.floor(F.col("n") * query_share)
    queries = rest.where(asked).select("split", F.concat("cluster_assignment", F.col("i").cast("string")).alias("qid"), "text", "cluster_assignment")
    corpus = rest.where(~asked).select("split", F.concat("cluster_assignment", F.col("i").cast("string"), F.lit("c")).alias("cid"), "text", "cluster_assignment")
    relevant = queries.join(corpus.select("cid", "cluster_assignment"), "cluster_assignment").select("split", "qid", "cid")
    corpus = corpus.drop("cluster_assignment")
    if large_val:
        nth = F.row_number().over(own.orderBy("text")) - 1
        extra = marked.where("split = 'train'").select(F.concat("cluster_assignment", nth.cast("string"), F.lit("ct")).alias("cid"), "text")
        corpus = corpus.union(rest.select("split").distinct().crossJoin(extra))
    return {"train": cluster_texts(marked.where("split = 'train'"), "cluster_assignment", "text"), "queries": queries.drop("cluster_assignment"), "corpus": corpus, "relevant": relevant}


def preprocess(df: DataFrame, left_on: list[str] | None = None, right_on: list[str] | None = None, left_id: list[str] | None = None, right_id: list[str] | None = None, label: str | None = None, on: list[str] | None = None, cluster: list[str] | None = None, **options) -> dict[str, DataFrame]:
    """The preparation that the arguments call for: labelled pairs, clusters, or
    positive pairs."""
    if cluster:
        if label or left_on or right_on:
            raise ValueError("clusters exclude pairs and labels")
        return cluster_data(prepare_clusters(df, on or [c for c in df.columns if c not in cluster], cluster), **options)
    if not left_on or not right_on:
        raise ValueError("pairs need keys of both sides")
    pairs = prepare_pairs(df, left_on, right_on, left_id, right_id, label)
    return {"pairs": paired_label_data(pairs, **options)} if label else linkage_data(pairs, **options)


def label_numbers(df: DataFrame, label: str) -> DataFrame:
    """``label`` and ``number``, from 0 in alphabetical order, of a training set;
    to be joined to every split, so numbers agree."""
    return dense_ids(df.dropna(subset=[label]).select(col(label).cast("string").alias(label)), [label], "number")


def classification_data(df: DataFrame, on: list[str], label: str, train: float = 0.8, val: float = 0.1, seed: int = 22) -> DataFrame:
    """``text``, ``label``, ``number``, ``split``; labels are numbered on the
    training split, and a label unknown there has no number. Rows with a null
    label or a null key are dropped."""
    _check(df, [*on, label])
    rows = df.dropna(subset=[*on, label]).select(serialize(on).alias("text"), col(label).cast("string").alias("label"))
    rows = rows.withColumn("split", split_of(F.col("text"), train, val, seed))
    return rows.join(label_numbers(rows.where("split = 'train'"), "label"), "label", "left").select("text", "label", "number", "split")


def pair_rows(clusters: DataFrame) -> DataFrame:
    """All (text, label) of clusters with their ``texts``: individuals for a
    supervised contrastive loss."""
    return clusters.select(F.explode("texts").alias("text"), F.col("cluster").alias("label"))


def contrastive_labels(df: DataFrame, label: str) -> DataFrame:
    """``same``/``1`` as 1 and ``different``/``0`` as 0; another label is null."""
    text = F.lower(col(label).cast("string"))
    return df.withColumn(label, F.when(text.isin("same", "1"), 1).when(text.isin("different", "0"), 0))


def tariff_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without nulls in the columns, strings in lower case, each once."""
    _check(df, columns)
    return lower_strings(df.select(*columns).dropna()).distinct()


def assemble_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, id: str = "id") -> DataFrame:
    """A table of id pairs with both tables' columns, as ``ltable_`` and ``rtable_``."""
    a = left.select(*[col(c).alias(left_key if c == id else f"ltable_{c}") for c in left.columns])
    b = right.select(*[col(c).alias(right_key if c == id else f"rtable_{c}") for c in right.columns])
    return pairs.join(a, left_key, "left").join(b, right_key, "left")


def unpivot_aliases(df: DataFrame, id: str, columns: list[str], name: str = "name") -> DataFrame:
    """(id, alias_id, name): one row for each alias that is not null."""
    aliases = F.array(*[col(c).cast("string") for c in columns])
    return df.select(col(id), F.posexplode(aliases).alias("alias_id", name)).where(F.col(name).isNotNull())


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if not c.startswith(prefix)])
