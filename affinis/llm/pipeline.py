"""The corpus pipeline: from raw documents to token ids with their training order.

Every stage but the last takes and returns documents, with all their columns; it
works on all that the stage before it kept. The mixing stage repeats a document
as often as it is read; the last one encodes it once and gives all its places in
the order of training. A document of null text passes every stage and has null
tokens; one of null id or source is treated like any other, as each operator's
docstring says; repeated rows become one in exact dedup; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, exact_dedup, mixing, near_dedup, quality
from .shared import col, stash, table


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in docs.columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model)
    return _columns(scored.where(col(scored.columns[-1])), docs)  # its name, if documents has a column "kept", is another


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.exact_dedup(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.near_dedup(docs)


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of training, as often as they are read."""
    return _columns(mixing.mix_sources(docs), docs)


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``, which grows with the order in which the rows
    were written: by the part's number, then by the row's place in its file. A
    read by itself gives files in another order. Rows that come from no file are
    taken as they stand."""
    plain = docs.select("doc_id", "lang", "source", "text")
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "lang", "source", "text", meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    except AnalysisException:
        return plain.withColumn("position", F.monotonically_increasing_id())
    name = F.element_at(F.split("file", "/"), -1)
    part, piece = (F.regexp_extract(name, r"^part-(\d+)-.*?(?:-c(\d+))?\.", k) for k in (1, 2))
    number = [F.coalesce(x.try_cast("long"), F.lit(0)) for x in (part, piece)]
    files = rows.groupBy("file").agg((F.max("row") + 1).alias("n"))
    before = Window.orderBy(*number, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    # one row a file: less than the driver holds of the files already
    return rows.join(F.broadcast(files), "file").select("doc_id", "lang", "source", "text", (F.col("skip") + F.col("row")).alias("position"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, encoded once however often it is read, and
    ``positions``, its places in the order of training: the one at index e is
    that of epoch e. A reader explodes and sorts by them, as rows of a table
    have no order. Rows alike in id, language, source and text are one document."""
    one = _placed(docs).groupBy("doc_id", "lang", "source", "text").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    return bpe.bpe_encode(one, keep=["doc_id", "lang", "source", "positions"])


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_texts),
    ("near dedup", distinct_documents),
    ("mixing", in_training_order),
    ("BPE", token_ids),
]

#: Nearest neighbours, sketches and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
