"""Linkage of streams: rows as they come against a fixed reference, and removal
of repeated keys under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.text import SEPARATOR, serialize
from ..operators.linkage import Keys, _listed, merge_knn


def start(stream: DataFrame, reference: DataFrame, path: str, checkpoint: str, on: Keys = None, **options):
    """A running query that matches every batch with the reference like any
    table (``merge_knn``) and writes it as Parquet below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own folder
        merge_knn(batch, reference, on, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exact_match(stream: DataFrame, reference: DataFrame, left_on: Keys, right_on: Keys, sep: str = SEPARATOR) -> DataFrame:
    """A stateless stream-static join on equal keys in lower case."""
    a = stream.withColumn("__key", F.lower(serialize(_listed(left_on), sep)))
    first = Window.partitionBy("__key").orderBy(*[col(c) for c in reference.columns])
    b = reference.withColumn("__key", F.lower(serialize(_listed(right_on), sep))).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return a.join(b, "__key", "left").drop("__key")


def drop_repeats(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; a key is forgotten ``delay`` after its time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
