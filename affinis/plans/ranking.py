"""Dense numbers in key order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stash


def dense_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys`` and their number, from 0 in ascending order (nulls first), one
    row a distinct key. Range partitions are numbered apart and then shifted."""
    keyed = df.select(*keys).distinct().repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    placed = stash(keyed, "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = placed.groupBy("_part").count().withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return placed.withColumn("_nth", nth).join(F.broadcast(shifts), "_part").select(*keys, (F.col("_nth") - 1 + F.col("_shift")).cast("long").alias(name))
