"""Readers by path suffix, and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, source: str | DataFrame, schema: str | None = None) -> DataFrame:
    """A table from a DataFrame, or a path ending in .csv, .json, .jsonl,
    .parquet or .xlsx. CSV fields may hold line breaks and quotes. With a
    ``schema`` a CSV or JSON file is read once, without a pass to infer types."""
    if isinstance(source, DataFrame):
        return source
    kind = source.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(source)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(source, header=True, inferSchema=schema is None, multiLine=True, quote='"', escape='"')
    if kind in ("json", "jsonl"):
        return reader.json(source, multiLine=kind == "json")
    if kind == "xlsx":
        return _excel(spark, source)
    raise ValueError(f"no reader for {source}: use csv, json, jsonl, parquet or xlsx")


def _excel(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    try:
        import openpyxl  # noqa: F401
    except ModuleNotFoundError as missing:
        raise ValueError(f"reading {path} needs the package openpyxl") from missing
    found = pd.read_excel(path)
    return spark.createDataFrame(found.astype(object).where(found.notna(), None))


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write as the suffix says: .csv, .jsonl or .parquet."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        df.write.mode(mode).csv(path, header=True, quote='"', escape='"')
    elif kind in ("json", "jsonl"):
        df.write.mode(mode).json(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no writer for {path}: use csv, jsonl or parquet")


def write_splits(data: DataFrame, path: str, mode: str = "error") -> None:
    """Prepared data, one folder a split."""
    data.write.mode(mode).partitionBy("split").parquet(path)


def write_label_map(labels: dict[str, int], path: str) -> None:
    with open(path, "w") as file:
        json.dump(labels, file, ensure_ascii=False, sort_keys=True)


def read_label_map(path: str) -> dict[str, int]:
    with open(path) as file:
        return json.load(file)


def sample_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Small tables to try the operators on: two lists of firms, and products
    with their kinds."""
    return {
        "firms_a": spark.createDataFrame([(1, "Harbour Shipping Co", "NO"), (2, "Miller & Sons Bakery", "GB"), (3, "Lindqvist Papper AB", "SE"), (4, "Cafe Azul", "ES")], "id int, firm string, country string"),
        "firms_b": spark.createDataFrame([(101, "Harbour Shipping Company", "NO"), (102, "Miller and Sons Bakery Ltd", "GB"), (103, "Lindqvist Papper", "SE"), (104, "Nordic Timber", "FI")], "number int, company string, land string"),
        "products": spark.createDataFrame([("oak table", "furniture"), ("pine chair", "furniture"), ("rye bread", "food"), ("goat cheese", "food")], "product string, kind string"),
    }


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Some ``n`` rows to look at."""
    return df.limit(n)
