"""Base tables: Parquet below one directory, registered as temporary views on demand."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str, **frames: DataFrame) -> DataFrame:
    """Runs a query over the base tables that it names, and over `frames` by their names."""
    for name in set(_NAMES.findall(query)) - set(frames):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)
