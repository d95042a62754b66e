"""Turns pairs of SQL texts into registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import sql


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql(spark, sf_dir, text)

    return run


def registered(pairs: dict[str, tuple[str, str | None]]) -> tuple[dict[str, Callable], dict[str, str]]:
    return {k: query(s) for k, (s, _) in pairs.items()}, {k: d or s for k, (s, d) in pairs.items()}
