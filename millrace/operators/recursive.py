"""Recursive queries. UNION ALL is Spark's own WITH RECURSIVE; UNION (each row once, so that cycles end) is a fixpoint here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import written
from ..sources.tables import sql


class EmptyBase(ValueError):
    """The base term of a recursive query has no rows."""


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 10_000, fold: int = 16) -> DataFrame:
    """All rows reachable from base by step, each once. Every round reads the newest rows only and is written, which cuts lineage."""
    newest = written(base.distinct(), "recursion")
    if not newest.take(1):
        raise EmptyBase("the base term is empty")
    parts = [newest]
    for _ in range(most_rounds):
        found = step(newest).select(*base.columns).distinct()
        for part in parts:
            found = found.exceptAll(part)
        newest = written(found, "recursion")
        if not newest.take(1):
            break
        parts.append(newest)
        if len(parts) > fold:
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            parts = [written(whole, "recursion")]
    else:
        raise RuntimeError("the recursion did not end")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan_cte_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n FROM s")


ORACLE_RECURSIVE = "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n FROM s"

_EDGES = "SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION ALL SELECT 3 AS a, 7 AS b UNION ALL SELECT 7 AS a, 3 AS b"


def scan_cte_recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes reachable from 3 over edges with cycles."""
    edges = sql(spark, sf_dir, _EDGES)
    base = spark.sql("SELECT 3 AS node")
    return fixpoint(base, lambda new: new.join(edges, new.node == edges.a).select(edges.b.alias("node")))


ORACLE_RECURSIVE_UNION = f"""
WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT CAST(3 AS INT) UNION SELECT CAST(e.b AS INT) FROM r JOIN e ON e.a = r.node) SELECT node FROM r
"""
