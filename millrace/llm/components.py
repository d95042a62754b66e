"""Connected components of a graph that lives in a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a, b) edges of longs, a != b, to (node, component): the smallest node reachable.

    Alternating large-star and small-star steps. Each is one partial aggregation
    to a minimum for each node and one join of the edges with it, so a node with
    very many links is never gathered into one task (the join is of the kind
    that adaptive execution splits). Every round is written to the shared folder. An isolated node has no row.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = _signature(edges)
    if before[0]:
        for _ in range(most_rounds):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
            small_least = large.groupBy("a").agg(F.min("b").alias("m"))
            joined = large.join(small_least, "a")
            small = (
                joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .unionByName(small_least.select("a", F.col("m").alias("b")))
                .distinct()
            )
            edges = written(small, "edges")
            after = _signature(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
