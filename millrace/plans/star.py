"""Star joins with eager aggregation: the fact table is aggregated by its foreign key before the join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def star_aggregate(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, group: list[str], sums: dict[str, str], count: str = "n"
) -> DataFrame:
    """COUNT(*) and SUM(column) by `group` columns of the dimension.

    `sums` maps a fact column to its output name. The shuffle carries one row
    for each foreign key and task instead of each fact row. Duplicate dimension
    keys are right as well, since a partial row joins each of them.
    """
    partial = fact.groupBy(fact_key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{o}") for c, o in sums.items()])
    joined = partial.join(dim, partial[fact_key] == dim[dim_key])
    return joined.groupBy(*group).agg(F.sum("_n").alias(count), *[F.sum(f"_s_{o}").alias(o) for o in sums.values()])


def join_star_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ'1995-01-01 00:00:00'")
    fact = fact.select("l_partkey", F.col("l_quantity").cast("bigint").alias("qty"))
    dim = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    out = star_aggregate(fact, dim, "l_partkey", "p_partkey", ["p_brand"], {"qty": "sum_qty"})
    return out.filter("n > 10").orderBy(F.desc("n"), "p_brand").limit(20)


ORACLE_STAR = """
SELECT p_brand, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'
GROUP BY p_brand HAVING count(*) > 10 ORDER BY n DESC, p_brand LIMIT 20
"""
