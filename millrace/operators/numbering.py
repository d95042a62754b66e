"""Gapless numbers in an order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """df with a column `name`: start, start + 1, ... in the order of the columns.

    Rows are written once, dealt by range and sorted; a row's number in its file plus one offset for each file
    (driver state: as many numbers as files) is its number.
    """
    spark = df.sparkSession
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order), "numbered")
    low = F.struct(*[F.struct(F.col(c).isNotNull().alias("there"), F.col(c).alias("value")) for c in order])
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_file").agg(F.min(low).alias("low"), F.count(F.lit(1)).alias("n")).orderBy("low", "_file").select("_file", "n").collect()
    shifts, at = [], start
    for f in files:
        shifts.append((f["_file"], at))
        at += f["n"]
    planned = F.broadcast(spark.createDataFrame(shifts, "_file string, _shift long"))
    return placed.join(planned, "_file").withColumn(name, F.col("_row") + F.col("_shift")).select(*df.columns, name)
