"""What the operators of this subpackage share: tables, the shared folder, written intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, shared_dir, ship
from ..sources.tables import table

__all__ = ["free", "give_back", "map_arrow", "new_path", "shared_dir", "slices", "table", "without", "written"]

#: Numbers that `without` broadcasts at most.
GONE = 500_000


def written(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key (a long) is in `gone`: by a broadcast of at most GONE numbers, beyond that by a shuffle."""
    listed = written(gone, "gone")
    few = listed.count() <= GONE
    return df.join(F.broadcast(listed) if few else listed, key, "left_anti")


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, compared without case: the name itself, or with underscores in front."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with the package's code at hand on every executor; a task that ends gives its memory back."""
    ship(df.sparkSession)

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns freed memory to the system. Workers are reused, and an idle one shares its executor's memory with the stages that follow."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def slices(batch, column: int, most_bytes: int = 4 << 20):
    """The record batch in parts whose values in `column` take about most_bytes at most, but one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to
