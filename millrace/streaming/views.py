"""Materialised and incrementally maintained views, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, written


@dataclass
class MaterialisedView:
    """A stored result that is stale until refreshed."""

    source: Callable[[], DataFrame]
    result: DataFrame | None = None

    def refresh(self) -> None:
        self.result = written(self.source(), "matview")

    def read(self) -> DataFrame:
        if self.result is None:
            self.refresh()
        return self.result


@dataclass
class IncrementalView:
    """COUNT(*) and SUMs by group of one table with an optional filter, kept up to date from signed changes.

    A change batch has the table's columns and `_sign`: +1 for a row that came, -1 for one that went. The state
    is one row for each group; a group whose count falls to zero goes. Only the batch and the state are read, never the table.
    """

    spark: SparkSession
    group: list[str]
    sums: dict[str, str]
    where: str | None = None
    count: str = "n"
    state: DataFrame | None = None
    applied: set[int] = field(default_factory=set)

    def delta(self, batch: DataFrame) -> DataFrame:
        rows = batch.filter(self.where) if self.where else batch
        return rows.groupBy(*self.group).agg(F.sum("_sign").cast("bigint").alias(self.count), *[F.sum(F.col(c) * F.col("_sign")).cast("bigint").alias(o) for c, o in self.sums.items()])

    def apply(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Merges a batch, once for each batch_id, and returns the changes of the view: (_op, group, values)."""
        names = [*self.group, self.count, *self.sums.values()]
        if batch_id is not None and batch_id in self.applied:
            return self.state.limit(0).withColumn("_op", F.lit("PUT"))
        change = written(self.delta(batch), "ivm_delta")
        old = self.state if self.state is not None else change.limit(0)
        both = old.unionByName(change).groupBy(*self.group).agg(*[F.sum(c).cast("bigint").alias(c) for c in names[len(self.group) :]])
        self.state = written(both.filter(F.col(self.count) != 0), "ivm_state")
        if batch_id is not None:
            self.applied.add(batch_id)
        keys = change.select(*self.group).distinct()
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in self.group]
        found = keys.alias("k").join(self.state.alias("s"), same, "left")
        live = F.col(f"s.{self.count}").isNotNull()
        return found.select(F.when(live, "PUT").otherwise("DELETE").alias("_op"), *[F.col(f"k.{c}").alias(c) for c in self.group], *[F.col(f"s.{c}").alias(c) for c in names[len(self.group) :]])

    def read(self) -> DataFrame:
        return self.state

    def follow(self, stream: DataFrame):
        """Maintains the view from a streaming DataFrame of change batches; a repeated batch id is not applied twice."""
        return (
            stream.writeStream.foreachBatch(lambda df, batch_id: self.apply(df, batch_id) and None)
            .option("checkpointLocation", new_path(self.spark, "ivm_checkpoint"))
            .trigger(availableNow=True)
            .start()
        )


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time tumbling counts with a watermark, for streams and batches alike."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
