"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is a hash of its text, so equal texts start on the
same shard. Each shard has VIRTUAL points on the ring and takes the arc before
each of them. Loads are bounded by a capacity for each shard; with the default
(`slack` 0) capacities add up to the number of rows and differ by one at most, so the law `rows` holds
exactly: counts at most one apart. What overflows a full shard continues clockwise to the next point whose shard
has room; all else stays where the ring puts it.

How many rows each arc passes on is planned on the driver from one count for each arc
(shards * VIRTUAL numbers, whatever the input). Rows get their rank within an arc
without gathering an arc in one task: they are written once, dealt by range of (place, hash, doc_id, a random tie), and a row's number
in its file plus one offset for each file and arc is its rank.

Defined results: a null text counts as no bytes (size 8, CRC of nothing); a null doc_id comes first
among equal texts; repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 24
VIRTUAL = 64
SEED = 7
#: Places on the ring: a row's place is the top bits of its text's hash.
PLACES = 1 << 14


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard), sorted: a point's place is a hash of the shard's and the virtual node's number.

    A last point past the ring's end stands for the first one, so that the arc before it needs no special case.
    """
    points = []
    for s in range(shards):
        for v in range(virtual):
            h = hashlib.blake2b(f"shard {s} point {v}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(h, "little") % PLACES, s))
    points.sort()
    return [*points, (PLACES, points[0][1])]


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(points: list[tuple[int, int]], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of each arc go to which shard: (arc, first rank, rank after the last, shard, slot of the first).

    Each arc first fills its own shard, in ring order; overflow then continues clockwise, the arc's last ranks first come on.
    """
    room, used = list(room), [0] * len(room)
    out, over = [], []
    for arc, n in enumerate(counts):
        shard = points[arc][1]
        take = min(n, room[shard])
        if take:
            out.append((arc, 0, take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
        if n > take:
            over.append((arc, take, n))
    for arc, low, high in over:
        at = arc
        for _ in range(len(points)):
            at = (at + 1) % len(points)
            shard = points[at][1]
            take = min(high - low, room[shard])
            if take:
                out.append((arc, low, low + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                low += take
            if low == high:
                break
        if low < high:
            raise ValueError("capacities are below the number of rows")
    return sorted(out)


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home_shard) for every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    points = ring(shards, virtual)
    edges = [p for p, _ in points]
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    ).withColumn("place", F.shiftrightunsigned("hash", 65 - PLACES.bit_length()).cast("int"))
    # Rows that only `tie` tells apart (repeated ones, or equal texts without an id) may have any order, but not one task. It is written with the rows.
    thin = thin.withColumn("tie", F.rand(SEED))
    order = ["place", "hash", "doc_id", "tie"]
    rows = written(thin.repartitionByRange(*order).sortWithinPartitions(*order), "ring")
    arcs = F.broadcast(spark.createDataFrame([(p, arc_of(p, edges)) for p in range(PLACES)], "place int, arc int"))
    placed = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).join(arcs, "place")
    # One row for each file and arc it has: files are ranges of the ring, so files + arcs at most.
    first = F.min(F.struct("place", "hash", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "tie"))
    parts = placed.groupBy("file", "arc").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"), first.alias("low")).collect()
    parts.sort(key=lambda p: (p["arc"], tuple(p["low"]), p["file"]))
    counts, offsets = [0] * len(points), []
    for p in parts:
        offsets.append((p["file"], p["arc"], counts[p["arc"]] - p["first"]))
        counts[p["arc"]] += p["n"]
    segments = plan(points, counts, capacities(sum(counts), shards, slack))
    homes = [s for _, s in points]
    by_arc: dict[int, list] = {}
    for a, low, high, shard, slot in segments:
        by_arc.setdefault(a, []).append((low, high, shard, slot))
    plans = [(f, a, o, homes[a], by_arc[a]) for f, a, o in offsets]
    schema = "file string, arc int, shift long, home_shard int, segments array<struct<low: long, high: long, shard: int, slot: long>>"
    planned = F.broadcast(spark.createDataFrame(plans, schema))
    ranked = placed.join(planned, ["file", "arc"]).withColumn("rank", F.col("row") + F.col("shift"))
    mine = F.filter("segments", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    return ranked.withColumn("mine", mine).select(
        "doc_id", "size", "text_crc32", F.col("mine.shard").alias("shard"), (F.col("mine.slot") + F.col("rank") - F.col("mine.low")).alias("slot"), "home_shard"
    )


def arc_of(place: int, edges: list[int]) -> int:
    """The number of the first point at or after a place."""
    return bisect.bisect_left(edges, place)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
