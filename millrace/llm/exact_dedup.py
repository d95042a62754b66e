"""Exact deduplication against a persistent digest index.

The index is a set of runs (digest, keep_id, group_size), each bucketed and sorted by
digest. New data is digested, reduced to one row per digest by a partial
aggregation, held against every run by a sort-merge anti-join on the bucket key
(a run is read as it lies, without a shuffle), and what is new is
appended as another sorted run. What is known adds to its group by a run of additions. Above RUNS runs all are merged into one.

The query and the pipeline's stage load their rows in BATCHES, so that all but the first meet an index that holds a part.

Defined results: null text counts as empty; a null doc_id never wins against a
doc_id; repeated rows count as members of their group, and of several rows with
the smallest doc_id each is marked kept in `annotate` (they cannot be told
apart), while `dedup` keeps one of them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Files
from .common import free, new_path, table, without, written

#: At most this many groups can have more than 1/HOT_SHARES of all rows, so a broadcast of them is bounded.
HOT_SHARES = 1000
#: Parts that a table is loaded in.
BATCHES = 2
#: Runs that an index holds at most before they are merged.
RUNS = 8


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; runs that are one space already are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][ \t-\r]*+|\x20[ \t-\r]++", " ")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


class DigestIndex:
    """A persistent index of digests below a folder: runs, each a Parquet table with the same buckets, sorted by digest.

    A run of new digests is called run, a run that adds to known ones more. Opening a folder that has runs registers them
    again, so that the index outlives the session that wrote it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = folder or new_path(spark, "digest_index")
        self.files = Files(spark, self.folder)
        self.name = "digest_index_" + hashlib.sha256(self.folder.encode()).hexdigest()[:16]
        found = [n for n in self.files.names("") if n.split("_")[0] in ("run", "more") and self.files.names(f"{n}/_SUCCESS")]
        merged = max((n.split("_")[1] for n in found if n.startswith("run") and n.endswith("_merged")), default="")
        found = [n for n in found if n.split("_")[1] >= merged]
        self.buckets = int(found[0].split("_")[2]) if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.next = 1 + max((int(n.split("_")[1]) for n in found), default=-1)
        self.runs, self.more = ([n for n in found if n.startswith(kind)] for kind in ("run", "more"))
        for n in found:
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._table(n)} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{n}'"
            )

    def _table(self, run: str) -> str:
        return f"{self.name}_{run}"

    def _read(self, runs: list[str]) -> DataFrame:
        """Runs as plain files: a union of bucketed tables may be taken for partitioned by their buckets, which it is not."""
        schema = "digest string, keep_id bigint, group_size bigint"
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size): one row for each digest, over all that was ever appended."""
        if not self.more:
            return self._read(self.runs)
        return self._read(self.runs + self.more).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest no run holds: one sort-merge anti-join for each run."""
        for run in self.runs:
            groups = groups.join(self.spark.table(self._table(run)).hint("merge"), "digest", "left_anti")
        return groups

    def _write(self, groups: DataFrame, kind: str, end: str = "") -> str:
        run = f"{kind}_{self.next:06d}_{self.buckets}{end}"
        out = groups.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
        out.option("path", f"{self.folder}/{run}").saveAsTable(self._table(run))
        return run

    def append(self, groups: DataFrame) -> None:
        """Adds groups (one row for each digest): new digests as a run, additions to known ones as a run beside it."""
        run = self._write(self.fresh(groups), "run")
        known = groups.join(self.spark.table(self._table(run)).hint("merge"), "digest", "left_anti")
        if self.runs:
            self.more.append(self._write(known, "more"))
        self.runs.append(run)
        self.next += 1
        if len(self.runs) > RUNS:
            self.merge()

    def merge(self) -> None:
        """All runs as one. The old ones' files stay for their readers; an index opened later begins at the merged run."""
        run = self._write(self.read(), "run", "_merged")
        self.close()
        self.__init__(self.spark, self.folder)
        assert self.runs == [run]

    def close(self) -> None:
        """Takes the runs out of the session's catalog; the files stay."""
        for run in self.runs + self.more:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        self.runs, self.more = [], []


def groups_of(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _with_groups(digests: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with its group. Groups above a bounded share of the rows are joined by a broadcast of at most
    HOT_SHARES rows, so that no task gets all rows of one; the others by an ordinary join."""
    n = digests.count()
    hot = F.broadcast(groups.filter(F.col("group_size") > F.lit(max(n // HOT_SHARES, 1))))
    rest = groups.filter(F.col("group_size") <= F.lit(max(n // HOT_SHARES, 1)))
    return digests.join(hot, "digest").unionByName(digests.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest"))


def load(digests: DataFrame, index: DigestIndex, batches: int = BATCHES) -> None:
    """Appends the groups of rows (doc_id, digest) to an index, batch by batch."""
    for i in range(batches):
        part = digests.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i) if batches > 1 else digests
        index.append(groups_of(part))


def annotate(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    `index`, if given, is appended to, and groups count its earlier rows as well.
    """
    digests = written(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    load(digests, index, batches)
    found = index.read()
    groups = written(found if own else found.join(digests.select("digest").distinct(), "digest", "left_semi"), "digest_groups")
    if own:
        index.close()
    return _with_groups(digests, groups).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """The rows that stay, with all their columns: of each group of equal texts one row with the smallest doc_id.

    Rows that repeat a kept doc_id with an equal text are dropped as well: one of them stays. docs is read once, and its
    numbered rows are written; a second numbering could name other rows, as it depends on how Spark packs the files.
    With an index that holds earlier rows, texts that it has from a smaller doc_id are dropped.
    """
    row, name = free(docs, "row"), free(docs, "digest")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(name, digest(F.col("text"))), "dedup_rows", "zstd")
    thin = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("digest"))
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    load(thin.select("doc_id", "digest"), index, batches)
    groups = written(index.read(), "digest_groups")
    if own:
        index.close()
    firsts = _with_groups(thin, groups).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("row").alias("row"))
    gone = thin.select("row").join(written(firsts.select("row"), "dedup_firsts"), "row", "left_anti").select(F.col("row").alias(row))
    return without(rows, gone, row).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(table(spark, sf_dir, "documents"))


ORACLE_OP8 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
