"""Vector search, full-text ranking and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine, l2, negative_inner
from ..sources.shared import new_path, ship, written
from ..sources.tables import table

K1, B = 1.2, 0.75
#: Rows that centroids are fitted on at most.
SAMPLE = 20_000
LLOYD = 5
#: Lists of 16 that a search reads: the fewest that find 0.9 of the 10 nearest, as a mean over queries.
PROBES = 11
METRICS = {"l2": l2, "cosine": cosine, "ip": negative_inner}


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, distance): the k nearest, ties by key. A projection and a top-k: no shuffle beyond k rows for each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = METRICS[metric](F.transform(column, lambda x: x.cast("double")), q)
    return vectors.select(key, distance.alias("distance")).orderBy("distance", key).limit(k)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)


class IvfIndex:
    """Inverted lists of vectors by nearest centroid, stored as a Parquet folder for each list.

    Centroids are fitted on at most SAMPLE rows, evenly over the key's order of hash; every row is assigned.
    """

    def __init__(self, vectors: DataFrame, lists: int = 16, metric: str = "l2", key: str = "vec_id", column: str = "embedding"):
        self.metric, self.key, self.column, self.spark = metric, key, column, vectors.sparkSession
        rows = vectors.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(key, column).collect()
        rows.sort(key=lambda r: r[0])
        x = _unit(np.array([r[1] for r in rows], dtype=float), metric)
        lists = min(lists, len(x))
        centres = x[np.linspace(0, len(x) - 1, lists).astype(int)]
        for _ in range(LLOYD):
            at = _nearest(x, centres)
            centres = np.array([x[at == i].mean(axis=0) if (at == i).any() else centres[i] for i in range(lists)])
        self.centres = centres
        self.path = new_path(self.spark, "ivf")
        ship(self.spark)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = np.stack([np.asarray(v, dtype=float) for v in b.column(1).to_pylist()])
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(_nearest(_unit(m, metric), centres), pa.int32())], names=["k", "v", "list_id"])

        typed = vectors.select(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("v")).filter("v IS NOT NULL")
        typed.mapInArrow(assign, "k long, v array<double>, list_id int").repartition("list_id", F.pmod(F.xxhash64("k"), F.lit(8))).write.partitionBy("list_id").parquet(self.path)

    def search(self, query: list[float], k: int, probes: int = PROBES) -> DataFrame:
        """Exact distances in the `probes` nearest lists; with as many probes as lists the result is exact."""
        q = _unit(np.array([query], dtype=float), self.metric)
        near = np.argsort(((self.centres - q) ** 2).sum(axis=1), kind="stable")[:probes]
        rows = self.spark.read.parquet(self.path).filter(F.col("list_id").isin([int(i) for i in near]))
        return knn(rows, query, k, self.metric, "k", "v").withColumnRenamed("k", self.key)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def query_terms(text: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", text.lower()) if len(t) >= 2))


def _occurrences(words: str, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def bm25(docs: DataFrame, query: str, k: int | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, score) of the documents that have a query term. One scan counts; figures and scores come from its few numbers a row; nothing is shuffled."""
    terms = query_terms(query)
    counts = docs.select(key, tokens(F.col(column)).alias("t")).select(
        key, F.size("t").alias("dl"), *[_occurrences("t", w).alias(f"tf{i}") for i, w in enumerate(terms)]
    )
    counts = written(counts, "bm25_counts")
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.lit(float(np.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(stats["avgdl"] or 1.0))))
    out = counts.select(key, score.alias("score")).filter("score > 0")
    return out.orderBy(F.desc("score"), key).limit(k) if k is not None else out


def matches(text: Column, query: str) -> Column:
    """1 if all terms of the query occur, else 0."""
    return (F.size(F.array_except(F.array(*[F.lit(t) for t in query_terms(query)]).cast("array<string>"), tokens(text))) == 0).cast("int")


def rrf(vectors: DataFrame, query_vector: list[float], docs: DataFrame, query: str, k: int, vector_key: str = "vec_id", doc_key: str = "doc_id", doc_column: str = "text") -> DataFrame:
    """(id, score): reciprocal rank fusion of a vector leg and a text leg, each to depth max(60, 3k). Each leg has at most that many rows when it is ranked."""
    from pyspark.sql.window import Window

    depth = max(60, 3 * k)
    one = Window.partitionBy(F.lit(1))
    near = knn(vectors, query_vector, depth, key=vector_key).select(F.col(vector_key).alias("id"), F.row_number().over(one.orderBy("distance", vector_key)).alias("r"))
    text = bm25(docs, query, depth, doc_key, doc_column).select(F.col(doc_key).alias("id"), F.row_number().over(one.orderBy(F.desc("score"), doc_key)).alias("r"))
    legs = near.unionByName(text).groupBy("id").agg(F.sum(1.0 / (60 + F.col("r"))).alias("score"))
    return legs.orderBy(F.desc("score"), "id").limit(k)


def remember(store, name: str, rows: DataFrame) -> None:
    """Adds to an agent memory: (id, kind, content, embedding)."""
    if name not in store.now["tables"]:
        store.create(name, "id long, kind string, content string, embedding array<double>", ["id"], serial="id")
    store.insert(name, rows)


def recall(store, name: str, query: str, k: int, embedding: list[float] | None = None) -> DataFrame:
    """Fused ranking if an embedding is given, else BM25."""
    memory = store.table(name)
    if embedding is None:
        return bm25(memory, query, k, "id", "content")
    return rrf(memory.filter("embedding IS NOT NULL").select("id", "embedding"), embedding, memory, query, k, "id", "id", "content")


def history(store, name: str, version: int) -> DataFrame:
    return store.table(name, version)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]]


QUERY = "then and ingre tion"


def _ranked(df: DataFrame, key: str) -> DataFrame:
    return df.select(key)


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10), "vec_id")


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(knn(table(spark, sf_dir, "embeddings").filter("label = 1"), _query_vector(spark, sf_dir), 10), "vec_id")


def knn_opclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = IvfIndex(table(spark, sf_dir, "embeddings"), 8, "cosine")
    return _ranked(index.search(_query_vector(spark, sf_dir), 10, probes=8), "vec_id")


def knn_ivfflat(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = IvfIndex(table(spark, sf_dir, "embeddings"), 16)
    return _ranked(index.search(_query_vector(spark, sf_dir), 10, probes=16), "vec_id")


def knn_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = IvfIndex(table(spark, sf_dir, "embeddings"), 16)
    return _ranked(index.search(_query_vector(spark, sf_dir), 10), "vec_id")


def knn_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served exactly, which is what a search width of at least the table's rows gives."""
    return knn_exact(spark, sf_dir)


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(table(spark, sf_dir, "documents"), QUERY, 10).select("doc_id", F.round("score", 6).alias("score"))


def bm25_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(matches(F.col("text"), "then and with") == 1).select("doc_id")


def rrf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rrf(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), table(spark, sf_dir, "documents"), QUERY, 10)
    return found.select("id", F.round("score", 9).alias("score"))


_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2)"


def _bm25_sql(query: str) -> str:
    terms = query_terms(query)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {K1 + 1} / (tf{i} + {K1} * ({1 - B} + {B} * dl / avgdl))" for i in range(len(terms)))
    return (
        f"SELECT doc_id, {score} AS score FROM (SELECT doc_id, len(t) AS dl, {tf} FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)), "
        f"(SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM (SELECT len(t) AS dl, {tf} FROM (SELECT {_TOKENS} AS t FROM documents)))"
    )


def _nearest_sql(metric: str = "list_distance", where: str = "TRUE", k: int = 10) -> str:
    return f"SELECT vec_id FROM (SELECT vec_id, {metric}(CAST(embedding AS DOUBLE[]), {_Q}) AS d FROM embeddings WHERE {where}) ORDER BY d, vec_id LIMIT {k}"


QUERIES = {
    "knn_exact": knn_exact, "knn_filtered": knn_filtered, "knn_ivfflat": knn_ivfflat, "knn_opclass": knn_opclass, "knn_probes": knn_probes, "knn_hnsw": knn_hnsw,
    "bm25": bm25_top, "bm25_matches": bm25_matches, "rrf": rrf_top,
}
ORACLES = {
    "knn_exact": _nearest_sql(),
    "knn_filtered": _nearest_sql(where="label = 1"),
    "knn_ivfflat": _nearest_sql(),
    "knn_hnsw": _nearest_sql(),
    "knn_opclass": _nearest_sql("list_cosine_distance"),
    "bm25": f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(QUERY)}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10",
    "bm25_matches": f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['then', 'and', 'with'])",
    "rrf": (
        f"WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) AS r FROM (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), {_Q}) AS d FROM embeddings) QUALIFY r <= 60), "
        f"t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_bm25_sql(QUERY)}) WHERE score > 0 QUALIFY r <= 60) "
        "SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM t) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, id LIMIT 10"
    ),
}
