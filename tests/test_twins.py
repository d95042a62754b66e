"""Every registered relational query against its SQL twin in DuckDB."""

import decimal
import glob
import os

import duckdb
import pytest

from millrace.catalogue import ORACLES, QUERIES
from millrace.operators import search


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, decimal.Decimal) else v


def rows(columns, found):
    order = sorted(columns)
    return sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(ORACLES) == {"knn_probes", "analyze", "explain"}


def test_probed_lists_find_most_of_the_nearest(spark, sf_dir):
    exact = {r[0] for r in QUERIES["knn_exact"](spark, sf_dir).collect()}
    probed = {r[0] for r in QUERIES["knn_probes"](spark, sf_dir).collect()}
    assert len(probed) == 10 and len(exact & probed) >= 9


def test_mean_recall_of_probed_lists(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    index = search.IvfIndex(vectors, 16)
    recall = []
    for i in sorted(rows)[:: max(1, len(rows) // 25)]:
        exact = sorted(rows, key=lambda j: (sum((a - b) ** 2 for a, b in zip(rows[i], rows[j])), j))[:10]
        found = {r["vec_id"] for r in index.search(rows[i], 10).collect()}
        recall.append(len(found & set(exact)) / len(exact))
    assert sum(recall) / len(recall) >= 0.9


def test_explain_and_analyze(spark, sf_dir):
    plan = QUERIES["explain"](spark, sf_dir).first()[0]
    assert "PushedFilters" in plan and "GreaterThan(o_orderkey,10)" in plan
    stats = {r["column"]: r for r in QUERIES["analyze"](spark, sf_dir).collect()}
    assert stats["n_nationkey"]["n"] == 25 and stats["n_nationkey"]["high"] == "24"
