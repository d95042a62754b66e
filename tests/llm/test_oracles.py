"""The operators that SQL can express, against that SQL; and the pipeline's stages against plain versions."""

import re

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import exact_dedup, simhash_dedup
from millrace.llm.queries import ORACLES, QUERIES

from .fixtures import shingles
from .test_brute import personal


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, sf_dir).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = before, out
        docs = out
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    before, out = seen["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = texts(out)
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) / len(labels) > 0.93
    before, out = seen["exact_dedup"]
    normal = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    least = {}
    for i, t in before.items():
        least[normal(t)] = min(i, least.get(normal(t), i))
    assert set(texts(out)) == set(least.values())
    before, out = seen["near_dedup"]
    sets = {i: shingles(t) for i, t in before.items()}
    left = sorted(texts(out))
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    gone = set(before) - set(left)
    assert gone and all(any(alike(i, j) for j in before if j != i) for i in gone)
    assert not [(a, b) for k, a in enumerate(left) for b in left[:k] if alike(a, b)]
    before, out = seen["pii"]
    after = texts(out)
    assert set(after) == set(before)
    assert all(after[i] == t for i, t in before.items() if not personal(t or "") and "<" not in (after[i] or ""))
    assert all(not [f for f in personal(t or "") if f[3] == "email"] for t in after.values())
    _, out = seen["packing"]
    assert {r["doc_id"] for r in out.collect()} == set(after)


def test_run_is_all_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_long_way_of_without(spark, monkeypatch):
    from millrace.llm import common

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    monkeypatch.setattr(common, "GONE", -1)
    assert sorted(r[0] for r in exact_dedup.dedup(docs).collect()) == [1, 3]
    assert sorted(r[0] for r in simhash_dedup.near_dedup(docs).collect()) == [1, 3]
