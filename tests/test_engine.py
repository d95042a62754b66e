"""Error paths, small fixtures and stateful behaviour of the relational engine."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import json as J
from millrace.functions import vectors, wide
from millrace.operators import search
from millrace.operators.numbering import numbered
from millrace.operators.recursive import EmptyBase, fixpoint
from millrace.plans.star import star_aggregate
from millrace.sources.store import Store, StoreError
from millrace.streaming.feeds import Feed, Queue, Topic, retain
from millrace.streaming.views import IncrementalView, windowed_counts


def test_overflow_and_division_by_zero_are_errors(spark):
    for text in ("SELECT 9223372036854775807 + 1", "SELECT 1 div 0", "SELECT mod(1, 0)", "SELECT sum(x) FROM VALUES (9223372036854775807), (1) t(x)"):
        with pytest.raises(Exception):
            spark.sql(text).collect()


def test_scalar_subquery_of_two_rows_is_an_error(spark):
    with pytest.raises(Exception):
        spark.sql("SELECT (SELECT x FROM VALUES (1), (2) t(x))").collect()


def test_star_with_repeated_and_unmatched_keys(spark):
    fact = spark.createDataFrame([(1, 5), (1, 7), (2, 1), (9, 100)], "k long, v long")
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "d long, g string")
    got = {(r["g"], r["n"], r["s"]) for r in star_aggregate(fact, dim, "k", "d", ["g"], {"v": "s"}).collect()}
    assert got == {("a", 3, 13), ("b", 2, 12)}


def test_fixpoint_ends_on_cycles_and_refuses_an_empty_base(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    out = fixpoint(spark.sql("SELECT 1 AS n"), lambda new: new.join(edges, new.n == edges.a).select(edges.b.alias("n")))
    assert sorted(r[0] for r in out.collect()) == [1, 2, 3]
    with pytest.raises(EmptyBase):
        fixpoint(spark.sql("SELECT 1 AS n WHERE false"), lambda new: new)


def test_numbering_is_gapless_with_ties_and_nulls(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("v"))
    out = numbered(df, ["k", "v"], "no").collect()
    assert sorted(r["no"] for r in out) == list(range(1, 1001))
    key = lambda r: (r["k"], r["v"] is not None, r["v"] or 0)
    assert [key(r) for r in sorted(out, key=lambda r: r["no"])] == sorted(key(r) for r in out)
    assert numbered(df.limit(0), ["k"], "no").collect() == []


def test_vector_rules(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert row.select(vectors.l2(F.col("a"), F.col("b"))).first()[0] == 5.0
    assert row.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] is None
    with pytest.raises(Exception):
        row.select(vectors.l2(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_search_terms_and_matches(spark):
    assert search.query_terms("The quick, QUICK a brown-fox 42!") == ["the", "quick", "brown", "fox", "42"]
    docs = spark.createDataFrame([(1, "The quick fox"), (2, "quick quick"), (3, None), (4, "")], "doc_id long, text string")
    assert [r[0] for r in docs.filter(search.matches(F.col("text"), "quick the") == 1).collect()] == [1]
    ranked = search.bm25(docs, "quick", 5).collect()
    assert [r["doc_id"] for r in ranked] == [2, 1] and ranked[0]["score"] > ranked[1]["score"]


def test_agent_memory(spark):
    store = Store(spark)
    rows = spark.createDataFrame([("fact", "the sky is blue", [1.0, 0.0]), ("fact", "grass is green", [0.0, 1.0])], "kind string, content string, embedding array<double>")
    search.remember(store, "memory", rows)
    assert search.recall(store, "memory", "green grass", 1).first()["id"] is not None
    assert search.recall(store, "memory", "sky", 2, [0.9, 0.1]).count() == 2
    assert search.history(store, "memory", store.now["version"]).count() == 2


def test_wide_types(spark):
    assert wide.unpack(wide.pack(wide.MOST)) == wide.MOST
    with pytest.raises(OverflowError):
        wide.pack(wide.MOST + 1)
    one = spark.createDataFrame([(str(wide.MOST), "1")], "a string, b string").select(wide.u256(F.col("a")).alias("a"), wide.u256(F.col("b")).alias("b"))
    with pytest.raises(Exception):
        one.select(wide.u256_op("+", F.col("a"), F.col("b"))).collect()
    assert one.select(wide.u256_text(wide.u256_op("-", F.col("a"), F.col("b")))).first()[0] == str(wide.MOST - 1)
    assert wide.generated_uuid("t", 1) == wide.generated_uuid("t", 1) != wide.generated_uuid("t", 2)
    with pytest.raises(ValueError):
        wide.checked_date_trunc("fortnight", F.lit(None))
    with pytest.raises(Exception):
        spark.range(1).select(wide.enum_order(F.lit("x"), ["a", "b"])).collect()
    assert spark.range(1).select(wide.time_shift(F.lit(86000), 1000)).first()[0] == 600


def test_canonical_json():
    assert J.canonical_text('{"b":[1.50,{"z":1,"a":"00x"}],"a":-0}') == '{"a":0,"b":[1.5,{"a":"00x","z":1}]}'
    with pytest.raises(ValueError):
        J.canonical_text("{a:1}")
    assert J.contained({"a": [1, {"b": 2}]}, {"a": [{"b": 2}]}) and not J.contained({"a": 1}, {"a": True})


def test_transactions_and_conflicts(spark):
    store = Store(spark)
    store.create("t", "id int, v int", ["id"])
    other = Store(spark, store.root)
    row = lambda *r: spark.createDataFrame(list(r), "id int, v int")
    store.insert("t", row((1, 1)))
    with pytest.raises(FileExistsError):
        other.insert("t", row((2, 2)))
    with pytest.raises(StoreError):
        store.commit()
    with pytest.raises(StoreError):
        store.table("t", 99)
    assert store.table("t", 1).count() == 0 and store.table("t", 2).count() == 1
    assert Store(spark, store.root).table("t").count() == 1


def test_feeds_topics_and_retention(spark):
    store = Store(spark)
    store.create("t", "id int", ["id"])
    store.insert("t", spark.range(5).selectExpr("CAST(id AS INT) AS id"))
    feed = Feed(store, "f", "t")
    assert feed.fetch().count() == feed.fetch().count() == 5
    feed.ack(3)
    feed.ack(1)
    assert feed.acked == 3 and [r["_seq"] for r in feed.fetch().collect()] == [4, 5]
    assert retain(store, 10) == 3
    with pytest.raises(StoreError):
        store.changes("t", 2)
    feed.drop()
    with pytest.raises(StoreError):
        Feed(store, "f")
    topic = Topic(store, "e", create=True)
    assert topic.consume().count() == 0
    assert topic.publish(spark.createDataFrame([("b",), ("a",)], "payload string"), ["payload"]) == 2


def test_queue_redelivers_and_buries(spark):
    store = Store(spark)
    q = Queue(store, "p", create=True)
    q.send(spark.createDataFrame([("poison",)], "payload string"))
    for _ in range(5):
        assert q.receive(1, visibility=0).count() == 1
    assert q.receive(1, visibility=0).count() == 0
    assert [r["payload"] for r in q.dead().collect()] == ["poison"]
    store.begin()
    with pytest.raises(StoreError):
        q.receive()
    store.rollback()


def test_incremental_view_equals_recomputation(spark):
    view = IncrementalView(spark, ["g"], {"v": "s"}, where="v >= 0")
    rows, live = [(i % 3, i % 5 - 1) for i in range(40)], []
    for batch, (some, sign) in enumerate([(rows[:20], 1), (rows[5:10], -1), (rows[20:], 1), (rows[:5] + rows[10:20], -1)]):
        view.apply(spark.createDataFrame([(*r, sign) for r in some], "g int, v int, _sign int"), batch)
        live = live + some if sign > 0 else [r for i, r in enumerate(live) if not (r in some and live[: i + 1].count(r) <= some.count(r))]
        want = spark.createDataFrame(live, "g int, v int").filter("v >= 0").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
        assert sorted(map(tuple, view.read().select("g", "n", "s").collect())) == sorted(map(tuple, want.collect()))


def test_incremental_view_follows_a_stream(spark, tmp_path):
    schema = "g int, v int, _sign int"
    for i in range(3):
        spark.createDataFrame([(1, i, 1), (2, 1, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    view = IncrementalView(spark, ["g"], {"v": "s"})
    view.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).awaitTermination(120)
    assert sorted(map(tuple, view.read().collect())) == [(1, 3, 3), (2, 3, 3)]


def test_windowed_counts_in_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    assert out.agg(F.sum("n")).first()[0] == events.count()


def test_unlisten(spark):
    from millrace.operators.sessions import Listener

    store = Store(spark)
    store.create("t", "id int", ["id"])
    Feed(store, "f", "t")
    listener = Listener(store)
    listener.listen("f")
    listener.unlisten("f")
    store.insert("t", spark.createDataFrame([(1,)], "id int"))
    assert listener.poll() == []
