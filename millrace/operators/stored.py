"""Queries over versioned tables: writes, constraints, transactions, time travel, change logs, queues and maintained views.

Each makes a store of its own in the shared folder from base tables, runs a short script, and returns what a reader sees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import canonical, json_contains
from ..functions.wide import average_decimal, u256, u256_op, u256_sum, u256_text
from ..sources.store import ConstraintError, Store
from ..sources.tables import sql, table
from ..streaming.feeds import Feed, Queue, Topic, replay
from ..streaming.views import IncrementalView, MaterialisedView

NATION = "n_nationkey int, n_name string, n_regionkey int"


def _nations(spark: SparkSession, sf_dir: str, **options) -> Store:
    store = Store(spark)
    store.create("nation", NATION, ["n_nationkey"], **options)
    store.insert("nation", table(spark, sf_dir, "nation"))
    return store


def _rows(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), NATION)


def sink_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.insert("nation", _rows(spark, (100, "NEW", 1), (101, "NEWER", None)))
    return store.table("nation")


def sink_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.insert("nation", sql(spark, sf_dir, "SELECT CAST(r_regionkey + 200 AS INT) AS n_nationkey, r_name AS n_name, r_regionkey AS n_regionkey FROM region"))
    return store.table("nation")


def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.insert("nation", _rows(spark, (3, "IGNORED", 9), (300, "ADDED", 2)), "update", {"n_name": "'UPSERTED'"})
    store.insert("nation", _rows(spark, (4, "IGNORED", 9), (301, "ALSO", 2)), "nothing")
    return store.table("nation")


def sink_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.update("nation", {"n_name": "'RENAMED'"}, "n_nationkey = 5")
    return store.table("nation")


def sink_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.delete("nation", "n_nationkey = 5")
    return store.table("nation")


def sink_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).delete("nation", "n_regionkey = 2").select("n_nationkey", "n_name")


def sink_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.truncate("nation")
    return store.table("nation").agg(F.count(F.lit(1)).alias("n"))


def sink_ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    store.create_as("big", sql(spark, sf_dir, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"), ["o_custkey"])
    return store.table("big").filter("n > 12")


def sink_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.create_like("other", "nation")
    store.insert("other", _rows(spark, (1, "ONE", 1)))
    return store.table("other")


def sink_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).dump("nation")


def sink_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.delete("nation", "n_nationkey < 20")
    store.backup(f"{store.root}/backup", 2)
    return store.restore(f"{store.root}/backup").table("nation")


def sink_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    other = store.branch()
    other.delete("nation", "n_nationkey < 20")
    store.update("nation", {"n_name": "'MAIN'"}, "n_nationkey = 24")
    return other.table("nation")


def scan_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.update("nation", {"n_name": "'LATER'"}, "n_nationkey < 10")
    store.delete("nation", "n_nationkey = 1")
    return store.table("nation", 3)


def scan_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STRICT, BOUNDED n and read-your-writes are all served by the latest version."""
    store = _nations(spark, sf_dir)
    store.delete("nation", "n_nationkey = 1")
    return store.table("nation")


def scan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql(spark, sf_dir, "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey").createOrReplaceTempView("millrace_per_customer")
    spark.sql("SELECT k, n FROM millrace_per_customer WHERE n > 12").createOrReplaceTempView("millrace_busy")
    return spark.sql("SELECT k, n FROM millrace_busy")


def scan_matview(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    view = MaterialisedView(lambda: store.table("nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")))
    before = view.read()
    store.delete("nation", "n_regionkey = 0")
    stale = view.read().select(F.lit("stale").alias("at"), "n_regionkey", "n")
    view.refresh()
    assert before is not view.read()
    return stale.unionByName(view.read().select(F.lit("fresh").alias("at"), "n_regionkey", "n"))


def scan_infoschema(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir, not_null=("n_name",))
    return store.information_schema("columns").select("table_name", "column_name", "ordinal_position", "is_nullable")


def scan_pgcatalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    spaces = store.pg_catalog("pg_namespace").withColumnRenamed("oid", "relnamespace")
    return store.pg_catalog("pg_class").join(spaces, "relnamespace").select("nspname", "relname", "relkind")


def _refused(spark: SparkSession, *tries: tuple[str, Callable]) -> DataFrame:
    out = []
    for what, run in tries:
        try:
            run()
            out.append((what, None))
        except ConstraintError as e:
            out.append((what, e.name))
    return spark.createDataFrame(out, "what string, refused_by string")


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    store.create("region", "r_regionkey int, r_name string", ["r_regionkey"], unique=("r_name",))
    store.insert("region", table(spark, sf_dir, "region"))
    store.create("nation", NATION, ["n_nationkey"], not_null=("n_name",), checks={"small": "n_nationkey < 1000"}, foreign={"n_regionkey": ("region", "r_regionkey")}, defaults={"n_name": "'UNNAMED'"})
    store.insert("nation", table(spark, sf_dir, "nation"))
    region = lambda *r: spark.createDataFrame(list(r), "r_regionkey int, r_name string")
    return _refused(
        spark,
        ("same key", lambda: store.insert("nation", _rows(spark, (1, "X", 1)))),
        ("twice in one batch", lambda: store.insert("nation", _rows(spark, (50, "X", 1), (50, "Y", 1)))),
        ("null name", lambda: store.insert("nation", _rows(spark, (51, None, 1)))),
        ("check", lambda: store.insert("nation", _rows(spark, (5000, "X", 1)))),
        ("no parent", lambda: store.insert("nation", _rows(spark, (52, "X", 99)))),
        ("null parent", lambda: store.insert("nation", _rows(spark, (53, "X", None)))),
        ("default", lambda: store.insert("nation", spark.createDataFrame([(54, 1)], "n_nationkey int, n_regionkey int"))),
        ("parent in use", lambda: store.delete("region", "r_regionkey = 1")),
        ("not unique", lambda: store.insert("region", table(spark, sf_dir, "region").filter("r_regionkey = 1").withColumn("r_regionkey", F.lit(77)))),
        ("nulls are not equal", lambda: store.insert("region", region((78, None), (79, None)))),
        ("change of key", lambda: store.insert("nation", _rows(spark, (1, "X", 1)), "update", {"n_nationkey": "2"})),
    )


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.begin()
    store.insert("nation", _rows(spark, (100, "KEPT", 1)))
    store.savepoint("a")
    store.delete("nation", "n_nationkey < 10")
    store.savepoint("b")
    store.insert("nation", _rows(spark, (101, "LOST", 1)))
    store.rollback_to("a")
    store.insert("nation", _rows(spark, (102, "KEPT TOO", 1)))
    store.release("a")
    store.commit()
    store.begin()
    store.truncate("nation")
    store.rollback()
    return store.table("nation")


def ddl_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.alter("nation", rename_column=("n_name", "name"))
    store.alter("nation", add_column=("size int", "7"))
    store.alter("nation", drop_column="n_regionkey")
    store.alter("nation", set_type=("n_nationkey", "bigint"))
    store.alter("nation", rename_to="country")
    return store.table("country")


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).analyze("nation")


def introspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    return store.information_schema("tables")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql(spark, sf_dir, "SELECT 1 AS x FROM orders LIMIT 1")
    return spark.sql("EXPLAIN FORMATTED SELECT o_custkey, count(*) FROM orders WHERE o_orderkey > 10 GROUP BY o_custkey")


def _changed(spark: SparkSession, sf_dir: str) -> Store:
    store = _nations(spark, sf_dir)
    store.update("nation", {"n_name": "'CHANGED'"}, "n_nationkey IN (2, 3)")
    store.delete("nation", "n_nationkey = 4")
    store.insert("nation", _rows(spark, (4, "AGAIN", 1), (60, "MORE", 2)))
    return store


def cdc_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).changes("nation", 25)


def cdc_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(_changed(spark, sf_dir).changes("nation"), ["n_nationkey"])


def cdc_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _changed(spark, sf_dir)
    feed = Feed(store, "f", "nation")
    feed.ack(26)
    feed.ack(3)
    return feed.fetch(2).select("_seq", "_op", "n_nationkey")


def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    t = Topic(store, "ev", create=True)
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("payload"))
    t.publish(talk, ["conv_id", "turn"])
    store.begin()
    t.publish(talk, ["conv_id", "turn"])
    store.rollback()
    t.publish(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("payload")), ["n_nationkey"])
    return t.consume(3)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    q = Queue(store, "jobs", create=True)
    q.send(table(spark, sf_dir, "nation").select(F.col("n_name").alias("payload")))
    first = [r["mid"] for r in q.receive(2, 1).collect()]
    q.ack(first[:1])
    return q.receive(100, 5)


VIEW = "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderkey >= 50 GROUP BY o_orderstatus"


def ivm(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_custkey")
    view = IncrementalView(spark, ["status"], {"o_custkey": "total"}, where="o_orderkey % 10 <> 3")
    view.apply(orders.withColumn("_sign", F.lit(1)), 0)
    view.apply(orders.withColumn("_sign", F.lit(1)), 0)
    view.apply(orders.filter("o_orderkey < 50").withColumn("_sign", F.lit(-1)), 1)
    return view.read()


def ivm_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_custkey")
    view = IncrementalView(spark, ["status"], {"o_custkey": "total"})
    view.apply(orders.withColumn("_sign", F.lit(1)), 0)
    return view.apply(orders.filter("status = 'F' OR o_orderkey < 10").withColumn("_sign", F.lit(-1)), 1).select("_op", "status", "n")


def filter_json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(json_contains(F.col("props"), '{"k": 42}')).select("event_id")


def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(1, '{"b": 1.50, "a": [007, -0]}'), (2, '{ "z":null,"k":{"y":1,"x":2} }'), (3, None)], "id int, doc string")
    return docs.select("id", canonical(F.col("doc")).alias("doc"))


def type_uint256(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").select("n_regionkey", u256(F.concat(F.lit("1000000000000000000000000000000000000000000"), F.lpad("n_nationkey", 3, "0"))).alias("w"))
    twice = base.select("n_regionkey", u256_op("+", F.col("w"), F.col("w")).alias("w"))
    return twice.groupBy("n_regionkey").agg(u256_sum(F.col("w")).alias("s")).select("n_regionkey", u256_text(F.col("s")).alias("s"))


def agg_avg_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM lineitem")
    return rows.groupBy("l_returnflag").agg(average_decimal(F.col("p"), 2).alias("mean"))


QUERIES = {f.__name__: f for f in (
    sink_insert, sink_insert_select, sink_upsert, sink_update, sink_delete, sink_returning, sink_truncate, sink_ctas, sink_like, sink_dump, sink_backup, sink_branch,
    scan_asof, scan_level, scan_view, scan_matview, scan_infoschema, scan_pgcatalog, constraints, txn, ddl_alter, analyze, introspect, explain,
    cdc_changes, cdc_replay, cdc_feed, topic, queue, ivm, ivm_live, filter_json_contains, json_canonical, type_uint256, agg_avg_decimal,
)}

_N = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_ADD = "SELECT * FROM (VALUES {}) AS v(n_nationkey, n_name, n_regionkey)"
_CHANGES = (
    "SELECT 26 AS _seq, 'PUT' AS _op, 2 AS n_nationkey, 'CHANGED' AS n_name, (SELECT n_regionkey FROM nation WHERE n_nationkey = 2) AS n_regionkey UNION ALL "
    "SELECT 27, 'PUT', 3, 'CHANGED', (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) UNION ALL SELECT 28, 'DELETE', 4, NULL, NULL UNION ALL "
    "SELECT 29, 'PUT', 4, 'AGAIN', 1 UNION ALL SELECT 30, 'PUT', 60, 'MORE', 2"
)

ORACLES = {
    "sink_insert": f"{_N} UNION ALL {_ADD.format('(100, CAST(? AS VARCHAR), 1)').replace('CAST(? AS VARCHAR)', chr(39) + 'NEW' + chr(39))} UNION ALL SELECT 101, 'NEWER', NULL",
    "sink_insert_select": f"{_N} UNION ALL SELECT r_regionkey + 200, r_name, r_regionkey FROM region",
    "sink_upsert": "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'UPSERTED' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 300, 'ADDED', 2 UNION ALL SELECT 301, 'ALSO', 2",
    "sink_update": "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation",
    "sink_delete": f"{_N} WHERE n_nationkey <> 5",
    "sink_returning": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2",
    "sink_truncate": "SELECT CAST(0 AS BIGINT) AS n",
    "sink_ctas": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sink_like": "SELECT 1 AS n_nationkey, 'ONE' AS n_name, 1 AS n_regionkey",
    "sink_dump": "SELECT CAST(0 AS BIGINT) AS line, 'CREATE TABLE nation (n_nationkey INT, n_name STRING, n_regionkey INT, PRIMARY KEY (n_nationkey))' AS statement UNION ALL "
    "SELECT row_number() OVER (ORDER BY n_nationkey), 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')' FROM nation",
    "sink_backup": _N,
    "sink_branch": f"{_N} WHERE n_nationkey >= 20",
    "scan_asof": "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 'LATER' ELSE n_name END AS n_name, n_regionkey FROM nation",
    "scan_level": f"{_N} WHERE n_nationkey <> 1",
    "scan_view": "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "scan_matview": "SELECT 'stale' AS at, n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey UNION ALL SELECT 'fresh', n_regionkey, count(*) FROM nation WHERE n_regionkey <> 0 GROUP BY n_regionkey",
    "scan_infoschema": "SELECT * FROM (VALUES ('nation', 'n_nationkey', 1, 'NO'), ('nation', 'n_name', 2, 'NO'), ('nation', 'n_regionkey', 3, 'YES')) AS v(table_name, column_name, ordinal_position, is_nullable)",
    "scan_pgcatalog": "SELECT 'public' AS nspname, 'nation' AS relname, 'r' AS relkind",
    "constraints": "SELECT * FROM (VALUES ('same key', 'primary key'), ('twice in one batch', 'primary key'), ('null name', 'not null: n_name'), ('check', 'check: small'), ('no parent', 'foreign key: n_regionkey'), "
    "('null parent', NULL), ('default', NULL), ('parent in use', 'foreign key: nation.n_regionkey'), ('not unique', 'unique: r_name'), ('nulls are not equal', NULL), ('change of key', 'primary key')) AS v(what, refused_by)",
    "txn": f"{_N} UNION ALL SELECT 100, 'KEPT', 1 UNION ALL SELECT 102, 'KEPT TOO', 1",
    "ddl_alter": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS name, CAST(7 AS INT) AS size FROM nation",
    "introspect": "SELECT 'public' AS table_schema, 'nation' AS table_name, 'BASE TABLE' AS table_type",
    "cdc_changes": f"SELECT CAST(_seq AS BIGINT) AS _seq, _op, n_nationkey, n_name, n_regionkey FROM ({_CHANGES})",
    "cdc_replay": "SELECT n_nationkey, CASE WHEN n_nationkey IN (2, 3) THEN 'CHANGED' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 4, 'AGAIN', 1 UNION ALL SELECT 60, 'MORE', 2",
    "cdc_feed": f"SELECT CAST(_seq AS BIGINT) AS _seq, _op, n_nationkey FROM ({_CHANGES}) WHERE _seq IN (27, 28)",
    "topic": "SELECT \"offset\", payload FROM (SELECT row_number() OVER (ORDER BY batch, k, turn) AS \"offset\", payload FROM (SELECT 1 AS batch, conv_id AS k, turn, text AS payload FROM conversations UNION ALL SELECT 2, n_nationkey, 0, n_name FROM nation)) WHERE \"offset\" > 3",
    "queue": "SELECT mid, payload FROM (SELECT row_number() OVER (ORDER BY n_name) AS mid, n_name AS payload FROM nation) WHERE mid >= 2",
    "ivm": VIEW,
    "ivm_live": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'DELETE' ELSE 'PUT' END AS _op, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'F' THEN count(*) FILTER (WHERE o_orderkey >= 10) END AS n "
    "FROM orders WHERE o_orderstatus IN (SELECT o_orderstatus FROM orders WHERE o_orderkey < 10 OR o_orderstatus = 'F') GROUP BY o_orderstatus",
    "filter_json_contains": "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS INT) = 42",
    "json_canonical": "SELECT * FROM (VALUES (1, '{\"a\":[7,0],\"b\":1.5}'), (2, '{\"k\":{\"x\":2,\"y\":1},\"z\":null}'), (3, NULL)) AS v(id, doc)",
    "type_uint256": "SELECT n_regionkey, CAST((2 * count(*)) AS VARCHAR) || lpad(CAST(2 * sum(n_nationkey) AS VARCHAR), 45, '0') AS s FROM nation GROUP BY n_regionkey",
    "agg_avg_decimal": "SELECT l_returnflag, CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // count(*) AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2)) AS mean FROM lineitem GROUP BY l_returnflag",
}
