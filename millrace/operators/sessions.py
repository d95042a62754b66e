"""Sessions: settings, parameters, errors that are part of the contract, cancellation, agent-memory tools, notifications."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import ConstraintError, Store, StoreError
from ..sources.tables import sql, table
from ..streaming.feeds import Feed, retain
from .numbering import numbered
from .search import history, recall, remember
from .stored import NATION, _nations, _rows


class QueryTooLarge(ValueError):
    """A query whose optimised plan is estimated above the session's cap."""


@dataclass
class Session:
    """SQL text with named parameters under settings: search_path, max_query_memory (bytes); other names are kept and have no effect."""

    spark: SparkSession
    settings: dict[str, str] = field(default_factory=dict)

    def set(self, name: str, value: str) -> None:
        self.settings[name] = value
        if name == "search_path":
            self.spark.sql(f"USE {value}")

    def show(self, name: str) -> str | None:
        return self.settings.get(name)

    def execute(self, text: str, **parameters) -> DataFrame:
        df = self.spark.sql(text, args=parameters or None)
        most = int(self.settings.get("max_query_memory", 0))
        if most and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most:
            raise QueryTooLarge(f"estimated above {most} bytes")
        return df

    def execute_tagged(self, tag: str, text: str) -> list:
        """Rows of a query that `cancel(tag)`, from another thread, can interrupt."""
        self.spark.addTag(tag)
        try:
            return self.execute(text).collect()
        finally:
            self.spark.removeTag(tag)

    def cancel(self, tag: str) -> list[str]:
        return self.spark.interruptTag(tag)


@dataclass
class AgentTools:
    """An agent's tools over a store: query, schema, remember, recall, history."""

    store: Store
    memory: str = "agent_memory"

    def query(self, text: str) -> DataFrame:
        """A SELECT over the store's tables by their names."""
        for name in self.store.now["tables"]:
            self.store.table(name).createOrReplaceTempView(name)
        return self.store.spark.sql(text)

    def schema(self) -> DataFrame:
        return self.store.information_schema("columns")

    def remember(self, rows: DataFrame) -> None:
        remember(self.store, self.memory, rows)

    def recall(self, query: str, k: int = 5, embedding: list[float] | None = None) -> DataFrame:
        return recall(self.store, self.memory, query, k, embedding)

    def history(self, version: int) -> DataFrame:
        return history(self.store, self.memory, version)


class Listener:
    """Which feeds have changes that this listener has not been told of."""

    def __init__(self, store: Store):
        self.store, self.told = store, {}

    def listen(self, feed: str) -> None:
        self.told[feed] = self._last(feed)

    def unlisten(self, feed: str) -> None:
        self.told.pop(feed, None)

    def _last(self, feed: str) -> int:
        """The number of the last change of the feed's table, from the manifest alone."""
        return self.store._meta(self.store.now["feeds"][feed]["table"]).get("last", 0)

    def poll(self) -> list[str]:
        now = {f: self._last(f) for f in self.told}
        news = sorted(f for f, seq in now.items() if seq > self.told[f])
        self.told.update(now)
        return news


def _outcome(spark: SparkSession, *tries: tuple[str, Callable]) -> DataFrame:
    out = []
    for what, run in tries:
        try:
            run()
            out.append((what, "accepted"))
        except (AnalysisException, ConstraintError, StoreError, QueryTooLarge) as e:
            out.append((what, "not analysed" if isinstance(e, AnalysisException) else str(e)))
    return spark.createDataFrame(out, "what string, outcome string")


def where_agg_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcome(spark, ("aggregate in WHERE", lambda: sql(spark, sf_dir, "SELECT n_name FROM nation WHERE count(*) > 1")), ("in HAVING", lambda: sql(spark, sf_dir, "SELECT n_name FROM nation GROUP BY n_name HAVING count(*) > 1")))


def agg_ungrouped_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcome(spark, ("column beside an aggregate", lambda: sql(spark, sf_dir, "SELECT n_name, count(*) FROM nation")), ("grouped", lambda: sql(spark, sf_dir, "SELECT n_name, count(*) FROM nation GROUP BY n_name")))


def op_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return Session(spark).execute("SELECT o_orderkey, o_totalprice > :price AS dear FROM orders WHERE o_custkey = :customer", customer=7, price=100000)


def src_sqlwire(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return Session(spark).execute("SELECT n_name FROM nation WHERE n_regionkey = 1")


def session_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    small, plain = Session(spark), Session(spark)
    small.set("max_query_memory", "100")
    plain.set("no_such_setting", "1")
    return _outcome(spark, ("capped", lambda: small.execute("SELECT * FROM orders")), ("not capped", lambda: plain.execute("SELECT * FROM orders")))


def cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged query that nobody cancels."""
    return spark.createDataFrame(Session(spark).execute_tagged("millrace", "SELECT id FROM range(5)"), "id long")


def _memory(spark: SparkSession, sf_dir: str) -> AgentTools:
    tools = AgentTools(Store(spark))
    talk = numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "turn"], "id")
    tools.remember(talk.select("id", F.col("role").alias("kind"), F.col("text").alias("content"), F.lit(None).cast("array<double>").alias("embedding")))
    tools.remember(spark.createDataFrame([(-1, "note", "zebra stripes are black", None), (-2, "note", "a zebra eats grass, zebra", None)], "id long, kind string, content string, embedding array<double>"))
    return tools


def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory(spark, sf_dir).recall("zebra", 5).select("id")


def memory_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory(spark, sf_dir).history(2).select("id")


def src_mcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = _memory(spark, sf_dir)
    assert tools.schema().count() == 4
    return tools.query("SELECT kind, count(*) AS n FROM agent_memory GROUP BY kind")


def ddl_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    return _outcome(
        spark, ("again", lambda: store.create("nation", NATION, ["n_nationkey"])), ("if not exists", lambda: store.create("nation", NATION, ["n_nationkey"], if_not_exists=True)),
        ("without a key", lambda: store.create("t", "a int", [])), ("new", lambda: store.create("t", "a int", ["a"])),
    )


def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    return _outcome(spark, ("there", lambda: store.drop("nation")), ("gone", lambda: store.drop("nation")), ("if exists", lambda: store.drop("nation", if_exists=True)))


def _tries(spark: SparkSession, sf_dir: str, options: dict, *rows: tuple[str, tuple]) -> DataFrame:
    store = _nations(spark, sf_dir, **options)
    return _outcome(spark, *[(what, lambda r=r: store.insert("nation", _rows(spark, *r))) for what, r in rows])


def con_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tries(spark, sf_dir, {}, ("known", ((3, "X", 1),)), ("twice", ((90, "X", 1), (90, "Y", 1))), ("null", ((None, "X", 1),)), ("new", ((90, "X", 1),)))


def con_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tries(spark, sf_dir, {"unique": ("n_name",)}, ("known", ((90, "NATION_3", 1),)), ("twice", ((90, "X", 1), (91, "X", 1))), ("nulls", ((90, None, 1), (91, None, 1))), ("new", ((92, "X", 1),)))


def con_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tries(spark, sf_dir, {"checks": {"range": "n_regionkey BETWEEN 0 AND 9"}}, ("outside", ((90, "X", 10),)), ("unknown passes", ((90, "X", None),)), ("inside", ((91, "X", 9),)))


def con_notnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tries(spark, sf_dir, {"not_null": ("n_name",)}, ("null", ((90, None, 1),)), ("value", ((90, "X", 1),)))


def con_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir, defaults={"n_name": "'UNNAMED'"})
    store.insert("nation", spark.createDataFrame([(90, 1)], "n_nationkey int, n_regionkey int"))
    return store.table("nation").filter("n_nationkey >= 20")


def con_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    store.create("region", "r_regionkey int, r_name string", ["r_regionkey"])
    store.insert("region", table(spark, sf_dir, "region"))
    store.create("nation", NATION, ["n_nationkey"], foreign={"n_regionkey": ("region", "r_regionkey")})
    insert = lambda *r: lambda: store.insert("nation", _rows(spark, *r))
    return _outcome(
        spark, ("no parent", insert((1, "X", 77))), ("parent", insert((1, "X", 2))), ("null", insert((2, "X", None))),
        ("parent in use", lambda: store.delete("region", "r_regionkey = 2")), ("parent not in use", lambda: store.delete("region", "r_regionkey = 3")),
    )


def savepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.begin()
    store.savepoint("outer")
    store.delete("nation", "n_nationkey < 5")
    store.savepoint("inner")
    store.delete("nation", "n_nationkey < 10")
    store.rollback_to("inner")
    store.commit()
    return store.table("nation")


def cdc_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    feed = Feed(store, "f", "nation")
    feed.ack(10)
    floor = retain(store, 20)
    return _outcome(spark, (f"since {floor}", lambda: store.changes("nation", floor)), (f"since {floor - 1}", lambda: store.changes("nation", floor - 1)))


def listen(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    Feed(store, "f", "nation")
    listener = Listener(store)
    listener.listen("f")
    quiet = listener.poll()
    store.delete("nation", "n_nationkey = 1")
    return spark.createDataFrame([("before", ",".join(quiet)), ("after", ",".join(listener.poll())), ("again", ",".join(listener.poll()))], "moment string, feeds string")


QUERIES = {f.__name__: f for f in (
    where_agg_error, agg_ungrouped_error, op_param, src_sqlwire, session_set, cancel, memory_recall, memory_history, src_mcp, ddl_create, ddl_drop,
    con_pk, con_unique, con_check, con_notnull, con_default, con_fk, savepoint, cdc_retain, listen,
)}


def _values(columns: str, *rows: tuple[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('" + "', '".join(r) + "')" for r in rows) + f") AS v({columns})"


def _outcomes(*rows: tuple[str, str]) -> str:
    return _values("what, outcome", *rows)


_BROKEN = "constraint violated: "
_OLD = "SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, role AS kind FROM conversations"

ORACLES = {
    "where_agg_error": _outcomes(("aggregate in WHERE", "not analysed"), ("in HAVING", "accepted")),
    "agg_ungrouped_error": _outcomes(("column beside an aggregate", "not analysed"), ("grouped", "accepted")),
    "op_param": "SELECT o_orderkey, o_totalprice > 100000 AS dear FROM orders WHERE o_custkey = 7",
    "src_sqlwire": "SELECT n_name FROM nation WHERE n_regionkey = 1",
    "session_set": _outcomes(("capped", "estimated above 100 bytes"), ("not capped", "accepted")),
    "cancel": "SELECT range AS id FROM range(5)",
    "memory_recall": "SELECT CAST(id AS BIGINT) AS id FROM (VALUES (-1), (-2)) AS v(id)",
    "memory_history": f"SELECT id FROM ({_OLD})",
    "src_mcp": f"SELECT kind, count(*) AS n FROM ({_OLD} UNION ALL SELECT -1, 'note' UNION ALL SELECT -2, 'note') GROUP BY kind",
    "ddl_create": _outcomes(("again", "nation exists"), ("if not exists", "accepted"), ("without a key", "a primary key is needed"), ("new", "accepted")),
    "ddl_drop": _outcomes(("there", "accepted"), ("gone", "no table nation"), ("if exists", "accepted")),
    "con_pk": _outcomes(("known", _BROKEN + "primary key"), ("twice", _BROKEN + "primary key"), ("null", _BROKEN + "not null: n_nationkey"), ("new", "accepted")),
    "con_unique": _outcomes(("known", _BROKEN + "unique: n_name"), ("twice", _BROKEN + "unique: n_name"), ("nulls", "accepted"), ("new", "accepted")),
    "con_check": _outcomes(("outside", _BROKEN + "check: range"), ("unknown passes", "accepted"), ("inside", "accepted")),
    "con_notnull": _outcomes(("null", _BROKEN + "not null: n_name"), ("value", "accepted")),
    "con_default": "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 90, 'UNNAMED', 1",
    "con_fk": _outcomes(("no parent", _BROKEN + "foreign key: n_regionkey"), ("parent", "accepted"), ("null", "accepted"), ("parent in use", _BROKEN + "foreign key: nation.n_regionkey"), ("parent not in use", "accepted")),
    "savepoint": "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 5",
    "cdc_retain": _outcomes(("since 10", "accepted"), ("since 9", "changes up to 10 are not retained")),
    "listen": _values("moment, feeds", ("before", ""), ("after", "f"), ("again", "")),
}
