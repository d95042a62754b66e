"""Change feeds, topics and queues over a store."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..sources.store import Store, StoreError

MOST_DELIVERIES = 5


class Feed:
    """A named cursor over a table's changes. Fetching never moves it, acknowledging moves it forward only."""

    def __init__(self, store: Store, name: str, table: str | None = None):
        self.store, self.name = store, name
        if table is not None:
            new = copy.deepcopy(store.now)
            if name in new["feeds"]:
                raise StoreError(f"feed {name} exists")
            store._meta(table, new)
            new["feeds"][name] = {"table": table, "acked": 0}
            store._publish(new)
        elif name not in store.now["feeds"]:
            raise StoreError(f"no feed {name}")

    @property
    def acked(self) -> int:
        return self.store.now["feeds"][self.name]["acked"]

    def fetch(self, limit: int | None = None) -> DataFrame:
        return self.store.changes(self.store.now["feeds"][self.name]["table"], self.acked, limit)

    def ack(self, seq: int) -> None:
        new = copy.deepcopy(self.store.now)
        feed = new["feeds"][self.name]
        feed["acked"] = max(feed["acked"], min(seq, new["seq"]))
        self.store._publish(new)

    def drop(self) -> None:
        new = copy.deepcopy(self.store.now)
        del new["feeds"][self.name]
        self.store._publish(new)


def retain(store: Store, seq: int) -> int:
    """Raises the floor below which changes are refused, but not beyond what a feed has yet to acknowledge; returns it."""
    new = copy.deepcopy(store.now)
    new["retain"] = max(new["retain"], min([seq, *(f["acked"] for f in new["feeds"].values())]))
    store._publish(new)
    return new["retain"]


def replay(changes: DataFrame, key: list[str]) -> DataFrame:
    """The table that a log from its start leads to: the last change of each key, unless that is a DELETE."""
    rest = [c for c in changes.columns if c not in ("_seq", "_op", *key)]
    last = changes.groupBy(*key).agg(F.max_by(F.struct("_op", *rest), "_seq").alias("last"))
    return last.filter("last._op = 'PUT'").select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


class Topic:
    """An append-only log with gapless offsets from 1."""

    def __init__(self, store: Store, name: str, create: bool = False):
        self.store, self.name = store, name
        if create:
            new = copy.deepcopy(store.now)
            if name in new["topics"]:
                raise StoreError(f"topic {name} exists")
            new["topics"][name] = {"parts": [], "next": 1}
            store._publish(new)
        elif name not in store.now["topics"]:
            raise StoreError(f"no topic {name}")

    def publish(self, messages: DataFrame, order: list[str], payload: str = "payload") -> int:
        """Appends messages in the order of columns; the last offset. A rolled-back transaction leaves no gap."""
        new = copy.deepcopy(self.store.now)
        topic = new["topics"][self.name]
        rows = numbered(messages, order, "offset", topic["next"]).select("offset", F.col(payload).alias("payload"))
        path = self.store._write(rows, f"topic_{self.name}")
        topic["parts"].append(path)
        topic["next"] += self.store.spark.read.parquet(path).count()
        self.store._publish(new)
        return topic["next"] - 1

    def consume(self, since: int = 0, limit: int | None = None) -> DataFrame:
        parts = self.store.now["topics"][self.name]["parts"]
        schema = "offset long, payload string"
        log = self.store.spark.read.schema(schema).parquet(*parts) if parts else self.store.spark.createDataFrame([], schema)
        out = log.filter(F.col("offset") > since)
        return out.orderBy("offset").limit(limit) if limit is not None else out


class Queue:
    """Messages with a visibility deadline and a delivery count, on the store's change sequence as the clock.

    First in, first out; a message not acknowledged in time is delivered again; the delivery after MOST_DELIVERIES makes it dead.
    """

    def __init__(self, store: Store, name: str, create: bool = False):
        self.store, self.table = store, f"queue_{name}"
        if create:
            store.create(self.table, "mid long, payload string, deadline long, deliveries int, dead boolean", ["mid"], serial="mid", defaults={"deadline": "0", "deliveries": "0", "dead": "false"})
        else:
            store._meta(self.table)

    def _outside(self) -> None:
        if self.store._staged is not None:
            raise StoreError("not inside a transaction")

    def send(self, messages: DataFrame) -> None:
        """A column payload; several messages are numbered in its order."""
        self.store.insert(self.table, messages.select("payload"))

    def receive(self, batch: int = 1, visibility: int = 10) -> DataFrame:
        """(mid, payload) of the next visible messages, hidden for `visibility` changes from now on."""
        self._outside()
        clock = self.store.now["seq"]
        due = self.store.table(self.table).filter(f"NOT dead AND deadline <= {clock}")
        if due.filter(f"deliveries >= {MOST_DELIVERIES}").take(1):
            self.store.update(self.table, {"dead": "true"}, f"NOT dead AND deadline <= {clock} AND deliveries >= {MOST_DELIVERIES}")
            due = self.store.table(self.table).filter(f"NOT dead AND deadline <= {clock}")
        got = due.orderBy("mid").limit(batch).select("mid", "payload").collect()  # a batch, as one consumer takes it
        if got:
            ids = ", ".join(str(r["mid"]) for r in got)
            self.store.update(self.table, {"deadline": f"{self.store.now['seq'] + len(got) + visibility}", "deliveries": "deliveries + 1"}, f"mid IN ({ids})")
        return self.store.spark.createDataFrame([tuple(r) for r in got], "mid long, payload string")

    def ack(self, mids: list[int]) -> int:
        self._outside()
        if not mids:
            return 0
        return self.store.delete(self.table, f"mid IN ({', '.join(map(str, mids))})").count()

    def dead(self) -> DataFrame:
        return self.store.table(self.table).filter("dead").select("mid", "payload")

    def drop(self) -> None:
        self.store.drop(self.table)
