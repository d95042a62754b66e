"""Versioned tables with constraints, time travel, transactions and a change log.

A store is a folder. Every commit adds one manifest (a small JSON file, created exclusively, so
that two writers cannot both publish the same version) that lists, for each table, the immutable Parquet parts that make it up. An
insert adds a part; an update or delete rewrites only the parts that hold an affected row, as one. `as_of(n)` reads manifest n, a
branch is a manifest in another folder that shares the parts. Versions count write statements.

Each statement also appends its changes to the table's log: (_seq, _op, columns), _op PUT with the whole row or DELETE with
the key, numbered in one line for the whole store.
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import numbered
from .shared import Files, new_path


class ConstraintError(ValueError):
    """A write that a constraint forbids; `name` says which."""

    def __init__(self, name: str):
        super().__init__(f"constraint violated: {name}")
        self.name = name


class StoreError(ValueError):
    """A statement that cannot be carried out."""


@dataclass
class Store:
    spark: SparkSession
    root: str = ""
    state: dict = field(default_factory=dict)
    _staged: dict | None = None
    _saved: list[tuple[str, dict]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.root = self.root or new_path(self.spark, "store")
        self.files = Files(self.spark, self.root)
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        self.state = json.loads(self.files.read(f"manifest/{names[-1]}")) if names else self.state or {"version": 0, "seq": 0, "tables": {}, "views": {}, "feeds": {}, "topics": {}, "retain": 0}

    # -- versions

    @property
    def now(self) -> dict:
        return self.state if self._staged is None else self._staged

    def _publish(self, new: dict) -> None:
        new["version"] += 1
        if self._staged is not None:
            self._staged = new
            return
        self.files.create(f"manifest/{new['version']:012d}.json", json.dumps(new))
        self.state = new

    def manifest(self, version: int) -> dict:
        """The state at a version; 0 is the empty store."""
        if version == self.now["version"]:
            return self.now
        if not 0 <= version <= self.now["version"]:
            raise StoreError(f"no version {version}")
        names = [n for n in self.files.names("manifest") if n.endswith(".json") and int(n[:-5]) <= version]
        return json.loads(self.files.read(f"manifest/{names[-1]}")) if names else {"version": 0, "seq": 0, "tables": {}, "views": {}}

    def begin(self) -> None:
        if self._staged is not None:
            raise StoreError("a transaction is open")
        self._staged, self._saved = copy.deepcopy(self.state), []

    def commit(self) -> None:
        """Publishes all staged statements as one manifest; versions still count each statement."""
        staged, self._staged, self._saved = self._need(), None, []
        if staged["version"] != self.state["version"]:
            self.files.create(f"manifest/{staged['version']:012d}.json", json.dumps(staged))
            self.state = staged

    def rollback(self) -> None:
        self._need()
        self._staged, self._saved = None, []

    def _need(self) -> dict:
        if self._staged is None:
            raise StoreError("no transaction is open")
        return self._staged

    def savepoint(self, name: str) -> None:
        self._saved.append((name, copy.deepcopy(self._need())))

    def rollback_to(self, name: str) -> None:
        at = self._saved_at(name)
        self._staged = copy.deepcopy(self._saved[at][1])
        del self._saved[at + 1 :]

    def release(self, name: str) -> None:
        del self._saved[self._saved_at(name) :]

    def _saved_at(self, name: str) -> int:
        self._need()
        for i in range(len(self._saved) - 1, -1, -1):
            if self._saved[i][0] == name:
                return i
        raise StoreError(f"no savepoint {name}")

    # -- reading

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table, as of a version if one is given. Bounded and read-your-writes levels are served by the latest."""
        return self._read(self._meta(name, self.now if version is None else self.manifest(version)))

    def _meta(self, name: str, state: dict | None = None) -> dict:
        try:
            return (state or self.now)["tables"][name]
        except KeyError:
            raise StoreError(f"no table {name}") from None

    def _schema(self, meta: dict) -> T.StructType:
        return T.StructType.fromJson(meta["schema"])

    def _read(self, meta: dict) -> DataFrame:
        schema = self._schema(meta)
        if not meta["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*meta["parts"])

    # -- definitions

    def create(
        self, name: str, columns: str, key: list[str], not_null: tuple[str, ...] = (), unique: tuple[str, ...] = (), checks: dict[str, str] | None = None,
        defaults: dict[str, str] | None = None, foreign: dict[str, tuple[str, str]] | None = None, serial: str | None = None, if_not_exists: bool = False,
    ) -> None:
        """columns is DDL text; defaults are SQL expressions; foreign maps a column to (table, column); serial names a column that numbers itself."""
        new = copy.deepcopy(self.now)
        if name in new["tables"] or name in new["views"]:
            if if_not_exists:
                return
            raise StoreError(f"{name} exists")
        schema = T.StructType.fromDDL(columns)
        if not key or not set(key) <= set(schema.names):
            raise StoreError("a primary key is needed")
        new["tables"][name] = {
            "schema": schema.jsonValue(), "key": key, "not_null": list(not_null), "unique": list(unique), "checks": checks or {}, "defaults": defaults or {},
            "foreign": {c: list(t) for c, t in (foreign or {}).items()}, "serial": serial, "next": 1, "parts": [], "log": [], "last": 0,
        }
        self._publish(new)

    def create_as(self, name: str, df: DataFrame, key: list[str]) -> None:
        self.create(name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), key)
        self.insert(name, df)

    def create_like(self, name: str, other: str) -> None:
        new = copy.deepcopy(self.now)
        if name in new["tables"]:
            raise StoreError(f"{name} exists")
        new["tables"][name] = {**copy.deepcopy(self._meta(other)), "parts": [], "log": [], "next": 1}
        self._publish(new)

    def drop(self, name: str, if_exists: bool = False) -> None:
        new = copy.deepcopy(self.now)
        if new["tables"].pop(name, None) is None and not if_exists:
            raise StoreError(f"no table {name}")
        if any(t[0] == name for m in new["tables"].values() for t in m["foreign"].values()):
            raise ConstraintError(f"{name} is referenced")
        self._publish(new)

    def alter(self, name: str, **change) -> None:
        """One of: rename_to, rename_column=(old, new), add_column=(ddl, default or None), drop_column, set_type=(column, type),
        set_default=(column, expression or None), set_not_null, drop_not_null, add_check=(name, expression), drop_check, add_unique, drop_unique."""
        new = copy.deepcopy(self.now)
        meta = self._meta(name, new)
        ((what, to),) = change.items()
        df = self._read(meta)
        rewritten = None
        if what == "rename_to":
            if to in new["tables"]:
                raise StoreError(f"{to} exists")
            new["tables"][to] = new["tables"].pop(name)
        elif what == "rename_column":
            rewritten = df.withColumnRenamed(*to)
            for c in ("key", "not_null", "unique"):
                meta[c] = [to[1] if x == to[0] else x for x in meta[c]]
            for c in ("defaults", "foreign"):
                meta[c] = {to[1] if k == to[0] else k: v for k, v in meta[c].items()}
        elif what == "add_column":
            added = T.StructType.fromDDL(to[0]).fields[0]
            rewritten = df.withColumn(added.name, F.expr(to[1] or "NULL").cast(added.dataType))
            if to[1]:
                meta["defaults"][added.name] = to[1]
        elif what == "drop_column":
            if to in meta["key"]:
                raise ConstraintError("primary key")
            rewritten = df.drop(to)
        elif what == "set_type":
            rewritten = df.withColumn(to[0], F.col(to[0]).cast(to[1]))
        elif what == "set_default":
            meta["defaults"].pop(to[0], None)
            if to[1] is not None:
                meta["defaults"][to[0]] = to[1]
        elif what in ("set_not_null", "add_check", "add_unique"):
            {"set_not_null": lambda: meta["not_null"].append(to), "add_check": lambda: meta["checks"].update([to]), "add_unique": lambda: meta["unique"].append(to)}[what]()
            self._validate(meta, df, whole=True)
        elif what == "drop_not_null":
            meta["not_null"].remove(to)
        elif what == "drop_check":
            del meta["checks"][to]
        elif what == "drop_unique":
            meta["unique"].remove(to)
        else:
            raise StoreError(f"unknown change {what}")
        if rewritten is not None:
            meta["schema"] = rewritten.schema.jsonValue()
            meta["parts"] = [self._write(rewritten, name)]
        self._publish(new)

    # -- constraints

    def _validate(self, meta: dict, rows: DataFrame, whole: bool = False) -> None:
        """Of rows to be added; whole: of all rows of a table."""
        fail = [(f"not null: {c}", F.col(c).isNull()) for c in [*meta["key"], *meta["not_null"]]]
        fail += [(f"check: {n}", ~F.expr(e)) for n, e in meta["checks"].items()]
        if fail:
            found = rows.agg(*[F.max(F.coalesce(p, F.lit(False))).alias(f"f{i}") for i, (_, p) in enumerate(fail)]).first()
            for i, (name, _) in enumerate(fail):
                if found[i]:
                    raise ConstraintError(name)
        table = self._read(meta)
        for name, columns in [("primary key", meta["key"]), *((f"unique: {u}", [u]) for u in meta["unique"])]:
            if not columns:
                continue
            named = rows.select(*columns).dropna()
            if named.groupBy(*columns).count().filter("count > 1").take(1):
                raise ConstraintError(name)
            if not whole and named.join(table, columns, "left_semi").take(1):
                raise ConstraintError(name)
        for column, (parent, target) in meta["foreign"].items():
            keys = self.table(parent).select(F.col(target).alias(column))
            if rows.filter(F.col(column).isNotNull()).join(keys, column, "left_anti").take(1):
                raise ConstraintError(f"foreign key: {column}")

    def _children(self, name: str, gone: DataFrame) -> None:
        for child, meta in self.now["tables"].items():
            for column, (parent, target) in meta["foreign"].items():
                if parent == name and self.table(child).join(gone.select(F.col(target).alias(column)), column, "left_semi").take(1):
                    raise ConstraintError(f"foreign key: {child}.{column}")

    # -- writing

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _log(self, new: dict, name: str, changes: DataFrame) -> None:
        """changes: the table's columns and _op."""
        meta = new["tables"][name]
        path = self._write(numbered(changes, [*meta["key"], "_op"], "_seq", new["seq"] + 1), f"{name}_log")
        meta["log"].append(path)
        new["seq"] += self.spark.read.parquet(path).count()
        meta["last"] = new["seq"]

    def _complete(self, meta: dict, rows: DataFrame) -> DataFrame:
        schema = self._schema(meta)
        unknown = set(rows.columns) - set(schema.names)
        if unknown:
            raise StoreError(f"no column {sorted(unknown)}")
        if meta["serial"] and meta["serial"] not in rows.columns:
            rows = numbered(rows, rows.columns, meta["serial"], meta["next"])
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.expr(meta["defaults"].get(f.name, "NULL"))).cast(f.dataType).alias(f.name) for f in schema])

    def insert(self, name: str, rows: DataFrame, on_conflict: str | None = None, update: dict[str, str] | None = None) -> DataFrame:
        """Adds rows, all or none, and returns what was written. on_conflict: None, "nothing" or "update" (columns set to literal SQL expressions)."""
        new = copy.deepcopy(self.now)
        meta = self._meta(name, new)
        key = meta["key"]
        if update and set(update) & set(key):
            raise ConstraintError("primary key")
        part = self._write(self._complete(meta, rows), name)
        added = self.spark.read.schema(self._schema(meta)).parquet(part)
        if on_conflict:
            table = self._read(meta)
            known = added.join(table.select(*key), key, "left_semi")
            fresh = added.join(table.select(*key), key, "left_anti").dropDuplicates(key)
            if on_conflict == "update" and known.take(1):
                hits = table.join(added.select(*key).distinct(), key, "left_semi")
                changed = hits.select(*[(F.expr(update[c]).cast(t.dataType) if c in (update or {}) else F.col(c)).alias(c) for c, t in ((f.name, f) for f in self._schema(meta))])
                path = self._write(changed, name)
                changed = self.spark.read.schema(self._schema(meta)).parquet(path)
                self._validate({**meta, "key": [], "unique": [], "parts": []}, changed)
                self._replace(meta, name, hits.select(*key), path)
                self._log(new, name, changed.withColumn("_op", F.lit("PUT")))
            part = self._write(fresh, name)
            added = self.spark.read.schema(self._schema(meta)).parquet(part)
        self._validate(meta, added)
        meta["parts"].append(part)
        if meta["serial"]:
            meta["next"] = max(meta["next"], (added.agg(F.max(meta["serial"])).first()[0] or 0) + 1)
        self._log(new, name, added.withColumn("_op", F.lit("PUT")))
        self._publish(new)
        return added

    def _replace(self, meta: dict, name: str, keys: DataFrame, part: str | None) -> None:
        """Takes the rows of `keys` out of the parts that hold them, and adds a part."""
        if meta["parts"]:
            folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("_part")
            held = self._read(meta).select(*meta["key"], folder).join(keys, meta["key"], "left_semi").select("_part").distinct()
            hit = {r["_part"] for r in held.collect()}  # as many names as parts at most
            old = [p for p in meta["parts"] if p.rsplit("/", 1)[1] in hit]
            meta["parts"] = [p for p in meta["parts"] if p not in old]
            if old:  # rewritten as one part, so that parts do not only grow
                meta["parts"].append(self._write(self._read({**meta, "parts": old}).join(keys, meta["key"], "left_anti"), name))
        meta["parts"] += [part] if part else []

    def update(self, name: str, values: dict[str, str], where: str) -> int:
        """Sets columns to SQL expressions on the rows of `where`; the number of rows."""
        new = copy.deepcopy(self.now)
        meta = self._meta(name, new)
        if set(values) & set(meta["key"]):
            raise ConstraintError("primary key")
        hits = self._read(meta).filter(where)
        path = self._write(hits.withColumns({c: F.expr(e).cast(self._schema(meta)[c].dataType) for c, e in values.items()}), name)
        changed = self.spark.read.schema(self._schema(meta)).parquet(path)
        n = changed.count()
        if n:
            keys = changed.select(*meta["key"])
            self._replace(meta, name, keys, None)
            self._validate(meta, changed)
            meta["parts"].append(path)
            self._log(new, name, changed.withColumn("_op", F.lit("PUT")))
        self._publish(new)
        return n

    def delete(self, name: str, where: str) -> DataFrame:
        """Deletes the rows of `where` and returns them."""
        new = copy.deepcopy(self.now)
        meta = self._meta(name, new)
        path = self._write(self._read(meta).filter(where), f"{name}_deleted")
        gone = self.spark.read.schema(self._schema(meta)).parquet(path)
        if gone.take(1):
            self._children(name, gone)
            self._replace(meta, name, gone.select(*meta["key"]), None)
            self._log(new, name, self._deleted(meta, gone))
        self._publish(new)
        return gone

    def _deleted(self, meta: dict, gone: DataFrame) -> DataFrame:
        return gone.select(*[F.col(f.name) if f.name in meta["key"] else F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema(meta)], F.lit("DELETE").alias("_op"))

    def truncate(self, name: str) -> None:
        new = copy.deepcopy(self.now)
        meta = self._meta(name, new)
        self._log(new, name, self._deleted(meta, self._read(meta)))
        meta["parts"] = []
        self._publish(new)

    # -- changes, branches, copies

    def changes(self, name: str, since: int = 0, limit: int | None = None) -> DataFrame:
        """(_seq, _op, columns) after `since`, in order."""
        if since < self.now["retain"]:
            raise StoreError(f"changes up to {self.now['retain']} are not retained")
        meta = self._meta(name)
        schema = T.StructType([*self._schema(meta).fields, T.StructField("_op", T.StringType()), T.StructField("_seq", T.LongType())])
        log = self.spark.read.schema(schema).parquet(*meta["log"]) if meta["log"] else self.spark.createDataFrame([], schema)
        out = log.filter(F.col("_seq") > since).select("_seq", "_op", *self._schema(meta).names)
        return out.orderBy("_seq").limit(limit) if limit is not None else out

    def branch(self, root: str | None = None) -> Store:
        """A store of its own that shares all parts written so far."""
        state = copy.deepcopy(self.now)
        out = Store(self.spark, root or new_path(self.spark, "branch"), state)
        out.files.create(f"manifest/{state['version']:012d}.json", json.dumps(state))
        return out

    def backup(self, folder: str, version: int | None = None) -> None:
        """Copies the tables of a version: Parquet and the manifest; `restore` reads them."""
        state = copy.deepcopy(self.now if version is None else self.manifest(version))
        for name, meta in state["tables"].items():
            self._read(meta).write.parquet(f"{folder}/{name}")
            meta["parts"], meta["log"] = [f"{folder}/{name}"], []
        Files(self.spark, folder).create("backup.json", json.dumps(state))

    def restore(self, folder: str) -> Store:
        state = json.loads(Files(self.spark, folder).read("backup.json"))
        return Store(self.spark, "", state)

    def dump(self, name: str) -> DataFrame:
        """(line, statement): SQL text that makes a table again, made where the rows are; line 0 creates the table. Write it with df.write.text."""
        meta = self._meta(name)
        schema = self._schema(meta)
        if any(isinstance(f.dataType, (T.ArrayType, T.BinaryType, T.MapType, T.StructType)) for f in schema):
            raise StoreError("a type that SQL text does not carry")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in schema)
        head = f"CREATE TABLE {name} ({columns}, PRIMARY KEY ({', '.join(meta['key'])}))"

        def literal(f: T.StructField):
            text = F.col(f.name).cast("string")
            quoted = text if isinstance(f.dataType, T.NumericType) else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
            return F.coalesce(quoted, F.lit("NULL"))

        rows = numbered(self._read(meta), meta["key"], "_line")
        values = F.concat(F.lit(f"INSERT INTO {name} ({', '.join(schema.names)}) VALUES ("), F.concat_ws(", ", *[literal(f) for f in schema]), F.lit(")"))
        return self.spark.createDataFrame([(0, head)], "line long, statement string").unionByName(rows.select(F.col("_line").alias("line"), values.alias("statement")))

    # -- introspection

    def information_schema(self, what: str) -> DataFrame:
        """tables, columns, views, schemata, table_constraints, key_column_usage or constraint_column_usage."""
        t, v = self.now["tables"], self.now["views"]
        key = lambda n: f"{n}_pkey"
        named = lambda n, m: [(key(n), "PRIMARY KEY", m["key"]), *((f"{n}_{u}_key", "UNIQUE", [u]) for u in m["unique"]), *((f"{n}_{c}_fkey", "FOREIGN KEY", [c]) for c in m["foreign"]), *((c, "CHECK", []) for c in m["checks"])]
        if what == "tables":
            rows = [("public", n, "BASE TABLE") for n in t] + [("public", n, "VIEW") for n in v]
            return self._rows(rows, "table_schema string, table_name string, table_type string")
        if what == "columns":
            rows = [("public", n, f.name, i + 1, f.dataType.simpleString(), "NO" if f.name in [*m["key"], *m["not_null"]] else "YES", m["defaults"].get(f.name)) for n, m in t.items() for i, f in enumerate(self._schema(m))]
            return self._rows(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string")
        if what == "views":
            return self._rows([("public", n, q) for n, q in v.items()], "table_schema string, table_name string, view_definition string")
        if what == "schemata":
            return self._rows([("public",)], "schema_name string")
        if what == "table_constraints":
            return self._rows([("public", n, c, k) for n, m in t.items() for c, k, _ in named(n, m)], "table_schema string, table_name string, constraint_name string, constraint_type string")
        if what == "key_column_usage":
            return self._rows([("public", n, c, x, i + 1) for n, m in t.items() for c, k, cols in named(n, m) if k != "CHECK" for i, x in enumerate(cols)], "table_schema string, table_name string, constraint_name string, column_name string, ordinal_position int")
        if what == "constraint_column_usage":
            rows = [("public", n, c, x) for n, m in t.items() for c, k, cols in named(n, m) if k in ("PRIMARY KEY", "UNIQUE") for x in cols]
            rows += [("public", p, f"{n}_{c}_fkey", x) for n, m in t.items() for c, (p, x) in m["foreign"].items()]
            return self._rows(rows, "table_schema string, table_name string, constraint_name string, column_name string")
        raise StoreError(f"no such table: information_schema.{what}")

    def pg_catalog(self, what: str) -> DataFrame:
        t = sorted([*self.now["tables"], *self.now["views"]])
        oid = {n: 16384 + i for i, n in enumerate(t)}
        if what == "pg_tables":
            return self._rows([("public", n) for n in self.now["tables"]], "schemaname string, tablename string")
        if what == "pg_namespace":
            return self._rows([(2200, "public"), (11, "pg_catalog")], "oid long, nspname string")
        if what == "pg_class":
            return self._rows([(oid[n], n, 2200, "r" if n in self.now["tables"] else "v") for n in t], "oid long, relname string, relnamespace long, relkind string")
        if what == "pg_type":
            return self._rows([(20, "int8"), (25, "text"), (701, "float8"), (16, "bool"), (1700, "numeric"), (1082, "date"), (1114, "timestamp")], "oid long, typname string")
        raise StoreError(f"no such table: {what}")

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def analyze(self, name: str) -> DataFrame:
        """(column, n, n_distinct, low, high): statistics in one pass over the table."""
        df = self.table(name)
        plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.approx_count_distinct(c).alias("n_distinct"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(f"c{i}") for i, c in enumerate(plain)])
        return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*")
