"""Versioned tables in a folder: a log of commits, and the Parquet files that they brought.

A commit writes what changed, never the whole table: rows by key, and the keys that go. A table at a version is its last whole copy with the
newest change of each key over it; compact() makes a new whole copy. Log entries are files that are created once, so readers see a commit whole
or not at all, and of two writers one fails.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators import change, find, nearest, search
from docweave.operators.change import Conflict
from docweave.schema import SchemaError, Spec
from docweave.sources.fs import Files


class Stale(RuntimeError):
    """The handle is older than the tables' schema or contents."""


#: Versions after which the log is summed up, and changes of a table after which it is written whole.
CHECKPOINT, COMPACT_AFTER = 20, 16
#: Layers of a text index before it is written whole.
LAYERS = 8


class Busy(RuntimeError):
    """Another writer committed first."""


class ReadOnly(RuntimeError):
    pass


class State:
    """What the log says up to a version."""

    def __init__(self, entries: list[dict], before: dict | None = None):
        self.version, self.epoch, self.tables, self.batches = 0, 0, {}, {}
        if before:
            self.version, self.epoch, self.tables, self.batches = before["version"], before["epoch"], before["tables"], before["batches"]
        for e in entries:
            self.version = e["version"]
            self.epoch += e.get("epoch", 0)
            if e.get("reset"):
                self.tables = {}
            for a in e["actions"]:
                t = self.tables.setdefault(a["table"], {"base": None, "changes": [], "meta": None})
                if "meta" in a:
                    t["meta"] = a["meta"]
                if a.get("base"):
                    t["base"], t["changes"] = a["base"], []
                if a.get("change"):
                    t["changes"].append((e["version"], a["change"]))
            self.batches |= e.get("batches", {})

    def paths(self) -> set[str]:
        return {p for t in self.tables.values() for p in [t["base"], *[c for _, c in t["changes"]]] if p}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # the log
    def _numbers(self, ending: str = ".json") -> list[int]:
        return [int(n[: -len(ending)]) for n in self.files.names("_log") if n.endswith(ending)]

    def entries(self, until: int | None = None, since: int = 0) -> list[dict]:
        return [json.loads(self.files.read(f"_log/{n:012d}.json")) for n in self._numbers() if n > since and (until is None or n <= until)]

    def state(self, until: int | None = None) -> State:
        """What holds at a version: the last checkpoint of the log before it, and the entries since."""
        marks = [n for n in self._numbers(".state") if until is None or n <= until]
        before = json.loads(self.files.read(f"_log/{marks[-1]:012d}.state")) if marks else None
        return State(self.entries(until, marks[-1] if marks else 0), before)

    def version(self) -> int:
        return max(self._numbers(), default=0)

    def commit(self, base: int, actions: list[dict], **more) -> int:
        n = base + 1
        if not self.files.create(f"_log/{n:012d}.json", json.dumps({"version": n, "time": time.time(), "actions": actions} | more)):
            raise Busy(f"version {n} was written by another")
        if n % CHECKPOINT == 0:
            s = self.state(n)
            self.files.create(f"_log/{n:012d}.state", json.dumps({"version": s.version, "epoch": s.epoch, "tables": s.tables, "batches": s.batches}))
        return n

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> int:
        """Removes what none of the last keep versions reads, and no writer has touched for hours; older versions can't be read any more. How many folders went."""
        numbers = self._numbers()
        live = set()
        for n in numbers[-max(keep, 1) :]:
            live |= self.state(n).paths()
        gone = [x for x in (f"data/{n}" for n in self.files.names("data")) if x not in live and time.time() - self.files.modified(x) >= 3600 * hours]
        for x in gone:
            self.files.remove(x)
        return len(gone)

    def save(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def load(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")

    def read(self, name: str, version: int | None = None, state: State | None = None) -> DataFrame:
        t = (state or self.state(version)).tables.get(name)
        if t is None or t["meta"] is None:
            raise KeyError(name)
        schema = T.StructType.fromJson(t["meta"]["schema"])
        key = t["meta"]["key"]
        base = self.load(t["base"], schema) if t["base"] else self.spark.createDataFrame([], schema)
        if not t["changes"]:
            return base
        marked = T.StructType([*schema, T.StructField("_deleted", T.BooleanType())])
        news = reduce(DataFrame.unionByName, [self.load(p, marked).withColumn("_version", F.lit(v)) for v, p in t["changes"]])
        if len(t["changes"]) > 1:
            w = Window.partitionBy(f"`{key}`").orderBy(F.desc("_version"))
            news = news.withColumn("_n", F.row_number().over(w)).where("_n = 1")
        live = news.where("not _deleted").select(*[f"`{c}`" for c in schema.names])
        return base.join(news.select(f"`{key}`"), key, "left_anti").select(*[f"`{c}`" for c in schema.names]).unionByName(live)

    def names(self) -> list[str]:
        return sorted(n for n, t in self.state().tables.items() if t["meta"])

    # tables
    def register(self, name: str, spec: Spec, version: int = 0, steps: dict[int, tuple[int, Callable[[DataFrame], DataFrame]]] | None = None, key: Column | None = None, progress: Callable[[int, int], None] | None = None, embedder=None) -> Table:
        """A handle of the table, which is made or migrated if need be. steps: from a schema version to the next with what it does to the rows. key: derives the key column, for schemas without one.

        progress: called with (0, rows) before a migration and (rows, rows) once it is committed. embedder: a Column, or a function from rows to one, that makes missing vectors; with it, a migration to another dimension makes all vectors anew."""
        from docweave.operators.migrate import migrated

        state = self.state()
        own = spec.key or "_key"
        if spec.key is None and key is None:
            raise SchemaError("a schema without a primary key needs a key expression")
        schema = spec.schema if spec.key else T.StructType([T.StructField("_key", T.StringType(), False, {"pk": True}), *spec.schema])
        meta = {"schema": schema.jsonValue(), "key": own, "fingerprint": Spec(schema).fingerprint(), "schema_version": version}
        there = state.tables.get(name)
        if there is None or there["meta"] is None:
            self.commit(state.version, [{"table": name, "meta": meta}])
        elif there["meta"]["fingerprint"] != meta["fingerprint"] or version > there["meta"]["schema_version"] and steps:
            old = there["meta"]
            if version <= old["schema_version"]:
                raise SchemaError(f"{name} has another schema at version {old['schema_version']}; a migration needs a higher version than {version}")
            rows = self.read(name, state=state)
            if progress:
                total = rows.count()
                progress(0, total)
            rows = migrated(rows, T.StructType.fromJson(old["schema"]), schema, old["schema_version"], version, steps, embedder)
            saved = self.save(rows.repartition(F.col(f"`{own}`")))
            stored = self.load(saved, schema)
            self.check(Spec(schema), stored, stored)
            self.commit(state.version, [{"table": name, "meta": meta, "base": saved}], epoch=1)
            if progress:
                progress(total, total)
        return Table(self, name, Spec(schema), self.state().epoch, key, embedder)

    def check(self, spec: Spec, news: DataFrame, whole: DataFrame) -> None:
        """Raises where keys are null or repeat, or unique values or vectors of news don't fit whole."""
        if not news.where(F.col(f"`{spec.key}`").isNull()).isEmpty():
            raise Conflict((spec.key,))
        if not news.groupBy(F.col(f"`{spec.key}`").alias("key")).count().where("count > 1").isEmpty():
            raise Conflict((spec.key,))
        for fields in spec.groups("unique").values():
            touched = whole if news is whole else whole.join(news.select(*fields).distinct(), fields, "left_semi")
            if not change.violations(touched, fields, spec.key).isEmpty():
                raise Conflict(tuple(fields))
        if spec.vector:
            column, settings = spec.vector
            size = F.size(F.col(f"`{column}`"))
            dim = settings["dim"] or whole.where(size > 0).agg(F.min(size)).first()[0]
            if dim and not nearest.invalid(news, column, dim).isEmpty():
                raise nearest.VectorError(f"a vector of {column} isn't {dim} finite numbers")

    def begin(self, write: bool = True) -> Transaction:
        return Transaction(self, write)

    def wipe(self) -> int:
        """Drops every row. Handles stay good."""
        state = self.state()
        return self.commit(state.version, [{"table": n, "meta": t["meta"]} for n, t in state.tables.items() if t["meta"]], reset=True)

    # backups
    def backup(self, path: str, since: int = 0, until: int | None = None) -> int:
        """Writes what was committed after since, and up to until, to a new folder; returns the version that it reaches."""
        state = self.state(until)
        out = Files(self.spark, path)
        tables: dict[str, dict] = {}
        entries = self.entries(until)
        for name, t in state.tables.items():
            if not t["meta"]:
                continue
            newer = [a for e in entries if e["version"] > since for a in e["actions"] if a["table"] == name] if since else None
            whole = newer is None or any(e["version"] > since and e.get("reset") for e in entries) or any(a.get("base") for a in newer)
            tables[name] = {"meta": t["meta"], "whole": whole}
            if whole:
                self.read(name, state=state).write.parquet(f"{path}/{name}")
            elif changes := [(v, p) for v, p in t["changes"] if v > since]:
                marked = T.StructType([*T.StructType.fromJson(t["meta"]["schema"]), T.StructField("_deleted", T.BooleanType())])
                rows = reduce(DataFrame.unionByName, [self.load(p, marked).withColumn("_version", F.lit(v)) for v, p in changes])
                w = Window.partitionBy(f"`{t['meta']['key']}`").orderBy(F.desc("_version"))
                rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_version").write.parquet(f"{path}/{name}")
            else:
                tables[name]["none"] = True
        out.create("backup.json", json.dumps({"since": since, "version": state.version, "tables": tables}))
        return state.version

    def _taken(self, path: str) -> tuple[dict, dict[str, DataFrame]]:
        said = json.loads(Files(self.spark, path).read("backup.json"))
        frames = {}
        for name, t in said["tables"].items():
            if not t.get("none"):
                schema = T.StructType.fromJson(t["meta"]["schema"])
                frames[name] = self.spark.read.schema(schema if t["whole"] else schema.add("_deleted", "boolean")).parquet(f"{path}/{name}")
        return said, frames

    def restore(self, path: str) -> int:
        """Everything is replaced by a full backup; older handles are stale."""
        said, frames = self._taken(path)
        if said["since"]:
            raise ValueError("an incremental backup can only be applied")
        actions = [{"table": n, "meta": t["meta"], "base": self.save(frames[n])} for n, t in said["tables"].items()]
        return self.commit(self.version(), actions, reset=True, epoch=1)

    def apply(self, path: str) -> int:
        """Merges a backup: its rows replace those of the same keys, and its deletes go. Handles are stale if a schema changed."""
        said, frames = self._taken(path)
        state = self.state()
        actions, changed = [], 0
        for name, t in said["tables"].items():
            own = state.tables.get(name)
            other = own is None or own["meta"] is None or own["meta"]["fingerprint"] != t["meta"]["fingerprint"]
            changed |= other
            if name not in frames:
                actions.append({"table": name, "meta": t["meta"]})
            elif other:
                actions.append({"table": name, "meta": t["meta"], "base": self.save(frames[name] if t["whole"] else frames[name].where("not _deleted").drop("_deleted"))})
            else:
                rows = frames[name] if "_deleted" in frames[name].columns else frames[name].withColumn("_deleted", F.lit(False))
                actions.append({"table": name, "change": self.save(rows)})
        return self.commit(state.version, actions, epoch=int(changed))

    def compact(self, name: str, sort: list[str] | None = None) -> int:
        """A new whole copy, in files sorted by the fields that are filtered most, so that reading skips row groups."""
        state = self.state()
        t = state.tables[name]
        spec = Spec(T.StructType.fromJson(t["meta"]["schema"]))
        by = sort or [f for g in spec.groups("index").values() for f in g] or [t["meta"]["key"]]
        rows = self.read(name, state=state)
        return self.commit(state.version, [{"table": name, "base": self.save(rows.repartitionByRange(*by).sortWithinPartitions(*by))}])


class Transaction:
    """Changes of any tables over one snapshot, seen by its own reads, and committed together."""

    def __init__(self, catalog: Catalog, write: bool = True):
        self.catalog, self.writes, self.state = catalog, write, catalog.state()
        self.staged: dict[str, tuple[DataFrame, DataFrame]] = {}  # rows, keys that go
        self.after: list[Callable[[], None]] = []
        self.batches: dict[str, int] = {}
        self.open = True

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind is None and self.writes and self.open:
            self.commit()
        self.open = False

    def _ready(self, table: Table) -> None:
        if not self.open:
            raise ReadOnly("the transaction is over")
        if not self.writes:
            raise ReadOnly("the transaction only reads")
        if table.catalog.root != self.catalog.root:
            raise ValueError("the table belongs to another catalog")
        table.current(self.state)

    def read(self, table: Table) -> DataFrame:
        table.current(self.state)
        df = self.catalog.read(table.name, state=self.state)
        if table.name in self.staged:
            rows, gone = self.staged[table.name]
            df = change.upsert(change.delete(df, gone, table.spec.key), rows, table.spec.key)
        return df

    def insert(self, table: Table, rows: DataFrame, order: str | None = None, new: bool = False) -> None:
        """Upserts rows; of a key that comes more than once, the last by order. new: keys must not be there yet."""
        self._ready(table)
        rows = table.shaped(change.last_of_each(table.keyed(rows), table.spec.key, order))
        if new and not change.conflicts(self.read(table), rows, table.spec.key).isEmpty():
            raise Conflict((table.spec.key,))
        before, gone = self.staged.get(table.name, (None, None))
        key = table.spec.key
        self.staged[table.name] = (change.upsert(before, rows, key) if before is not None else rows, change.delete(gone, rows, key) if gone is not None else rows.select(key).where("false"))

    def delete(self, table: Table, keys: DataFrame) -> None:
        self._ready(table)
        key = table.spec.key
        keys = keys.select(F.col(f"`{key}`"))
        before, gone = self.staged.get(table.name, (None, None))
        rows = change.delete(before, keys, key) if before is not None else self.catalog.read(table.name, state=self.state).where("false")
        self.staged[table.name] = (rows, keys.distinct() if gone is None else gone.union(keys).distinct())

    def on_commit(self, call: Callable[[], None]) -> None:
        self.after.append(call)

    def commit(self) -> int:
        c, actions = self.catalog, []
        for name, (rows, gone) in self.staged.items():
            t = self.state.tables[name]
            schema = T.StructType.fromJson(t["meta"]["schema"])
            spec = Spec(schema)
            empty = [F.col(f"`{f.name}`") if f.name == spec.key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            path = c.save(rows.withColumn("_deleted", F.lit(False)).unionByName(gone.select(*empty).withColumn("_deleted", F.lit(True))))
            marked = T.StructType([*schema, T.StructField("_deleted", T.BooleanType())])
            news = c.load(path, marked)  # computed once, then checked
            old = c.read(name, state=self.state)
            key = spec.key
            live = news.where("not _deleted").drop("_deleted")
            try:
                c.check(spec, live, old.join(news.select(f"`{key}`"), key, "left_anti").select(*[f"`{x}`" for x in schema.names]).unionByName(live))
            except ValueError:
                c.files.remove(path)
                raise
            actions.append({"table": name, "change": path})
        self.open = False
        version = c.commit(self.state.version, actions, batches=self.batches) if actions or self.batches else self.state.version
        for call in self.after:
            call()
        for name in self.staged:
            if len(self.state.tables[name]["changes"]) + 1 >= COMPACT_AFTER:
                try:
                    c.compact(name)
                except Busy:  # another writer is first; the next commit tries again
                    pass
        return version


class Table:
    def __init__(self, catalog: Catalog, name: str, spec: Spec, epoch: int, key: Column | None = None, embedder=None):
        self.catalog, self.name, self.spec, self.epoch, self.derive, self.embedder = catalog, name, spec, epoch, key, embedder
        self.tokenizer = None
        self._index: tuple[int, search.TextIndex] | None = None

    def current(self, state: State | None = None) -> State:
        state = state or self.catalog.state()
        if state.epoch != self.epoch:
            raise Stale(f"{self.name} was registered before the tables were replaced or migrated")
        return state

    def keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.spec.key, self.derive) if self.derive is not None else rows

    def shaped(self, rows: DataFrame) -> DataFrame:
        """rows with the table's columns and types; what is missing is null."""
        if self.spec.vector and self.embedder is not None:
            column = self.spec.vector[0]
            rows = change.embed(rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast(self.spec.schema[column].dataType)), column, self.embedder)
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.spec.schema])

    def df(self, version: int | None = None) -> DataFrame:
        self.current()
        return self.catalog.read(self.name, version)

    # reads
    def _shown(self, df: DataFrame) -> DataFrame:
        v = self.spec.vector
        return df.drop(v[0]) if v and not v[1]["inline"] else df

    def find(self, query="") -> DataFrame:
        return find.find(self._shown(self.df()), query, self.spec.key)

    def walk(self, query="") -> Iterator[Row]:
        return find.walk(self._shown(self.df()), query)

    def count(self, query="") -> int:
        return find.count(self.df(), query).first()["n"]

    def exists(self, query="") -> bool:
        return find.exists(self.df(), query)

    def get(self, key) -> Row:
        return find.get(self._shown(self.df()), self.spec.key, key)

    def _touched(self, since: int, now: State) -> DataFrame | None:
        """The keys that changes after a version wrote or deleted; None if the table was written whole since."""
        for e in self.catalog.entries(now.version, since):
            if e.get("reset") or e.get("epoch"):
                return None
        changes = [(v, p) for v, p in now.tables[self.name]["changes"] if v > since]
        written = [a["change"] for e in self.catalog.entries(now.version, since) for a in e["actions"] if a["table"] == self.name and a.get("change")]
        if len(written) != len(changes):  # compacted since: the rows are the same, but what changed is read from the log
            changes = [(0, p) for p in written]
        marked = T.StructType([*self.spec.schema, T.StructField("_deleted", T.BooleanType())])
        frames = [self.catalog.load(p, marked).select(F.col(f"`{self.spec.key}`").alias("key")) for _, p in changes]
        return reduce(DataFrame.unionByName, frames).distinct() if frames else self.catalog.spark.createDataFrame([], T.StructType([T.StructField("key", self.spec.schema[self.spec.key].dataType)]))

    def index(self) -> search.TextIndex:
        """The inverted index of the current version, kept in the catalog's folder. A new version adds a layer with the documents that changed; only they are split into terms."""
        now = self.current()
        if not self.spec.texts:
            raise search.NoTextFields(f"{self.name} has no field for text search")
        if self._index is not None and self._index[0] == now.version:
            return self._index[1]
        files, folder = self.catalog.files, f"_index/{self.name}/{self.spec.fingerprint()}"
        made = [int(n[:-5]) for n in files.names(folder) if n.endswith(".json") and int(n[:-5]) <= now.version]
        layers, keys = [], None
        if made:
            layers = json.loads(files.read(f"{folder}/{made[-1]:012d}.json"))
            keys = self._touched(made[-1], now) if made[-1] < now.version else None
        if not made or made[-1] < now.version:
            rows = self.catalog.read(self.name, state=now)
            path = f"{folder}/{uuid.uuid4().hex}"
            root = f"{self.catalog.root}/{path}"
            if not made or keys is None or len(layers) >= LAYERS:
                search.build(rows, self.spec.key, self.spec.texts, self.tokenizer).write(root)
                layers = [{"path": path, "keys": False}]
            else:
                keys.write.parquet(f"{root}/keys")
                keys = self.catalog.spark.read.parquet(f"{root}/keys")
                news = rows.join(keys.withColumnRenamed("key", self.spec.key), self.spec.key, "left_semi")
                search.build(news, self.spec.key, self.spec.texts, self.tokenizer).write(root)
                layers = [*layers, {"path": path, "keys": True}]
            files.create(f"{folder}/{now.version:012d}.json", json.dumps(layers))
        self._index = (now.version, self._layered(layers))
        return self._index[1]

    def _layered(self, layers: list[dict]) -> search.TextIndex:
        out = None
        for x in layers:
            root = f"{self.catalog.root}/{x['path']}"
            own = search.TextIndex.read(self.catalog.spark, root, self.spec.key)
            out = own if out is None else out.without(self.catalog.spark.read.parquet(f"{root}/keys"), own)
        return out

    def search(self, query: str, limit: int = 10, offset: int = 0, filter=None, key_filter: Column | None = None) -> DataFrame:
        return search.search(self.index(), query, self._shown(self.df()), limit, offset, filter, key_filter)

    def search_walk(self, query: str, filter=None, key_filter: Column | None = None) -> Iterator[Row]:
        """All hits, best first; stopping early leaves the rest unread."""
        yield from search.walk(self.index(), query, self._shown(self.df()), filter, key_filter)

    def totals(self, query: str, filter=None, key_filter: Column | None = None) -> Row:
        return search.totals(self.index(), query, self.df(), filter, key_filter).first()

    def nearest(self, query, k: int = 10, metric: str | None = None, filter=None) -> DataFrame:
        if not self.spec.vector:
            raise nearest.VectorError(f"{self.name} has no vector")
        column, settings = self.spec.vector
        found = nearest.nearest(self.df(), column, query, self.spec.key, k, metric or settings["metric"], filter, settings["dim"] or None)
        return self._shown(found)

    # writes
    def insert(self, rows: DataFrame, order: str | None = None) -> int:
        with self.catalog.begin() as tx:
            tx.insert(self, rows, order)
            return tx.commit()

    update = insert

    def insert_new(self, rows: DataFrame) -> int:
        with self.catalog.begin() as tx:
            tx.insert(self, rows, new=True)
            return tx.commit()

    def delete(self, keys: DataFrame) -> int:
        with self.catalog.begin() as tx:
            tx.delete(self, keys)
            return tx.commit()

    def find_and_update(self, query, changes: dict[str, Column] | Callable[[DataFrame], DataFrame]) -> int:
        """Rows that the query finds, with its sort and page, are changed and written back; a function may leave rows out, which stay."""
        with self.catalog.begin() as tx:
            found = find.find(tx.read(self), query, self.spec.key)
            tx.insert(self, changes(found) if callable(changes) else found.withColumns(changes))
            return tx.commit()
