"""The engine: registered collections, SQL over them, search, versions and writes."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence
from dataclasses import astuple, dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import cells, json_text
from docloom.functions.identity import content_hash, derived_uuid, document_id
from docloom.operators import constraints, merge, search
from docloom.operators.access import Access, AccessError
from docloom.plans import syntax as S
from docloom.plans.lower import Lowering, SelectPlan, Source, Val, find, is_search
from docloom.plans.syntax import SqlError
from docloom.sources import indexes
from docloom.sources.log import Log, decide
from docloom.sources.store import GENESIS, Commit, ConflictError, Staged, Store
from docloom.streaming import feed

CONSISTENCY = ("snapshot", "read_committed", "read_your_writes")
SPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


class BoundError(ValueError):
    """A result with more rows than allowed. It is never cut."""


class ConstraintError(ValueError):
    """Documents that break a schema or a unique constraint."""


@dataclass
class Collection:
    """A table: native rows (frame), or documents in a versioned store."""

    name: str
    frame: DataFrame | None = None
    id_column: str | None = None
    doc_column: str | None = None
    store: Store | None = None
    schema: constraints.Schema = field(default_factory=constraints.Schema)
    indexes: dict[str, S.CreateIndex] = field(default_factory=dict)
    pinned: str | None = None

    def definition(self) -> dict:
        """The schema and the indexes, as they are kept with the data."""
        s = self.schema
        return {"schema": {"fields": [astuple(f) for f in s.fields], "unique": s.unique, "version": s.version, "enums": s.enums}, "indexes": [astuple(i) for i in self.indexes.values()]}

    def defined(self, kept: dict) -> None:
        if kept:
            fixed = lambda x: tuple(map(fixed, x)) if isinstance(x, list) else x
            s = kept["schema"]
            self.schema = constraints.Schema(tuple(S.ColumnDef(*f) for f in s["fields"]), fixed(s["unique"]), s["version"], fixed(s["enums"]))
            self.indexes = {i[0]: S.CreateIndex(*fixed(i)) for i in kept["indexes"]}


@dataclass
class Pending:
    """What an open transaction has staged for a collection, and the head it began from."""

    head: str | None
    parts: list[Staged] = field(default_factory=list)
    exclusive: bool = False


@dataclass
class Written:
    """What a write did."""

    operations: DataFrame
    rows: int
    commit: Commit | None = None
    returned: DataFrame | None = None


class Engine:
    """id_column and doc_column are the reserved columns of document collections; `prefix` is what JSON function names may begin with."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, id_column: str = "_id", doc_column: str = "_doc", prefix: str = "", max_rows: int | None = None, namespace: str = SPACE, database: str = "main", user: str | None = None, password: str = "", consistency: str = "read_your_writes"):
        """database: the name of the path in grants. user: what follows is checked against the user's grants; without one nothing is. consistency: snapshot keeps each collection at the head
        that was first read, read_committed looks for newer commits before each read, read_your_writes before each write."""
        if consistency not in CONSISTENCY:
            raise ValueError(f"consistency must be one of {CONSISTENCY}")
        self.database, self.user, self.consistency = database, user, consistency
        self.spark, self.path, self.id_column, self.doc_column, self.prefix, self.max_rows, self.namespace = spark, path, id_column, doc_column, prefix, max_rows, namespace
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        self.collections: dict[str, Collection] = {}
        self.views: dict[str, S.Select] = {}
        self.procedures: dict = {}
        self.pending: dict[str, Pending] | None = None
        self.rights = Access(Log(spark, f"{path}/_access")) if path is not None else None
        if user is not None:
            if self.rights is None:
                raise ValueError("users are kept beside collections, so they need a path")
            self.rights.login(user, password)
        if path is not None:
            for _, entry in Log(spark, f"{path}/_views").entries(0):
                self._view(entry["name"], entry["text"])

    # ---- collections

    def register(self, name: str, frame: DataFrame, id_column: str | None = None, doc_column: str | None = None) -> Collection:
        """A DataFrame as a read-only collection. With doc_column its JSON text answers paths that are no columns."""
        self.collections[name] = Collection(name, frame, id_column, doc_column)
        return self.collections[name]

    def collection(self, name: str) -> Collection:
        if name not in self.collections:
            if self.path is None:
                raise SqlError(f"unknown table {name}")
            c = Collection(name, None, self.id_column, self.doc_column, Store(self.spark, f"{self.path}/{name}"))
            c.defined(c.store.catalog)
            self.collections[name] = c
        return self.collections[name]

    def _granted(self, kind: str, name: str) -> list[str] | None:
        """The ids that the user may read or write; None for all. Without any grant on the collection it is an error."""
        if self.user is None or self.rights.allowed(self.user, kind, self.database, name):
            return None
        ids = self.rights.documents(self.user, kind, self.database, name)
        if not ids:
            raise AccessError(f"{self.user} may not {kind} {name}")
        return ids

    def _staged(self, c: Collection) -> list[tuple[DataFrame, DataFrame | None]]:
        """(operations, changes of attachments) that the open transaction has staged for a collection."""
        own = (self.pending or {}).get(c.name)
        return [(c.store.staged(s.path), c.store.staged_attachments(s.path) if s.attachments else None) for s in own.parts] if own else []

    def documents(self, c: Collection, at: S.At | None = None, attachments: bool = True, where=None, params: Sequence = ()) -> DataFrame:
        """The rows of a collection at a version: id, declared columns, attachments if there ever was one, document text. Of head, rows that can't satisfy `where` may be left out."""
        granted = self._granted("read", c.name)
        if c.store is None:
            if at is not None:
                raise SqlError(f"{c.name} has no versions")
            return c.frame if granted is None else c.frame.where(F.col(f"`{c.id_column}`").cast("string").isin(*granted))
        if self.consistency == "read_committed":
            c.store.refresh()
        elif self.consistency == "snapshot" and c.pinned is None and c.store.head() is not None:
            c.pinned = c.store.head()
        commit = c.pinned if at is None else None
        if at is None and c.pinned:
            snap = c.store.snapshot(c.pinned)
        elif at is None:
            snap = None if where is None or self._staged(c) else self._by_index(c, where, params)
            snap = c.store.snapshot() if snap is None else snap
            for ops, _ in self._staged(c):
                rest = snap.join(ops.select("id"), "id", "left_anti")
                snap = rest.unionByName(ops.where("op = 'write'").select("id", "body"))
        elif at.kind == "COMMIT":
            commit = c.store.resolve(at.value)
            snap = c.store.snapshot(commit)
        elif at.kind == "VERSION":
            commit = c.store.resolve(f"tag:{at.value}")
            snap = c.store.snapshot(commit)
        else:
            try:
                when = datetime.fromisoformat(at.value.replace("Z", "+00:00"))
            except ValueError as x:
                raise SqlError(f"malformed time {at.value!r}") from x
            commit = c.store.at_time(when if when.tzinfo else when.replace(tzinfo=UTC))
            snap = c.store.snapshot(commit)
        snap = snap if granted is None else snap.where(F.col("id").isin(*granted))
        v = F.col("__parsed")
        typed = []
        for f in c.schema.fields:
            kind = constraints.SPARK_TYPE[f.type]
            first = cells.first(v, f.name.split("."))
            ok = constraints.fits(first, f.type, dict(c.schema.enums).get(f.name, ()))
            value = F.try_to_timestamp(F.try_variant_get(first, "$", "string")) if f.type == "timestamp" else F.to_json(first) if kind == "variant" else F.try_variant_get(first, "$", kind)
            typed.append(F.when(ok, value).alias(f.name))
        columns = [F.col("id").alias(c.id_column), *typed, F.col("body").alias(c.doc_column)]
        if attachments and (c.store.has_attachments() or any(changes is not None for _, changes in self._staged(c))):
            own = c.store.attachments(commit)
            for _, changes in self._staged(c):
                if changes is not None:
                    own = own.join(changes.select("id", "name"), ["id", "name"], "left_anti").unionByName(changes.where("op = 'put'").select("id", "aid", "name", "mime", "size", "hash", "content"))
            sets = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("name", "aid", "mime", "size", "hash", "content"))).alias("_attachments"))
            snap = snap.join(sets, "id", "left")
            columns.insert(-1, F.col("_attachments"))
        if typed:
            snap = snap.withColumn("__parsed", F.try_parse_json("body"))  # a column, so the text is parsed once for all fields
        return snap.select(*columns)

    def _by_index(self, c: Collection, where, params: Sequence) -> DataFrame | None:
        """(id, body) of the documents that an index leaves over: by the first condition of WHERE, all of which must hold, that a HASH or BTREE index answers."""
        tables = {i.fields[0][0]: self._built(c, i.name) for i in c.indexes.values() if i.using in ("HASH", "BTREE")}
        instants = {f.name for f in c.schema.fields if f.type == "timestamp"}  # they compare by what their texts mean
        tables = {path: b for path, b in tables.items() if path not in instants and indexes.usable(c.store, b)}
        known = lambda e: e.value if isinstance(e, S.Literal) else params[e.index] if isinstance(e, S.Param) and e.index < len(params) else None
        parts = [where]
        while tables and parts:
            p = parts.pop(0)
            if isinstance(p, S.Binary) and p.op == "AND":
                parts[:0] = [p.left, p.right]
                continue
            name, found = None, None
            if isinstance(p, S.Binary) and p.op in ("=", "<", "<=", ">", ">=") and isinstance(p.left, S.Name):
                name, found = p.left.path, indexes.condition(p.op, known(p.right))
            elif isinstance(p, S.In) and isinstance(p.inner, S.Name):
                each = [indexes.condition("=", known(v)) for v in p.values]
                name, found = p.inner.path, None if any(x is None for x in each) else functools.reduce(lambda a, b: a | b, each)
            elif isinstance(p, S.Between) and isinstance(p.inner, S.Name):
                low, high = indexes.condition(">=", known(p.low)), indexes.condition("<=", known(p.high))
                # One value must satisfy both ends, so the table can be asked for both at once.
                name, found = p.inner.path, None if low is None or high is None else low & high
            if found is not None and name in tables:
                return indexes.key_rows(c.store, tables[name], found)
        return None

    @staticmethod
    def _built(c: Collection, name: str) -> indexes.Built | None:
        kept = c.store.tables.get(name) if c.store is not None else None
        return indexes.Built(**kept | {"lengths": tuple(kept["lengths"])}) if kept else None

    def reindex(self, name: str, *index_names: str) -> None:
        """Builds the derived tables of a collection's indexes (all, or those named) at head."""
        c = self.collection(name)
        for i in [c.indexes[n] for n in index_names] if index_names else c.indexes.values():
            if c.store is not None and i.using in ("HASH", "BTREE", "FULLTEXT"):
                built = indexes.build(c.store, i, dict(i.options).get("analyzer") != "simple")
                if built is not None:
                    c.store.keep_table(i.name, built.__dict__)

    def source(self, t: S.Table, at: S.At | None, params: Sequence, seen: tuple = (), where=None) -> tuple[DataFrame, Source]:
        alias = t.alias or t.name.split(".")[-1]
        if t.name in self.views:
            if t.name in seen:
                raise SqlError(f"view {t.name} holds itself")
            view = self.views[t.name]
            df = self.select(replace(view, at=at) if at else view, params, (*seen, t.name))
            return df, Source(alias, {c: c for c in df.columns})
        c = self.collection(t.name)
        df = self.documents(c, at, where=where, params=params)
        columns = {x: x for x in df.columns}
        variant = None
        if c.doc_column:
            variant = "__variant"
            df = df.withColumn(variant, F.try_parse_json(F.col(f"`{c.doc_column}`")))
        stored = {}
        if c.store is not None and at is None and not c.pinned and not self._staged(c):
            for i in c.indexes.values():
                if i.using == "FULLTEXT" and indexes.usable(c.store, built := self._built(c, i.name)):
                    stored[i.name] = lambda query, simple, i=i, built=built: indexes.text_hits(c.store, built, i, query, not simple)
        return df, Source(alias, columns, c.id_column, c.doc_column, variant, c.indexes, stored=stored)

    # ---- SELECT

    def select(self, q: S.Select, params: Sequence = (), seen: tuple = ()) -> DataFrame:
        if q.table is None:
            if any(isinstance(i.expr, S.Star) for i in q.items) or q.where is not None or q.group or q.order:
                raise SqlError("a SELECT without FROM takes expressions only")
            return SelectPlan(q, Lowering(self.spark, [], self.spark.range(1).select(), params, self.prefix)).frame()
        searched = any(find(e, is_search) for e in [q.where, *[o.expr for o in q.order], *[i.expr for i in q.items]] if e is not None)
        df, source = self.source(q.table, q.at, params, seen, None if q.joins or searched else q.where)
        if not q.joins:
            return SelectPlan(q, Lowering(self.spark, [source], df, params, self.prefix)).frame()
        sources: list[Source] = []
        joined = None
        for n, (t, on) in enumerate([(q.table, None), *[(j.table, j.on) for j in q.joins]]):
            own, s = (df, source) if n == 0 else self.source(t, q.at, params, seen)
            if any(o.alias == s.alias for o in sources):
                raise SqlError(f"{s.alias} is used twice; give an alias")
            own = own.toDF(*[f"{s.alias}__{c}" for c in own.columns])
            s.columns = {k: f"{s.alias}__{v}" for k, v in s.columns.items()}
            s.variant = f"{s.alias}__{s.variant}" if s.variant else None
            sources.append(s)
            if joined is None:
                joined = own
                continue
            columns = self.spark.createDataFrame([], T.StructType([*joined.schema.fields, *own.schema.fields]))
            low = Lowering(self.spark, sources, columns, params, self.prefix)
            joined = joined.join(own, low.test(on), "inner")
        return SelectPlan(q, Lowering(self.spark, sources, joined, params, self.prefix)).frame()

    def sql(self, text: str, params: Sequence = (), *, infer_types: bool = False) -> DataFrame | Written | None:
        """Runs one statement. A SELECT gives a DataFrame (lazy, unless max_rows is set), a write what it did, DDL nothing.

        Paths that are not declared show as text; with infer_types one more pass finds columns that are all numbers or booleans and casts them.
        """
        s = S.parse(text)
        if isinstance(s, S.Select):
            df = self.select(s, params)
            if infer_types:
                df = self.typed(df)
            if self.max_rows is not None and df.limit(self.max_rows + 1).count() > self.max_rows:
                raise BoundError(f"the result has more than {self.max_rows} rows")
            return df
        if isinstance(s, S.Explain):
            return self.explain(s.select, params)
        if isinstance(s, S.Insert):
            return self.insert(s, params)
        if isinstance(s, S.Update):
            return self.update(s, params)
        if isinstance(s, S.Delete):
            return self.delete(s, params)
        return self.define(s, text)

    @staticmethod
    def typed(df: DataFrame) -> DataFrame:
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        if not texts:
            return df
        checks = []
        for n in texts:
            v = F.col(f"`{n}`")
            checks += [F.bool_and(v.isNull() | v.rlike(r"^-?\d{1,18}$")), F.bool_and(v.isNull() | v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), F.bool_and(v.isNull() | v.isin("true", "false")), F.bool_or(v.isNotNull())]
        found = df.agg(*checks).first()
        kinds = {}
        for i, n in enumerate(texts):
            whole, real, truth, some = found[4 * i : 4 * i + 4]
            if some:
                kinds[n] = "bigint" if whole else "double" if real else "boolean" if truth else None
        return df.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) if kinds.get(n) else F.col(f"`{n}`") for n in df.columns])

    def explain(self, q: S.Select, params: Sequence = ()) -> DataFrame:
        """One row: the access path, the rows of the result, the rows of the collection, and Spark's plan. It runs the query."""
        df = self.select(q, params)
        label = self.access(q)
        plan = df._jdf.queryExecution().toString()
        examined = self.documents(self.collection(q.table.name), q.at).count() if q.table and q.table.name not in self.views else 1
        return self.spark.createDataFrame([(label, df.count(), examined, plan)], "plan string, rows bigint, rows_examined bigint, physical string")

    def access(self, q: S.Select) -> str:
        if q.table is None:
            return "singlerow"
        parts = [q.where]
        while any(isinstance(p, S.Binary) and p.op == "AND" for p in parts):
            parts = [x for p in parts for x in ([p.left, p.right] if isinstance(p, S.Binary) and p.op == "AND" else [p])]
        c = self.collections.get(q.table.name)
        keyed = {f for i in (c.indexes.values() if c else ()) for f, _ in i.fields[:1] if i.using in ("HASH", "BTREE")}
        for p in parts:
            if isinstance(p, S.Match | S.Similarity | S.Fuse):
                return "ranked"
            if c and (isinstance(p, S.Binary) and p.op == "=" and isinstance(p.left, S.Name) or isinstance(p, S.In) and isinstance(p.inner, S.Name)):
                path = p.left.path if isinstance(p, S.Binary) else p.inner.path
                if path == c.id_column:
                    return "keylookup"
                if path in keyed:
                    return "index:eq" if isinstance(p, S.Binary) else "index:in"
            if isinstance(p, S.Binary) and p.op in ("<", "<=", ">", ">=") and isinstance(p.left, S.Name) and p.left.path in keyed or isinstance(p, S.Between) and isinstance(p.inner, S.Name) and p.inner.path in keyed:
                return "index:range"
        return "scan"

    def page(self, text: str, size: int, after: str | None = None, params: Sequence = ()) -> tuple[DataFrame, DataFrame]:
        """(rows, next) of a keyset page by id; `next` is empty on the last page, else holds the id to go on after. The SELECT has no ORDER BY or LIMIT."""
        q = S.parse(text)
        c = self.collection(q.table.name)
        key = S.Name(c.id_column)
        bound = S.Binary(">", key, S.Literal(after)) if after is not None else None
        where = q.where if bound is None else bound if q.where is None else S.Binary("AND", bound, q.where)
        items = (*q.items, S.Item(key, "__page"))
        one_more = self.select(replace(q, items=items, where=where, order=(S.Order(key),), limit=size + 1), params)
        rows = one_more.orderBy("__page").limit(size)
        last = rows.agg(F.max("__page").alias("after"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size)
        return rows.drop("__page"), last.join(one_more.agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > size), how="cross").select("after")

    # ---- search

    def search(self, name: str, *, text: tuple[str, str] | None = None, vector: tuple[str, Sequence[float]] | None = None, mode: str = "rrf", limit: int = 50, weights: tuple[float, float] = (1.0, 1.0), depth: int | None = None, min_score: float | None = None, include: bool = False, at: S.At | None = None) -> DataFrame:
        """(id, score[, document]) by one or two arms: text = (index or field, query), vector = (field, vector)."""
        c = self.collection(name)
        df, source = self.source(S.Table(name), at, ())
        low = Lowering(self.spark, [source], df, (), self.prefix)
        arms = []
        if text:
            arms.append(search.Arm(low.hits(S.Match(text[0], S.Literal(text[1])), None), weights[0], depth or search.depth_for(limit, 0), min_score))
        if vector:
            arms.append(search.Arm(low.hits(S.Similarity(vector[0], S.Literal(tuple(vector[1]))), None), weights[-1], depth or search.depth_for(limit, 0), min_score))
        if not arms:
            raise SqlError("search needs text or vector")
        hits = search.best(arms[0].taken(), limit) if len(arms) == 1 else search.fuse(arms, mode, limit)
        if include and c.doc_column:
            hits = hits.join(df.select(F.col(f"`{c.id_column}`").alias("id"), F.col(f"`{c.doc_column}`").alias("document")), "id")
        return hits.orderBy(F.desc("score"), "id")

    # ---- definitions

    def define(self, s, text: str = "") -> None:
        """Definitions of a collection are kept in its log, views and grants in those of the engine; they are there for the next session."""
        if isinstance(s, S.CreateRole | S.CreateUser | S.DropRole | S.Grant):
            if self.rights is None:
                raise SqlError("roles and users are kept beside collections, so they need a path")
            if self.user is not None and not self.rights.allowed(self.user, "admin", self.database, ""):
                raise AccessError(f"{self.user} may not change roles and users")
            return self.rights.change(s)
        if self.user is not None and not isinstance(s, S.Transaction):
            self._granted("admin", getattr(s, "table", getattr(s, "name", "")))
        if isinstance(s, S.CreateTable):
            unique = tuple((c.name,) for c in s.columns if c.unique) + s.unique
            self._redefine(self.collection(s.name), schema=constraints.Schema(s.columns, unique))
        elif isinstance(s, S.AddColumn):
            c = self.collection(s.table)
            self._redefine(c, schema=constraints.migrate(c.schema, [("add_field", s.column.name, s.column)]))
        elif isinstance(s, S.DropTable):
            self._redefine(self.collection(s.name), schema=constraints.Schema())  # the lens goes, the documents stay
        elif isinstance(s, S.CreateIndex):
            c = self.collection(s.table)
            if s.name in c.indexes:
                raise SqlError(f"index {s.name} is there already")
            schema = replace(c.schema, unique=(*c.schema.unique, tuple(f for f, _ in s.fields))) if s.unique else c.schema
            self._redefine(c, schema=schema, indexes=c.indexes | {s.name: s})
            self.reindex(s.table, s.name)
        elif isinstance(s, S.DropIndex):
            c = self.collection(s.table)
            if s.name not in c.indexes:
                raise SqlError(f"no index {s.name}")
            self._redefine(c, indexes={k: v for k, v in c.indexes.items() if k != s.name})
        elif isinstance(s, S.CreateView):
            if s.select.table is not None and s.select.table.name in self.views:
                raise SqlError("a view of a view is not supported")
            self.views[s.name] = s.select
            self._keep_view(s.name, text)
        elif isinstance(s, S.DropView):
            if self.views.pop(s.name, None) is None:
                raise SqlError(f"no view {s.name}")
            self._keep_view(s.name, None)
        elif isinstance(s, S.Transaction):
            self.transaction(s.action)

    def _redefine(self, c: Collection, **changes) -> None:
        for name, value in changes.items():
            setattr(c, name, value)
        if c.store is not None:
            c.store.define(lambda _: c.definition())

    def _view(self, name: str, text: str | None) -> None:
        if text is None:
            self.views.pop(name, None)
        else:
            self.views[name] = S.parse(text).select

    def _keep_view(self, name: str, text: str | None) -> None:
        if self.path is not None:
            log = Log(self.spark, f"{self.path}/_views")
            while not log.append(len(log.entries(0)) + 1, {"name": name, "text": text}):
                pass

    def transaction(self, action: str) -> list[Commit]:
        """Commits of several collections become visible together: each log names the transaction, and a file that is made once says what became of it."""
        if action == "BEGIN":
            if self.pending is not None:
                raise SqlError("a transaction is open already")
            self.pending = {}
            return []
        if self.pending is None:
            raise SqlError("no transaction is open")
        work, self.pending = self.pending, None
        stores = {name: self.collection(name).store for name in work}
        if action == "ROLLBACK":
            for name, p in work.items():
                for s in p.parts:
                    stores[name].discard(s)
            return []
        mark = f"../_transactions/{uuid.uuid4().hex}" if len(work) > 1 else None
        made, whole = [], {}
        try:
            for name, p in work.items():
                whole[name] = self._merged(stores[name], p.parts)
                made.append(stores[name].commit(None, "transaction", staged=whole[name], expected=p.head, exclusive=p.exclusive, txn=mark))
        except ConflictError:
            if mark is not None:
                decide(stores[name].files, f"{self.path}/_transactions/{mark[17:]}", "aborted")
            raise
        if mark is not None and decide(stores[name].files, f"{self.path}/_transactions/{mark[17:]}", "committed") != "committed":
            raise ConflictError("another writer ended the transaction")
        for name, store in stores.items():
            store.refresh()
            store.discard(whole[name])
        return made

    @staticmethod
    def _merged(store: Store, parts: list[Staged]) -> Staged:
        """One staged set: of several operations on a document or an attachment the last counts."""
        if len(parts) == 1:
            return parts[0]
        merged = files = None
        for s in parts:
            ops = store.staged(s.path)
            merged = ops if merged is None else merged.join(ops.select("id"), "id", "left_anti").unionByName(ops)
            if s.attachments:
                changes = store.staged_attachments(s.path).drop("seq", "size", "hash")
                files = changes if files is None else files.join(changes.select("id", "name"), ["id", "name"], "left_anti").unionByName(changes)
        out = store.stage(merged, files, distinct=True)
        for s in parts:
            store.discard(s)
        return out

    # ---- writes

    def _row_json(self, low: Lowering, v: Val):
        return cells.as_json(low.cell(v)) if v.kind not in ("json", "bytes") else F.base64(v.col) if v.kind == "bytes" else F.coalesce(v.col, F.lit("null"))

    def insert(self, s: S.Insert, params: Sequence = ()) -> Written:
        """New documents from VALUES; dotted columns nest. An id that is taken replaces the document, unless ON CONFLICT says otherwise."""
        c = self._writable(s.table.name)
        low = Lowering(self.spark, [], self.spark.range(1).select(), params, self.prefix)
        rows = None
        for r in s.rows:
            body = F.lit("{}")
            values = {}
            cells_of = []
            for name, e in zip(s.columns, r):
                v = values[name] = low.value(e)
                if name == c.doc_column:
                    body = v.col
                elif name != c.id_column:
                    cells_of.append((name, self._row_json(low, v)))
            given = next((values[n] for n in (c.id_column, "id") if n in values), None)
            if given is not None and given.kind not in ("string", "null"):
                raise SqlError("an id must be a string")
            one = self.spark.range(1).select(document_id(self.namespace, F.lit(None).cast("string") if given is None else given.col).alias("id"), body.alias("body"), *[x.alias(f"v{i}") for i, (_, x) in enumerate(cells_of)])
            one = json_text.changed(one, [n for n, _ in cells_of], [])
            rows = one if rows is None else rows.unionAll(one)
        # The rows of a statement, evaluated once: random ids must not change when they are read again.
        return self.write(c, self.spark.createDataFrame(rows.collect(), rows.schema), s.on_conflict, s.returning, params, s.attachments)

    def put(self, name: str, docs: DataFrame, body: str = "body") -> Written:
        """JSON documents of a DataFrame; the id is each document's own `id`, or random."""
        given = F.get_json_object(F.col(body), "$.id")
        return self.write(self._writable(name), docs.select(document_id(self.namespace, given).alias("id"), F.col(body).alias("body")))

    def write(self, c: Collection, rows: DataFrame, conflict: S.OnConflict | None = None, returning: tuple = (), params: Sequence = (), attach: tuple = ()) -> Written:
        """rows (id, body) as new documents. They are evaluated once, when they are staged; with conflict or attach they must not change between reads."""
        head = self._head(c)
        if conflict is not None:
            # A claim is JSON text, so these marks of no claim meet nothing; as keys that are never NULL they spare Spark a second look at every document.
            at = lambda mark: F.coalesce(constraints.claim(F.col("body"), conflict.columns), F.lit(mark))
            now = self._snapshot(c).select(F.col("id").alias("held"), F.col("body").alias("held_body"), at("held").alias("held_claim"))
            joined = rows.select("id", "body", at("new").alias("claim")).join(now, F.col("claim") == F.col("held_claim"), "left")
            joined = self._kept(c, joined.select("id", "body", "held", "held_body"))  # the collection is gone through once
            fresh = joined.where("held IS NULL").select("id", "body")
            if conflict.change is None:
                rows = fresh
            else:
                hit = joined.where("held IS NOT NULL").select(F.col("held").alias("id"), F.col("held_body").alias("body")).dropDuplicates(["id"])
                rows = fresh.unionByName(self._changed(c, hit, conflict.change, conflict.where, params))
        return self._finish(c, rows.select("id", F.lit("write").alias("op"), "body"), head, returning, params, self._attachment_changes(c, rows.select("id", "body"), attach, params), exclusive=conflict is not None)

    def _attachment_changes(self, c: Collection, rows: DataFrame, changes: tuple, params: Sequence) -> DataFrame | None:
        """(id, name, op, aid, mime, content) for the documents of rows (id, body). The id of an attachment is derived from its document and name."""
        out = None
        for a in changes:
            df, source = self._as_source(c, rows)
            low = Lowering(self.spark, [source], df, params, self.prefix)
            key = F.col(f"`{c.id_column}`").alias("id")
            given = low.value(a.name) if a.name is not None else None
            if given is not None and given.kind != "string":
                raise SqlError("an attachment is named by a text")
            aid = lambda name: derived_uuid(self.namespace, F.concat(F.col("id"), F.lit("/"), name))
            if a.action == "SET" and not a.by_id:
                value = low.value(a.value)
                if value.kind != "bytes":
                    raise SqlError("an attachment takes bytes")
                mime = F.lit("application/octet-stream") if a.mime is None else low.value(a.mime).col
                part = df.select(key, (F.uuid() if given is None else given.col).alias("name"), mime.alias("mime"), value.col.alias("content"))
                part = (self._kept(c, part) if given is None else part).select("id", "name", F.lit("put").alias("op"), aid(F.col("name")).alias("aid"), "mime", "content")
            else:
                now = c.store.attachments().select(F.col("id").alias("i"), "aid", "name", "mime", "content")
                picked = df.select(key, given.col.alias("wanted")).join(now, (F.col("id") == F.col("i")) & (F.col("aid" if a.by_id else "name") == F.col("wanted")))
                gone = picked.select("id", "name", F.lit("drop").alias("op"), "aid", "mime", F.lit(None).cast("binary").alias("content"))
                if a.action == "DROP":
                    part = gone
                elif a.action == "SET":
                    part = picked.select("id", "name", F.lit("put").alias("op"), "aid", "mime" if a.mime is None else low.value(a.mime).col.alias("mime"), low.value(a.value).col.alias("content"))
                else:
                    part = gone.unionByName(picked.select("id", low.value(a.value).col.alias("name"), F.lit("put").alias("op"), "aid", "mime", "content"))
            out = part if out is None else out.join(part.select("id", "name"), ["id", "name"], "left_anti").unionByName(part)
        return out

    @staticmethod
    def _kept(c: Collection, rows: DataFrame) -> DataFrame:
        """Rows written to the shared folder and read again: made-up names must not change, and Python must not run twice."""
        at = f"{c.store.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return rows.sparkSession.read.schema(rows.schema).parquet(at)

    def _head(self, c: Collection) -> str | None:
        """The head that a statement works from: the newest one, or that of the open transaction."""
        if self.pending is None:
            c.store.refresh()
            return c.store.head()
        return self.pending.setdefault(c.name, Pending(c.store.head())).head

    def _as_source(self, c: Collection, rows: DataFrame) -> tuple[DataFrame, Source]:
        df = rows.select(F.col("id").alias(c.id_column), F.col("body").alias(c.doc_column), F.try_parse_json("body").alias("__variant"))
        return df, Source(c.name, {c.id_column: c.id_column, c.doc_column: c.doc_column}, c.id_column, c.doc_column, "__variant", c.indexes)

    def _changed(self, c: Collection, rows: DataFrame, change: S.Change, where, params: Sequence) -> DataFrame:
        """rows (id, body) that satisfy `where`, changed. SET reads the document as it was; setting the document column replaces it."""
        df, source = self._as_source(c, rows)
        low = Lowering(self.spark, [source], df, params, self.prefix)
        if where is not None:
            df = df.where(low.test(where))
            low.frame = df
        values = []
        body = F.col(f"`{c.doc_column}`")
        for path, e in change.sets:
            v = low.value(e)
            if path == c.doc_column:
                body = v.col
            else:
                values.append((path, self._row_json(low, v)))
        return json_text.changed(df.select(F.col(f"`{c.id_column}`").alias("id"), body.alias("body"), *[x.alias(f"v{i}") for i, (_, x) in enumerate(values)]), [p for p, _ in values], list(change.removes))

    def update(self, s: S.Update, params: Sequence = ()) -> Written:
        """ORDER BY and LIMIT pick which matching documents are claimed."""
        c = self._writable(s.table.name)
        head = self._head(c)
        rows = self._snapshot(c)
        if s.order or s.limit is not None:
            df, source = self._as_source(c, rows)
            items = (S.Item(S.Name(c.id_column)), S.Item(S.Name(c.doc_column)))
            picked = SelectPlan(S.Select(items, s.table, (), s.where, (), s.order, s.limit), Lowering(self.spark, [source], df, params, self.prefix)).frame()
            changed = self._changed(c, picked.toDF("id", "body"), s.change, None, params)
        else:
            changed = self._changed(c, rows, s.change, s.where, params)
        paths = {p for p, _ in s.change.sets} | set(s.change.removes)
        return self._finish(c, changed.select("id", F.lit("write").alias("op"), "body"), head, s.returning, params, self._attachment_changes(c, changed, s.change.attachments, params), distinct=True, paths=paths, exclusive=s.limit is not None)

    def delete(self, s: S.Delete, params: Sequence = ()) -> Written:
        c = self._writable(s.table.name)
        head = self._head(c)
        df, source = self._as_source(c, self._snapshot(c))
        gone = df if s.where is None else df.where(Lowering(self.spark, [source], df, params, self.prefix).test(s.where))
        return self._finish(c, gone.select(F.col(f"`{c.id_column}`").alias("id"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("body")), head, distinct=True, paths=set())

    def _writable(self, name: str) -> Collection:
        c = self.collection(name)
        if c.store is None or c.pinned:
            raise SqlError(f"{name} can't be written")
        self._granted("write", name)
        return c

    def _snapshot(self, c: Collection) -> DataFrame:
        df = self.documents(replace(c, schema=constraints.Schema()), attachments=False)
        return df.toDF("id", "body")

    def _finish(
        self, c: Collection, ops: DataFrame, head: str | None, returning: tuple = (), params: Sequence = (), files: DataFrame | None = None, *,
        distinct: bool = False, paths: set[str] | None = None, exclusive: bool = False,
    ) -> Written:
        """Stages the operations with what is to be checked of them, checks that, then commits, or keeps them for the open transaction.

        distinct: no id comes twice. paths: the fields that a change touches (None: any); other declared and unique ones need no check. exclusive: nothing else may
        have been committed since `head`; unique constraints ask for that too, for another commit may have taken a value meanwhile.
        """
        store = c.store
        if (own := self._granted("write", c.name)) is not None and not ops.where(~F.col("id").isin(*own)).isEmpty():
            raise AccessError(f"{self.user} may not write other documents of {c.name}")
        near = lambda f: paths is None or c.doc_column in paths or any(p == f or p.startswith(f + ".") or f.startswith(p + ".") for p in paths)
        fields = tuple(f for f in c.schema.fields if near(f.name))
        unique = [u for u in c.schema.unique if any(map(near, u))]
        write = F.col("op") == "write"
        checks = [F.when(write, constraints.claim(F.col("body"), u)).alias(f"claim{i}") for i, u in enumerate(unique)]
        if fields:
            checks.append(F.when(write, constraints.problem(F.col("body"), replace(c.schema, fields=fields))).alias("problem"))
        staged = store.stage(ops, files, distinct=True, checks=checks, checked=bool(fields))
        kinds = "".join(f", claim{i} string" for i in range(len(unique)))
        rows = store.staged(staged.path, kinds)
        try:
            if staged.problem:
                raise ConstraintError(": ".join(staged.problem))
            if staged.rows and (unique or not distinct):
                self._check_claims(c, rows, unique, distinct)
            returned = commit = None
            exclusive = exclusive or bool(unique)
            if self.pending is not None:
                own = self.pending.setdefault(c.name, Pending(head))
                own.parts.append(staged)
                own.exclusive |= exclusive
            elif staged.rows:
                commit = store.commit(None, "write", staged=staged, expected=head, exclusive=exclusive)
            else:
                store.discard(staged)
        except (ConstraintError, ConflictError):
            store.discard(staged)
            raise
        kept = store.parts_of(commit) if commit else rows if self.pending is not None else self.spark.createDataFrame([], "id string, op string, body string")
        kept = kept.select("id", "op", "body")
        if returning:
            df, source = self._as_source(c, kept.where("op = 'write'").select("id", "body"))
            returned = SelectPlan(S.Select(returning, S.Table(c.name)), Lowering(self.spark, [source], df, params, self.prefix)).frame()
        return Written(kept, staged.rows, commit, returned)

    def _check_claims(self, c: Collection, rows: DataFrame, unique: list[tuple[str, ...]], distinct: bool) -> None:
        """No two staged rows may claim the same id or unique value, nor a value that a document holds which they do not replace."""
        claims = [F.struct(F.lit(i).alias("of"), F.col(f"claim{i}").alias("claim")) for i in range(len(unique))]
        ids = [] if distinct else [F.struct(F.lit(-1).alias("of"), F.col("id").alias("claim"))]
        own = rows.select("id", F.explode(F.array(*ids, *claims)).alias("x")).select("id", "x.*").where("claim IS NOT NULL")
        twice = own.groupBy("of", "claim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of")
        if unique and (c.store.head() is not None or self._staged(c)):
            held = self._snapshot(c).join(rows.select("id"), "id", "left_anti")
            held = held.select(F.explode(F.array(*[F.struct(F.lit(i).alias("of"), constraints.claim(F.col("body"), u).alias("claim")) for i, u in enumerate(unique)])).alias("x")).select("x.*")
            twice = twice.unionByName(held.join(own.select("of", "claim"), ["of", "claim"], "left_semi").select("of"))
        for r in twice.limit(1).collect():
            raise ConstraintError("a document is written twice" if r["of"] < 0 else f"{', '.join(unique[r['of']])} must be unique")

    # ---- versions

    def checkout(self, name: str, revision: str | None) -> None:
        """Pins reads of a collection to a revision; None follows head again."""
        c = self.collection(name)
        c.pinned = None if revision is None else c.store.resolve(revision)

    def merge(self, name: str, branch: str, into: str = "main", policy: str = "strict", procedure=None) -> tuple[Commit | None, DataFrame]:
        """(merge commit, deferred conflicts). Documents that one side alone changed are taken; the rest go through the policy. Nothing is committed while a conflict is deferred."""
        store = self.collection(name).store
        procedure = self.procedures.get(procedure, procedure) if isinstance(procedure, str) else procedure
        ours, theirs = store.resolve(f"branch:{into}"), store.resolve(f"branch:{branch}")
        root = store.common_ancestor(ours, theirs)
        base = store.snapshot(root).withColumnRenamed("body", "base") if root != GENESIS else self.spark.createDataFrame([], "id string, base string")
        both = base.join(store.snapshot(theirs).withColumnRenamed("body", "local"), "id", "full_outer").join(store.snapshot(ours).withColumnRenamed("body", "remote"), "id", "full_outer")
        moved = both.where(~F.col("base").eqNullSafe(F.col("local")))
        clean = moved.where(F.col("base").eqNullSafe(F.col("remote"))).select("id", F.when(F.col("local").isNull(), "delete").otherwise("write").alias("op"), F.col("local").alias("body"))
        contested = moved.where(~F.col("base").eqNullSafe(F.col("remote")) & ~F.col("local").eqNullSafe(F.col("remote")))
        decided = self._kept(self.collection(name), merge.resolve(contested, policy, procedure))
        deferred = decided.where("kind = 'defer'")
        if deferred.limit(1).count():
            return None, contested.join(deferred.select("id"), "id", "left_semi")
        ours_ops = decided.select("id", F.when(F.col("kind") == "delete", "delete").otherwise("write").alias("op"), F.col("doc").alias("body"))
        forked = decided.where("kind = 'fork'").select(document_id(self.namespace, F.concat(F.lit("fork:"), "id")).alias("id"), F.lit("write").alias("op"), F.col("doc").alias("body"))
        kept = ours_ops.join(decided.where("kind = 'fork'").select("id"), "id", "left_anti").unionByName(forked)
        return store.commit(clean.unionByName(kept), f"Merge {branch}", branch=into, parents=(ours, theirs)), deferred

    def procedure(self, name: str, source) -> None:
        """Registers a Python callable by name; merge takes it as a conflict procedure."""
        self.procedures[name] = source

    def resolve(self, conflicts: DataFrame, procedure: str, reads: dict[str, str]) -> DataFrame:
        """(id, kind, doc) of conflicts (id, base, local, remote) by a registered procedure of (row, host). host.get(name, key) gives the row of a result of `reads` (name to a SELECT,
        whose first column is the key) as a dict or None, host.query(name) all rows; these results are sent to the executors, so they must be small."""
        held: dict[str, dict] = {}
        for name, text in reads.items():
            df = self.sql(text)
            rows = df.limit(merge.HOST_ROWS + 1).collect()
            if len(rows) > merge.HOST_ROWS:
                raise BoundError(f"{name} has more than {merge.HOST_ROWS} rows")
            held[name] = {r[0]: r.asDict() for r in rows}
        shared = self.spark.sparkContext.broadcast(held)
        call = self.procedures[procedure]
        return merge.resolve(conflicts, "custom", lambda row: call(row, merge.Host(shared.value)))

    def write_if(self, name: str, operations: DataFrame, expected: DataFrame) -> Written:
        """Commits (id, op, body) only if every (id, hash) of `expected` holds: the SHA-256 of the document's text, or NULL for a document that must not be there."""
        c = self._writable(name)
        head = self._head(c)
        now = self._snapshot(c).select(F.col("id").alias("i"), content_hash(F.col("body")).alias("h"))
        broken = expected.join(now, F.col("id") == F.col("i"), "left").where(~F.col("hash").eqNullSafe(F.col("h")))
        if broken.limit(1).count():
            raise ConstraintError("a precondition does not hold")
        return self._finish(c, operations.select("id", "op", "body"), head, exclusive=True)

    def submit(self, name: str, operations: DataFrame, head: str | None) -> tuple[str, str]:
        """What a subscriber's write came to: (applied, commit), (conflict, reason) if its documents have changed since the head that it has seen, or (rejected, reason)."""
        c = self._writable(name)
        try:
            done = self._finish(c, operations.select("id", "op", "body"), head)
        except ConflictError as x:
            return "conflict", str(x)
        except (ConstraintError, AccessError) as x:
            return "rejected", str(x)
        return "applied", done.commit.id if done.commit else ""

    def sweep(self, name: str, field_name: str, now: datetime) -> Written:
        """Commits the deletes of documents whose timestamp field is not later than `now`."""
        c = self._writable(name)
        head = self._head(c)
        at = F.try_to_timestamp(F.get_json_object("body", "$." + field_name))
        return self._finish(c, feed.sweep_expired(self._snapshot(c).withColumn("until", at), "until", F.lit(now)), head, distinct=True, paths=set())

    def predicate(self, text: str, body: str = "body") -> Column:
        """A stand-alone filter over JSON text, as a column; anything that is not true is false."""
        variant = F.try_parse_json(F.col(body))
        source = Source("", {}, self.id_column, body, "__variant")
        low = Lowering(self.spark, [source], None, (), self.prefix)
        low.root = variant
        return F.coalesce(low.test(S.parse_filter(text)), F.lit(False))

    def subscribe(self, name: str, text: str | None = None, after: int = 0) -> DataFrame:
        """The change feed of a collection as a stream, seen through a filter."""
        ops = feed.change_feed(self.spark, self.collection(name).store.path, after)
        return ops if text is None else feed.filtered(ops, self.predicate(text))

    def get(self, name: str, *ids: str) -> DataFrame:
        """Documents by id."""
        c = self.collection(name)
        return self.documents(c).where(F.col(f"`{c.id_column}`").isin(*ids))

    def to_python(self, df: DataFrame) -> list[dict]:
        """Rows of a small result, JSON text parsed where it is an object or array."""
        return [{k: json.loads(v) if isinstance(v, str) and v[:1] in "{[" else v for k, v in r.asDict().items()} for r in df.collect()]
