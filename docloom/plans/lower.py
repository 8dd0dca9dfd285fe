"""Lowering of the SQL dialect to DataFrames: names and types are checked here, everything else is left to Catalyst.

A value is typed (a Spark column of known kind; comparisons stay plain and can be pushed to the scan) or a cell (see functions.cells) with all candidates
that a path reaches. Predicates hold if any candidate satisfies them; projections and sort keys use the first. Comparisons with null are false, so NOT
of one is true: three-valued results are closed with coalesce under NOT and in projections only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import cells, json_text
from docloom.operators import search
from docloom.plans import syntax as S
from docloom.plans.syntax import SqlError

AGGREGATES = ("count", "sum", "avg", "min", "max")
NUMBERS = ("bool", "long", "double")


@dataclass
class Val:
    kind: str  # bool long double string timestamp bytes json null cell predicate
    col: Column
    many: Column | None = None  # array of candidates, cells if kind is cell, else of `element` kind
    element: str | None = None
    literal: object = None
    is_literal: bool = False


@dataclass
class Source:
    """A collection in FROM: its columns (name to column of the joined frame), id, document text, and full-text and vector indexes by name."""

    alias: str
    columns: dict[str, str]
    id_column: str | None = None
    doc_column: str | None = None
    variant: str | None = None
    indexes: dict[str, S.CreateIndex] = field(default_factory=dict)
    frame: DataFrame | None = None
    attachments: DataFrame | None = None
    stored: dict[str, Callable] = field(default_factory=dict)  # full-text indexes with a stored table: (query, simple) -> hits


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "long"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "double"
    if isinstance(t, T.StringType | T.CharType | T.VarcharType):
        return "string"
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "timestamp"
    if isinstance(t, T.BinaryType):
        return "bytes"
    return "json"


def pattern_of(p: str) -> str:
    return p.replace("\\", "\\\\")


class Lowering:
    def __init__(self, spark: SparkSession, sources: Sequence[Source], frame: DataFrame | None, params: Sequence = (), prefix: str = "", scores: dict | None = None):
        self.spark, self.sources, self.frame, self.params, self.prefix = spark, list(sources), frame, list(params), prefix
        self.scores: dict = scores if scores is not None else {}
        self.root: Column | None = None  # the document, where it is no column of the frame
        self.aliases: dict[str, Val] = {}
        self.grouped: dict | None = None  # expression -> Val, once a query is grouped

    # ---- names

    def name(self, path: str) -> Val:
        parts = path.split(".")
        sources = self.sources
        own = [s for s in sources if s.alias == parts[0]]
        if own and len(parts) > 1 and parts[0] not in own[0].columns:
            sources, parts = own, parts[1:]
        found = [s for s in sources if parts[0] in s.columns]
        if len(found) > 1:
            raise SqlError(f"{path} is in more than one table")
        if found:
            return self.typed_path(found[0], parts)
        docs = [s for s in sources if s.variant]
        if len(docs) == 1:
            many = cells.walk(self.root if self.root is not None else F.col(f"`{docs[0].variant}`"), parts)
            first = F.coalesce(F.get(F.transform(F.slice(many, 1, 1), cells.of_variant), F.lit(0)), cells.make(cells.NULL))
            return Val("cell", first, many=F.transform(cells.opened(many), cells.of_variant), element="cell", literal=many)
        raise SqlError(f"unknown column {path}")

    def typed_path(self, source: Source, parts: list[str]) -> Val:
        name = source.columns[parts[0]]
        col, kind, several = F.col(f"`{name}`"), self.frame.schema[name].dataType, False
        for i, p in enumerate(parts[1:]):
            while isinstance(kind, T.ArrayType):
                col = F.flatten(col) if several else col
                kind, several = kind.elementType, True
            if not isinstance(kind, T.StructType) or p not in kind.fieldNames():
                raise SqlError(f"unknown column {'.'.join(parts)}")
            kind = kind[p].dataType
            col = F.transform(col, lambda x: x[p]) if several else col[p]
        if several:
            many, inner = (F.flatten(col), kind.elementType) if isinstance(kind, T.ArrayType) else (col, kind)  # an array at the end is opened once
            first = F.get(F.filter(col, lambda x: x.isNotNull()), F.lit(0)) if not isinstance(kind, T.ArrayType) else F.get(col, F.lit(0))
            k = kind_of(inner)
            one = F.to_json(first) if kind_of(kind) == "json" else first
            return Val(kind_of(kind), one, many=F.coalesce(many, F.array().cast(T.ArrayType(inner))), element=k)
        if isinstance(kind, T.ArrayType):
            inner, many = kind.elementType, col
            return Val("json", F.to_json(col), many=F.coalesce(many, F.array().cast(T.ArrayType(inner))), element=kind_of(inner), literal=col)
        if kind_of(kind) == "json":
            return Val("json", F.to_json(col), literal=col)
        return Val(kind_of(kind), col)

    # ---- values

    def literal(self, v: object) -> Val:
        if v is None:
            return Val("null", F.lit(None).cast("string"), literal=None, is_literal=True)
        if isinstance(v, list | tuple):
            return Val("json", F.to_json(F.array(*[F.lit(float(x)) for x in v])), literal=list(v), is_literal=True)
        kind = {bool: "bool", int: "long", float: "double", str: "string", bytes: "bytes"}[type(v)]
        return Val(kind, F.lit(v).cast("bigint") if kind == "long" else F.lit(v), literal=v, is_literal=True)

    def value(self, e) -> Val:
        if self.grouped is not None and e in self.grouped:
            return self.grouped[e]
        if isinstance(e, S.Literal):
            return self.literal(e.value)
        if isinstance(e, S.Param):
            return self.literal(self.params[e.index] if e.index < len(self.params) else None)
        if isinstance(e, S.Name):
            if self.grouped is not None:
                if e.path in self.aliases:
                    return self.aliases[e.path]
                raise SqlError(f"{e.path} must be in GROUP BY or in an aggregate")
            try:
                return self.name(e.path)
            except SqlError:
                if e.path in self.aliases:
                    return self.aliases[e.path]
                raise
        if isinstance(e, S.Binary) and e.op in "+-*/":
            return self.arithmetic(e.op, self.value(e.left), self.value(e.right))
        if isinstance(e, S.Case):
            whens = [(self.test(c), self.value(v)) for c, v in e.whens]
            return self.choice([c for c, _ in whens], [v for _, v in whens], self.value(e.otherwise) if e.otherwise is not None else self.literal(None))
        if isinstance(e, S.Match | S.Similarity | S.Fuse):
            return self.score(e)
        if isinstance(e, S.Call):
            return self.call(e)
        return Val("bool", F.coalesce(self.test(e), F.lit(False)))

    def cell(self, v: Val) -> Column:
        return v.col if v.kind == "cell" else cells.of_typed(v.col, "string" if v.kind == "bytes" else v.kind)

    def candidates(self, v: Val) -> Column:
        """array<cell> for predicates."""
        if v.kind == "cell":
            return v.many if v.many is not None else F.array(v.col)
        if v.many is not None:
            return F.transform(v.many, lambda x: cells.of_typed(F.to_json(x) if v.element == "json" else x, v.element))
        return F.array(self.cell(v))

    def number(self, v: Val) -> Val:
        """An operand of arithmetic; a boolean column counts as 0 or 1, a boolean literal is none."""
        if v.kind == "bool" and not v.is_literal:
            return Val("long", v.col.cast("bigint"))
        if v.kind in ("long", "double", "cell"):
            return v
        return Val("null", F.lit(None).cast("bigint"))

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        a, b = self.number(a), self.number(b)
        if "null" in (a.kind, b.kind):
            return Val("long", F.lit(None).cast("bigint"))
        whole = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}

        def longs(x: Column, y: Column) -> Column:
            x, y = x.cast("bigint"), y.cast("bigint")
            if op == "/":
                return F.when(y == -1, F.try_subtract(F.lit(0).cast("bigint"), x)).when(y != 0, F.call_function("div", x, y))
            return whole[op](x, y)

        def doubles(x: Column, y: Column) -> Column:
            x, y = x.cast("double"), y.cast("double")
            return F.try_divide(x, y) if op == "/" else {"+": x + y, "-": x - y, "*": x * y}[op]

        if "cell" not in (a.kind, b.kind):
            return Val("long", longs(a.col, b.col)) if a.kind == b.kind == "long" else Val("double", doubles(a.col, b.col))

        def both(x: Column, y: Column) -> Column:
            exact, real = longs(x["l"], y["l"]), doubles(x["d"], y["d"])
            are_whole = x["l"].isNotNull() & y["l"].isNotNull()
            t = F.when((x["t"] > cells.DOUBLE) | (y["t"] > cells.DOUBLE) | (x["t"] == 0) | (y["t"] == 0), cells.NULL).when(are_whole, F.when(exact.isNull(), cells.NULL).otherwise(cells.LONG)).otherwise(F.when(real.isNull(), cells.NULL).otherwise(cells.DOUBLE))
            return cells.make(t, F.when(are_whole, exact), F.when(are_whole, exact.cast("double")).otherwise(real))

        return Val("cell", cells.let(self.cell(a), lambda x: cells.let(self.cell(b), lambda y: both(x, y))))

    def choice(self, tests: list[Column], values: list[Val], otherwise: Val) -> Val:
        """The value of the first test that holds."""
        kinds = {v.kind for v in [*values, otherwise]} - {"null"}
        if len(kinds) <= 1 or kinds == {"long", "double"}:
            kind = "double" if "double" in kinds else next(iter(kinds), "null")
            cast = (lambda c: c.cast("double")) if kind == "double" else (lambda c: c)
            out = None
            for t, v in zip(tests, values):
                c = self.null_of(kind) if v.kind == "null" else cast(v.col)
                out = F.when(t, c) if out is None else out.when(t, c)
            last = self.null_of(kind) if otherwise.kind == "null" else cast(otherwise.col)
            return Val(kind, last if out is None else out.otherwise(last))
        out = None
        for t, v in zip(tests, values):
            out = F.when(t, self.cell(v)) if out is None else out.when(t, self.cell(v))
        return Val("cell", out.otherwise(self.cell(otherwise)))

    def null_of(self, kind: str) -> Column:
        if kind == "cell":
            return cells.make(cells.NULL)
        return F.lit(None).cast({"bool": "boolean", "long": "bigint", "double": "double", "timestamp": "timestamp", "bytes": "binary"}.get(kind, "string"))

    def is_null(self, v: Val) -> Column:
        return v.col["t"] == cells.NULL if v.kind == "cell" else v.col.isNull()

    # ---- predicates

    def test(self, e) -> Column:
        """A boolean column; null counts as false."""
        if isinstance(e, S.Binary) and e.op == "AND":
            return self.test(e.left) & self.test(e.right)
        if isinstance(e, S.Binary) and e.op == "OR":
            return self.test(e.left) | self.test(e.right)
        if isinstance(e, S.Not):
            return ~F.coalesce(self.test(e.inner), F.lit(False))
        if isinstance(e, S.IsNull):
            return self.is_null(self.value(e.inner))
        if isinstance(e, S.In):
            inner = self.value(e.inner)
            values = [self.value(v) for v in e.values]
            plain = inner.kind in ("long", "double", "string") and inner.many is None and all(v.is_literal and v.kind in ("long", "double", "string") for v in values)
            if plain:
                fit = [v.literal for v in values if (v.kind == "string") == (inner.kind == "string")]
                return inner.col.isin(*fit) if fit else F.lit(False)
            out = F.lit(False)
            for v in values:
                out = out | F.coalesce(self.compare("=", inner, v), F.lit(False))
            return out
        if isinstance(e, S.Between):
            return self.between(self.value(e.inner), self.value(e.low), self.value(e.high))
        if isinstance(e, S.Binary) and e.op in ("LIKE", "ILIKE"):
            return self.like(e)
        if isinstance(e, S.Binary) and e.op in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(e.op, self.value(e.left), self.value(e.right))
        if isinstance(e, S.Match | S.Similarity | S.Fuse):
            return self.score_column(e).isNotNull()
        v = self.value(e)
        if v.is_literal:
            return F.lit(bool(v.literal) and not isinstance(v.literal, str))
        if v.kind == "bool":
            return v.col
        if v.kind == "cell":
            return F.exists(self.candidates(v), lambda c: (c["t"] == cells.BOOL) & (c["l"] == 1))
        if v.many is not None and v.element == "bool":
            return F.exists(v.many, lambda x: F.coalesce(x, F.lit(False)))
        return F.lit(False)

    def compare(self, op: str, a: Val, b: Val) -> Column:
        if a.kind != "cell" and a.many is None and b.kind != "cell" and b.many is None:
            return self.plain(op, a.kind, a.col, b.kind, b.col)
        if b.kind != "cell" and b.many is None and a.kind != "cell":
            return F.exists(a.many, lambda x: F.coalesce(self.plain(op, a.element, F.to_json(x) if a.element == "json" else x, b.kind, b.col), F.lit(False)))
        if a.kind != "cell" and a.many is None and b.kind != "cell":
            return F.exists(b.many, lambda y: F.coalesce(self.plain(op, a.kind, a.col, b.element, F.to_json(y) if b.element == "json" else y), F.lit(False)))
        return F.exists(self.candidates(a), lambda x: F.exists(self.candidates(b), lambda y: F.coalesce(cells.compare(op, x, y), F.lit(False))))

    def plain(self, op: str, ka: str, a: Column, kb: str, b: Column) -> Column:
        if "null" in (ka, kb):
            return F.lit(False)
        if ka in NUMBERS and kb in NUMBERS:
            a = a.cast("int") if ka == "bool" and kb != "bool" else a
            b = b.cast("int") if kb == "bool" and ka != "bool" else b
        elif {ka, kb} == {"timestamp", "string"}:
            a, b = (a, F.try_to_timestamp(b)) if ka == "timestamp" else (F.try_to_timestamp(a), b)
        elif ka != kb:
            return a.isNotNull() & b.isNotNull() if op == "<>" else F.lit(False)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def between(self, v: Val, low: Val, high: Val) -> Column:
        """One candidate must satisfy both ends."""
        scalar = [x.many is None and x.kind != "cell" for x in (v, low, high)]
        if all(scalar):
            return self.plain(">=", v.kind, v.col, low.kind, low.col) & self.plain("<=", v.kind, v.col, high.kind, high.col)
        if v.kind != "cell" and all(scalar[1:]):
            return F.exists(v.many, lambda x: F.coalesce(self.plain(">=", v.element, x, low.kind, low.col) & self.plain("<=", v.element, x, high.kind, high.col), F.lit(False)))
        return F.exists(self.candidates(v), lambda x: cells.compare(">=", x, self.cell(low)) & cells.compare("<=", x, self.cell(high)))

    def like(self, e: S.Binary) -> Column:
        """% and _ only: a backslash in the pattern is an ordinary character."""
        v, p = self.value(e.left), self.value(e.right)
        if not (p.is_literal and isinstance(p.literal, str)):
            if p.kind == "null" or p.is_literal:
                return F.lit(False)
            text = cells.text(p.col) if p.kind == "cell" else p.col
            match = lambda c: F.call_function("ilike" if e.op == "ILIKE" else "like", c, F.replace(text, F.lit("\\"), F.lit("\\\\")))
        else:
            match = lambda c: c.ilike(pattern_of(p.literal)) if e.op == "ILIKE" else c.like(pattern_of(p.literal))
        if v.kind == "string" and v.many is None:
            return match(v.col)
        if v.many is not None and v.element == "string":
            return F.exists(v.many, lambda x: F.coalesce(match(x), F.lit(False)))
        if v.kind == "cell":
            return F.exists(self.candidates(v), lambda c: (c["t"] == cells.STRING) & match(c["s"]))
        return F.lit(False)

    # ---- functions

    def call(self, e: S.Call) -> Val:
        name, args = e.name, e.args
        if name in AGGREGATES:
            raise SqlError(f"{name.upper()} can't be used here")
        if self.prefix and name.startswith(self.prefix):
            name = name[len(self.prefix) :]
        if name == "exists":
            if len(args) != 1 or not isinstance(args[0], S.Name):
                raise SqlError("EXISTS takes a path")
            v = self.name(args[0].path)
            if v.kind == "cell":
                return Val("bool", F.size(v.literal) > 0)
            return Val("bool", v.literal.isNotNull() if isinstance(v.literal, Column) else v.col.isNotNull())
        if name in ("array_contains", "array_contains_any"):
            if len(args) < 2:
                raise SqlError(f"{name.upper()} takes a path and values")
            v = self.value(args[0])
            hits = [F.coalesce(self.compare("=", v, self.value(a)), F.lit(False)) for a in args[1:]]
            held = hits[0]
            for h in hits[1:]:
                held = held & h if name == "array_contains" else held | h
            whole = F.exists(v.literal, cells.is_array) if v.kind == "cell" else F.lit(v.many is not None)
            return Val("bool", whole & held)
        if name == "array_length":
            v = self.value(args[0])
            if v.kind == "cell":
                first = F.get(F.slice(v.literal, 1, 1), F.lit(0))
                return Val("long", F.when(cells.is_array(first), F.size(F.try_variant_get(first, "$", "array<variant>"))).cast("bigint"))
            return Val("long", F.when(v.literal.isNotNull(), F.size(v.literal)).cast("bigint") if v.kind == "json" and isinstance(v.literal, Column) and v.many is not None else F.lit(None).cast("bigint"))
        if name == "all_values":
            v = self.value(args[0])
            if v.kind == "cell":
                return Val("json", F.concat(F.lit("["), F.array_join(F.transform(v.many, cells.as_json), ","), F.lit("]")))
            return Val("json", F.to_json(v.many if v.many is not None else F.array(v.col)))
        if name == "coalesce":
            values = [self.value(a) for a in args]
            if not values:
                raise SqlError("COALESCE takes arguments")
            return self.choice([~self.is_null(v) for v in values[:-1]], values[:-1], values[-1])
        if name == "from_base64":
            return Val("bytes", F.unbase64(self.value(args[0]).col))
        if name in ("attachment_count", "attachment_size", "attachment_mime", "attachment"):
            return self.attachment(name, args)
        if name.startswith("json_"):
            return self.json(name, args)
        raise SqlError(f"unknown function {e.name}")

    def json(self, name: str, args: tuple) -> Val:
        values = [self.value(a) for a in args]
        doc = cells.as_json(values[0].col) if values and values[0].kind == "cell" else values[0].col
        path = values[1].literal if len(values) > 1 and values[1].is_literal else "$"
        text = lambda v: cells.as_json(v.col) if v.kind == "cell" else cells.as_json(self.cell(v)) if v.kind != "json" and not v.is_literal else F.lit(v.literal) if isinstance(v.literal, str) else cells.as_json(self.cell(v))
        made: dict[str, Callable[[], Val]] = {
            "json_get": lambda: Val("json", json_text.get(doc, path)),
            "json_get_all": lambda: Val("json", json_text.json_get_all(doc, F.lit(path))),
            "json_set": lambda: Val("json", json_text.json_set(doc, F.lit(path), text(values[2]))),
            "json_delete": lambda: Val("json", json_text.json_delete(doc, F.lit(path))),
            "json_merge": lambda: Val("json", json_text.json_merge(doc, values[1].col)),
            "json_contains": lambda: Val("bool", json_text.contains(doc, path, text(values[2]))),
            "json_keys": lambda: Val("json", json_text.keys(doc, path)),
            "json_type": lambda: Val("string", json_text.kind(doc, path)),
            "json_array_length": lambda: Val("long", json_text.array_length(doc, path)),
        }
        if name not in made:
            raise SqlError(f"unknown function {name}")
        try:
            return made[name]()
        except (IndexError, json_text.PathError) as x:
            raise SqlError(f"{name}: {x}") from x

    def attachment(self, name: str, args: tuple) -> Val:
        """Over the column `_attachments` array<struct<name, aid, mime, size, hash, content>> of the collection; a selector is a name or a place from 0."""
        source = next((s for s in self.sources if "_attachments" in s.columns), None)
        if source is None:
            raise SqlError(f"{name.upper()} needs a collection with attachments")
        all_ = F.col(f"`{source.columns['_attachments']}`")
        if name == "attachment_count":
            return Val("long", F.size(F.coalesce(all_, F.array().cast(self.frame.schema[source.columns["_attachments"]].dataType))).cast("bigint"))
        picked = self.value(args[0]).literal
        one = F.get(all_, F.lit(picked)) if isinstance(picked, int) else F.get(F.filter(all_, lambda a: (a["aid"] == F.lit(picked)) | (a["name"] == F.lit(picked))), F.lit(0))
        part, kind = {"attachment_size": ("size", "long"), "attachment_mime": ("mime", "string"), "attachment": ("content", "bytes")}[name]
        return Val(kind, one[part])

    # ---- search

    def score_column(self, e) -> Column:
        if e not in self.scores:
            raise SqlError("search functions need one collection in FROM")
        return F.col(f"`{self.scores[e]}`")

    def score(self, e) -> Val:
        c = search.widened(self.score_column(e))
        return Val("double", F.coalesce(c, F.lit(0.0)) if isinstance(e, S.Match) else c)

    def hits(self, e, depth: int | None) -> DataFrame:
        """(id, score) of a search expression over the only source."""
        source = self.sources[0]
        index = source.indexes.get(e.target if isinstance(e, S.Match) else getattr(e, "field", ""))
        if isinstance(e, S.Match):
            query = self.value(e.query).literal
            if not isinstance(query, str):
                raise SqlError("MATCH takes a text")
            fields = dict(index.fields) if index else {e.target: 1.0}
            simple = bool(index) and dict(index.options).get("analyzer") == "simple"
            if e.target in source.stored:
                out = source.stored[e.target](query, simple)
                return out if depth is None else search.best(out, depth)
            base = self.document_fields(source, fields)
            out = search.bm25(search.analyzed(base, source.id_column, {f"f{i}": w for i, w in enumerate(fields.values())}, False), {f"f{i}": w for i, w in enumerate(fields.values())}, query, not simple)
        elif isinstance(e, S.Similarity):
            vector = self.value(e.vector).literal
            options = next((dict(i.options) for i in source.indexes.values() if i.using == "VECTOR" and i.fields[0][0] == e.field), {})
            base = self.document_fields(source, {e.field: 1.0}, "array<double>")
            out = search.vector_search(base, source.id_column, "f0", vector, {"euclidean": "l2", "dot": "ip", "inner_product": "ip"}.get(options.get("metric", "cosine"), options.get("metric", "cosine")))
        else:
            arms = [search.Arm(self.hits(a, depth)) for a in e.arms]
            out = search.fuse(arms, e.mode)
        return out if depth is None else search.best(out, depth)

    def document_fields(self, source: Source, fields: dict[str, float], kind: str | None = None) -> DataFrame:
        """The source with its id and the fields as f0, f1, ...: native columns as they are, others from the document."""
        out = [F.col(f"`{source.columns[source.id_column]}`").alias(source.id_column)]
        for i, f in enumerate(fields):
            if f in source.columns:
                out.append(F.col(f"`{source.columns[f]}`").alias(f"f{i}"))
            elif source.variant:
                many = cells.walk(F.col(f"`{source.variant}`"), f.split("."))
                own = F.try_variant_get(F.get(F.slice(many, 1, 1), F.lit(0)), "$", kind) if kind else F.array_compact(F.transform(cells.spread(many), lambda v: F.try_variant_get(v, "$", "string")))
                out.append(own.alias(f"f{i}"))
            else:
                raise SqlError(f"unknown field {f}")
        return self.frame.select(*out)


# ---- SELECT


def parts_of(e) -> list:
    """Direct sub-expressions."""
    if isinstance(e, S.Binary):
        return [e.left, e.right]
    if isinstance(e, S.Not | S.IsNull):
        return [e.inner]
    if isinstance(e, S.In):
        return [e.inner, *e.values]
    if isinstance(e, S.Between):
        return [e.inner, e.low, e.high]
    if isinstance(e, S.Case):
        return [x for w in e.whens for x in w] + ([e.otherwise] if e.otherwise is not None else [])
    if isinstance(e, S.Call):
        return list(e.args)
    return []


def find(e, wanted) -> list:
    return ([e] if wanted(e) else []) + [x for p in parts_of(e) for x in find(p, wanted)]


def is_aggregate(e) -> bool:
    return isinstance(e, S.Call) and e.name in AGGREGATES


def is_search(e) -> bool:
    return isinstance(e, S.Match | S.Similarity | S.Fuse)


def default_name(e) -> str:
    if isinstance(e, S.Name):
        return e.path
    if is_aggregate(e):
        return e.name
    return "expr"


class SelectPlan:
    """One SELECT over its sources."""

    def __init__(self, q: S.Select, lowering: Lowering):
        self.q, self.low = q, lowering

    def frame(self) -> DataFrame:
        q, low = self.q, self.low
        self.check()
        self.add_scores()
        df = low.frame
        if q.where is not None:
            df = df.where(low.test(q.where))
        low.frame = df
        return self.aggregated(df) if self.is_grouped() else self.projected(df)

    def is_grouped(self) -> bool:
        return bool(self.q.group) or any(find(i.expr, is_aggregate) for i in self.q.items)

    def check(self) -> None:
        q = self.q
        if q.where is not None and find(q.where, is_aggregate):
            raise SqlError("an aggregate can't be in WHERE")
        for j in q.joins:
            if find(j.on, is_aggregate):
                raise SqlError("an aggregate can't be in ON")
        for i in q.items:
            for a in find(i.expr, is_aggregate):
                if len(a.args) > 1 or not a.args and a.name != "count" or any(find(x, is_aggregate) for x in a.args):
                    raise SqlError(f"{a.name.upper()} takes one argument that is no aggregate")
        if not self.is_grouped() and any(find(o.expr, is_aggregate) for o in q.order):
            raise SqlError("an aggregate in ORDER BY needs a grouped query")
        if q.group and any(isinstance(i.expr, S.Star) for i in q.items):
            raise SqlError("* can't be grouped")

    def add_scores(self) -> None:
        """Joins each different search expression's hits once."""
        q, low = self.q, self.low
        wanted: dict = {}
        for e in [i.expr for i in q.items] + [q.where] + [o.expr for o in q.order]:
            for s in find(e, is_search) if e is not None else []:
                wanted.setdefault(s, None)
        if not wanted:
            return
        if len(low.sources) != 1 or low.sources[0].id_column is None:
            raise SqlError("search functions need one collection in FROM")
        leads = bool(q.order) and q.limit is not None and is_search(self.resolved(q.order[0].expr))
        depth = search.depth_for(q.limit, q.offset) if leads else None
        source = low.sources[0]
        for n, e in enumerate(wanted):
            hits = low.hits(e, depth).select(F.col("id").alias(f"__hit{n}"), F.col("score").alias(f"__score{n}"))
            low.frame = low.frame.join(hits, F.col(f"`{source.columns[source.id_column]}`") == F.col(f"__hit{n}"), "left").drop(f"__hit{n}")
            low.scores[e] = f"__score{n}"

    def resolved(self, e):
        """An ORDER BY expression with an alias replaced by what it stands for."""
        if isinstance(e, S.Name):
            for i in self.q.items:
                if i.alias == e.path:
                    return i.expr
        return e

    # -- plain

    def outputs(self) -> list[tuple[str, Val]]:
        out = []
        for i in self.q.items:
            if isinstance(i.expr, S.Star):
                for s in self.low.sources:
                    for name in s.columns:
                        out.append((name, self.low.typed_path(s, [name])))
            else:
                out.append((i.alias or default_name(i.expr), self.low.value(i.expr)))
        return out

    @staticmethod
    def shown(v: Val) -> Column:
        if v.kind == "cell":
            return cells.text(v.col)
        return v.col

    def sort_key(self, v: Val) -> Column:
        return cells.key(v.col) if v.kind == "cell" else v.col

    def projected(self, df: DataFrame) -> DataFrame:
        low, q = self.low, self.q
        outputs = self.outputs()
        for name, v in outputs:
            low.aliases.setdefault(name, v)
        names = self.unique([n for n, _ in outputs])
        order = []
        for n, o in enumerate(q.order):
            by_alias = isinstance(o.expr, S.Name) and any(i.alias == o.expr.path for i in q.items)
            v = low.aliases[o.expr.path] if by_alias else low.value(o.expr)
            order.append((self.sort_key(v).alias(f"__o{n}"), o.descending))
        kept = [self.shown(v).alias(f"__p{n}") for n, (_, v) in enumerate(outputs)]
        marks = [self.sort_key(v).alias(f"__k{n}") for n, (_, v) in enumerate(outputs)] if q.distinct else []
        tie = [F.col(f"`{low.sources[0].columns[low.sources[0].id_column]}`").alias("__tie")] if order and low.sources and low.sources[0].id_column and not q.joins else []
        df = df.select(*kept, *marks, *[c for c, _ in order], *tie)
        by = [F.desc(f"__o{n}") if d else F.asc(f"__o{n}") for n, (_, d) in enumerate(order)] + [F.asc("__tie") for _ in tie]
        if q.distinct:
            keys = [f"__k{n}" for n in range(len(outputs))]
            if by:
                place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
                df = df.withColumn("__n", place).where("__n = 1")
            else:
                df = df.dropDuplicates(keys)
        if by:
            df = df.orderBy(*by)
        df = self.cut(df)
        return df.select(*[F.col(f"__p{n}").alias(name) for n, name in enumerate(names)])

    def cut(self, df: DataFrame) -> DataFrame:
        if self.q.offset:
            df = df.offset(self.q.offset)
        return df if self.q.limit is None else df.limit(self.q.limit)

    @staticmethod
    def unique(names: list[str]) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for n in names:
            seen[n.lower()] = seen.get(n.lower(), 0) + 1
            out.append(n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}")
        return out

    # -- grouped

    def aggregated(self, df: DataFrame) -> DataFrame:
        low, q = self.low, self.q
        aliases = {i.alias: i.expr for i in q.items if i.alias}
        keys, expressions = [], []
        for n, g in enumerate(q.group):
            e = g
            if isinstance(g, S.Name) and g.path in aliases:
                try:
                    low.name(g.path)
                except SqlError:
                    e = aliases[g.path]
            if find(e, is_aggregate):
                raise SqlError("an aggregate can't be a group key")
            expressions.append((g, e))
            keys.append((low.value(e), f"__g{n}"))
        calls: dict = {}
        for e in [i.expr for i in q.items] + [o.expr for o in q.order]:
            for a in find(self.resolved(e), is_aggregate):
                calls.setdefault(a, len(calls))
        parts, made = [], {}
        for a, n in calls.items():
            columns, finish = self.aggregate(a, f"__a{n}")
            parts += columns
            made[a] = finish
        grouped = df.groupBy(*[self.sort_key(v).alias(name) for v, name in keys]).agg(*(parts or [F.count(F.lit(1)).alias("__rows")]))
        low.grouped = dict(made)
        for (g, e), (v, name) in zip(expressions, keys):
            out = Val("cell", cells.of_key(F.col(name))) if v.kind == "cell" else Val(v.kind, F.col(name))
            low.grouped[g] = low.grouped[e] = out
        outputs = [(i.alias or default_name(i.expr), low.value(i.expr)) for i in q.items]
        for (_, v), i in zip(outputs, q.items):
            if i.alias:
                low.aliases.setdefault(i.alias, v)
        order = [(self.sort_key(low.value(o.expr)).alias(f"__o{n}"), o.descending) for n, o in enumerate(q.order)]
        if not order:
            order = [(F.col(name).alias(f"__o{n}"), False) for n, (_, name) in enumerate(keys)]
        names = self.unique([n for n, _ in outputs])
        ties = [F.col(name).alias(f"__t{n}") for n, (_, name) in enumerate(keys)]
        marks = [self.sort_key(v).alias(f"__k{n}") for n, (_, v) in enumerate(outputs)] if q.distinct else []
        out = grouped.select(*[self.shown(v).alias(f"__p{n}") for n, (_, v) in enumerate(outputs)], *marks, *[c for c, _ in order], *ties)
        if q.distinct:
            out = out.dropDuplicates([f"__k{n}" for n in range(len(outputs))])
        if q.group:
            out = out.orderBy(*[F.desc(f"__o{n}") if d else F.asc(f"__o{n}") for n, (_, d) in enumerate(order)], *[f"__t{n}" for n in range(len(ties))])
            out = self.cut(out)
        return out.select(*[F.col(f"__p{n}").alias(name) for n, name in enumerate(names)])

    def aggregate(self, a: S.Call, name: str) -> tuple[list[Column], Val]:
        """(aggregate columns, the value over them)."""
        if not a.args or isinstance(a.args[0], S.Star):
            if a.name != "count":
                raise SqlError(f"{a.name.upper()} takes an expression")
            return [F.count(F.lit(1)).alias(name)], Val("long", F.col(name))
        v = self.low.value(a.args[0])
        some = ~self.low.is_null(v)
        if a.name == "count":
            return [F.count(F.when(some, 1)).alias(name)], Val("long", F.col(name))
        if v.kind == "cell":
            numeric = v.col["t"].isin(cells.BOOL, cells.LONG, cells.DOUBLE)
            if a.name == "avg":
                return [F.avg(F.when(numeric, v.col["d"])).alias(name)], Val("double", F.col(name))
            if a.name == "sum":
                columns = [F.max(F.when(numeric, v.col["t"] == cells.DOUBLE)).alias(f"{name}_real"), F.try_sum(F.when(numeric, v.col["l"])).alias(f"{name}_l"), F.sum(F.when(numeric, v.col["d"])).alias(f"{name}_d")]
                t = F.when(F.col(f"{name}_real").isNull(), cells.NULL).when(F.col(f"{name}_real"), cells.DOUBLE).otherwise(F.when(F.col(f"{name}_l").isNull(), cells.NULL).otherwise(cells.LONG))
                return columns, Val("cell", cells.make(t, F.when(~F.col(f"{name}_real"), F.col(f"{name}_l")), F.col(f"{name}_d")))
            pick = F.min if a.name == "min" else F.max
            chosen = pick(F.when(some, cells.key(v.col))).alias(name)
            return [chosen], Val("cell", F.when(F.col(name).isNull(), cells.make(cells.NULL)).otherwise(cells.of_key(F.col(name))))
        if a.name in ("min", "max"):
            return [(F.min if a.name == "min" else F.max)(v.col).alias(name)], Val(v.kind, F.col(name))
        col = v.col.cast("int") if v.kind == "bool" else v.col if v.kind in ("long", "double") else F.lit(None).cast("double")
        if a.name == "avg":
            return [F.avg(col.cast("double")).alias(name)], Val("double", F.col(name))
        whole = v.kind in ("bool", "long")
        return [(F.try_sum(col.cast("bigint")) if whole else F.sum(col)).alias(name)], Val("long" if whole else "double", F.col(name))
