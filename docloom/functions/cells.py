"""Values of documents whose type is known only row by row.

A cell is struct<t, l, d, s>: t is 0 null, 1 boolean, 2 whole number, 3 other number, 4 string, 5 JSON (object or array); l is the whole number (0/1 for a
boolean), d the number as a double, s the string or the canonical JSON text. Kinds compare only within a rank: numbers and booleans, strings, JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, BOOL, LONG, DOUBLE, STRING, JSON = range(6)
TYPE = "struct<t:int,l:bigint,d:double,s:string>"
#: Rounds in which arrays of arrays are unwrapped one by one; values that hold more go through a loop.
DEPTH = 3
#: Spark's JSON parser takes no deeper nesting.
DEEPEST = 1000
EXACT = float(1 << 53)


def let(value: Column, body) -> Column:
    """Evaluates value once, for a body that uses it many times."""
    return F.transform(F.array(value), body)[0]


def make(t, l=None, d=None, s=None) -> Column:  # noqa: E741
    return F.struct(
        (t if isinstance(t, Column) else F.lit(t)).cast("int").alias("t"),
        (F.lit(None) if l is None else l).cast("bigint").alias("l"),
        (F.lit(None) if d is None else d).cast("double").alias("d"),
        (F.lit(None) if s is None else s).cast("string").alias("s"),
    )


def of_typed(col: Column, kind: str) -> Column:
    """The cell of a typed value; SQL NULL becomes the null cell."""
    t = {"bool": BOOL, "long": LONG, "double": DOUBLE, "string": STRING, "json": JSON, "timestamp": STRING, "null": NULL}[kind]
    tag = F.when(col.isNull(), NULL).otherwise(t)
    if kind == "bool":
        return make(tag, col.cast("int"), col.cast("int"))
    if kind == "long":
        return make(tag, col, col)
    if kind == "double":
        return make(tag, None, col)
    return make(tag, None, None, col)


def of_variant(v: Column) -> Column:
    """The cell of a VARIANT value (not of a missing one)."""
    kind = F.schema_of_variant(v)

    def typed(k: Column) -> Column:
        number = k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT")
        t = F.when(k == "VOID", NULL).when(k == "BOOLEAN", BOOL).when(k == "BIGINT", LONG).when(number, DOUBLE).when(k == "STRING", STRING).otherwise(JSON)
        whole = F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")).when(k == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        real = F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(number | (k == "BIGINT"), F.try_variant_get(v, "$", "double"))
        text = F.when(k == "STRING", F.try_variant_get(v, "$", "string")).when(k.startswith("OBJECT") | k.startswith("ARRAY"), F.to_json(v))
        return make(t, whole, real, text)

    return let(kind, typed)


def is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def spread(many: Column, depth: int = DEPTH) -> Column:
    """VARIANT candidates with arrays replaced by their elements, until none is an array."""

    def once(vs: Column) -> Column:
        return F.flatten(F.transform(vs, lambda v: F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))))

    def rest(vs: Column) -> Column:
        # No value is nested deeper than it has brackets.
        brackets = F.aggregate(F.transform(F.filter(vs, is_array), lambda v: F.length(F.regexp_replace(F.to_json(v), r"[^\[]+", ""))), F.lit(0), lambda a, b: F.greatest(a, b))
        rounds = F.sequence(F.lit(1), F.least(brackets, F.lit(DEEPEST)))
        return F.aggregate(rounds, vs, lambda left, _: F.when(F.exists(left, is_array), once(left)).otherwise(left))

    def step(vs: Column, left: int) -> Column:
        return F.when(F.exists(vs, is_array), let(once(vs), lambda w: step(w, left - 1)) if left else rest(vs)).otherwise(vs)

    return let(many, lambda vs: step(vs, depth))


def opened(many: Column) -> Column:
    """VARIANT candidates at the end of a path: an array gives its elements, which stay whole if they are arrays themselves."""
    return F.flatten(F.transform(many, lambda v: F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))))


def at(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def walk(root: Column, segments: list[str]) -> Column:
    """All VARIANT values that a dotted path reaches, arrays on the way spread out; missing ones are left out, explicit nulls stay."""
    many = None
    for s in segments:
        name = at(s)
        if many is None:
            many = F.array(F.try_variant_get(root, name, "variant"))
        else:
            many = F.transform(spread(many), lambda v: F.try_variant_get(v, name, "variant"))
        many = F.filter(many, lambda v: v.isNotNull())
    return many


def first(root: Column, segments: list[str]) -> Column:
    """The first value of walk(); NULL if there is none. A single name is looked up without a list."""
    if len(segments) == 1:
        return F.try_variant_get(root, at(segments[0]), "variant")
    return F.get(F.slice(walk(root, segments), 1, 1), F.lit(0))


def rank(c: Column) -> Column:
    return F.when(c["t"] == NULL, 0).when(c["t"] <= DOUBLE, 1).when(c["t"] == STRING, 2).otherwise(3)


def compare(op: str, x: Column, y: Column) -> Column:
    """Two-valued: null is never true, different ranks are only <>."""
    ops = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    apply = lambda a, b: getattr(a, ops[op])(b)
    same = F.when((x["t"] <= DOUBLE) & (y["t"] <= DOUBLE), F.when(x["l"].isNotNull() & y["l"].isNotNull(), apply(x["l"], y["l"])).otherwise(apply(x["d"], y["d"])))
    same = same.when((x["t"] == y["t"]), apply(x["s"], y["s"])).otherwise(F.lit(op == "<>"))
    return F.when((x["t"] == NULL) | (y["t"] == NULL), F.lit(False)).otherwise(same)


def key(c: Column) -> Column:
    """struct(rank, d, l, s): equal for equal cells (1, 1.0 and true are equal), and in the total order."""
    whole = F.when(c["t"].isin(BOOL, LONG), c["l"]).when((c["t"] == DOUBLE) & (c["d"] == F.floor(c["d"])) & (F.abs(c["d"]) < EXACT), c["d"].cast("bigint"))
    return F.struct(rank(c).alias("r"), c["d"].alias("d"), whole.alias("l"), c["s"].alias("s"))


def of_key(k: Column) -> Column:
    """A cell with that key."""
    t = F.when(k["r"] == 0, NULL).when((k["r"] == 1) & k["l"].isNotNull(), LONG).when(k["r"] == 1, DOUBLE).when(k["r"] == 2, STRING).otherwise(JSON)
    return make(t, k["l"], k["d"], k["s"])


def text(c: Column) -> Column:
    """What a cell shows in a result: a string as it is, anything else as JSON text, null as NULL."""
    number = F.when(c["t"] == BOOL, F.when(c["l"] == 1, "true").otherwise("false")).when(c["t"] == LONG, c["l"].cast("string")).when(c["t"] == DOUBLE, c["d"].cast("string"))
    return F.when(c["t"] == NULL, F.lit(None).cast("string")).when(c["t"] >= STRING, c["s"]).otherwise(number)


def as_json(c: Column) -> Column:
    """A cell as JSON text."""
    return F.when(c["t"] == NULL, "null").when(c["t"] == STRING, F.to_json(F.struct(c["s"].alias("s"))).substr(F.lit(6), F.length(F.to_json(F.struct(c["s"].alias("s")))) - 6)).otherwise(text(c))
