"""Checks of declared fields and of uniqueness, and the steps by which a declared schema changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import cells
from docloom.functions.identity import UUID_TEXT
from docloom.plans.syntax import ColumnDef

# Spark type of each declared type.
SPARK_TYPE = {"string": "string", "int": "int", "bigint": "bigint", "double": "double", "boolean": "boolean", "timestamp": "timestamp", "uuid": "string", "object": "variant", "array": "variant", "enum": "string"}


@dataclass(frozen=True)
class Schema:
    fields: tuple[ColumnDef, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    version: int = 1
    enums: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def names(self) -> list[str]:
        return [f.name for f in self.fields]


def fits(v: Column, kind: str, members: Sequence[str] = ()) -> Column:
    """Whether a VARIANT value fits a declared type; null and missing fit every type."""

    def one(v: Column, k: Column) -> Column:
        number = k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT")
        d, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        whole = (k == "BIGINT") | number & (d == F.floor(d))
        checks = {
            "string": lambda: k == "STRING",
            "int": lambda: whole & d.between(-(2**31), 2**31 - 1),
            "bigint": lambda: whole & (d >= -(2.0**63)) & (d < 2.0**63),
            "double": lambda: (k == "BIGINT") | number,
            "boolean": lambda: k == "BOOLEAN",
            "timestamp": lambda: (k == "STRING") & F.try_to_timestamp(text).isNotNull(),
            "uuid": lambda: (k == "STRING") & text.rlike(UUID_TEXT),
            "object": lambda: k.startswith("OBJECT"),
            "array": lambda: k.startswith("ARRAY"),
            "enum": lambda: (k == "STRING") & text.isin(*members),
        }
        return (k == "VOID") | checks[kind]()

    # Of the value only what its type is checked by is read: no cell is made.
    return cells.let(v, lambda v: F.when(v.isNull(), F.lit(True)).otherwise(cells.let(F.schema_of_variant(v), lambda k: one(v, k))))


def problems(body: Column, schema: Schema) -> Column:
    """array<struct<field, problem>> of a document (JSON text): what breaks the schema, a wrong type, or a required field that is missing or null."""
    enums = dict(schema.enums)

    def of_field(f: ColumnDef):
        def own(first: Column) -> Column:
            wrong = ~F.coalesce(fits(first, f.type, enums.get(f.name, ())), F.lit(True))
            says = lambda text: F.struct(F.lit(f.name).alias("field"), F.lit(text).alias("problem"))
            absent = [F.when(first.isNull() | F.is_variant_null(first), says("required"))] if f.required else []
            return F.array(F.when(wrong, says(f"not a {f.type}")), *absent)

        return own

    def of_document(v: Column) -> Column:
        whole = F.when(~v.isNotNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.struct(F.lit("").alias("field"), F.lit("not a JSON object").alias("problem")))
        fields = [cells.let(cells.first(v, f.name.split(".")), of_field(f)) for f in schema.fields]
        return F.array_compact(F.concat(F.array(whole), *fields))

    return cells.let(F.try_parse_json(body), of_document)  # the text is parsed once


def problem(body: Column, schema: Schema) -> Column:
    """The first of problems(); NULL for a document that keeps to the schema."""
    return F.get(problems(body, schema), F.lit(0))


def violations(docs: DataFrame, schema: Schema, key: str = "id", body: str = "body") -> DataFrame:
    """(key, field, problem) of documents that break the schema."""
    return docs.select(key, F.explode(problems(F.col(body), schema)).alias("x")).select(key, "x.field", "x.problem")


def claim(body: Column, columns: Sequence[str]) -> Column:
    """The canonical key of a document under a unique constraint (1 equals 1.0); NULL, which claims nothing, if a column is null or missing."""

    def of_document(v: Column) -> Column:
        cell = lambda x: F.when(x.isNull(), cells.make(cells.NULL)).otherwise(cells.of_variant(x))
        firsts = [cells.let(cells.first(v, c.split(".")), cell) for c in columns]
        return F.array(*[cells.let(x, cells.key) for x in firsts])  # once: a key asks its cell many times

    def text(keys: Column) -> Column:
        return F.when(~F.exists(keys, lambda k: k["r"] == 0), F.to_json(F.struct(*[keys[i].alias(f"k{i}") for i in range(len(columns))])))

    return cells.let(cells.let(F.try_parse_json(body), of_document), text)


def duplicates(docs: DataFrame, columns: Sequence[str], key: str = "id", body: str = "body") -> DataFrame:
    """(claim, n): keys that several documents claim; counted on the map side first."""
    return docs.select(claim(F.col(body), columns).alias("claim")).where("claim IS NOT NULL").groupBy("claim").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---- migrations

STEPS = ("add_field", "drop_field", "rename_field", "change_type", "set_required", "set_unique", "widen_enum", "narrow_enum")
BREAKING = ("drop_field", "rename_field", "change_type", "narrow_enum")


def migrate(schema: Schema, steps: Sequence[tuple]) -> Schema:
    """Applies (step, field, argument) triples; each raises ValueError if it names what is not there."""
    for step, name, *rest in steps:
        fields = {f.name: f for f in schema.fields}
        enums = dict(schema.enums)
        if step == "add_field":
            if name in fields:
                raise ValueError(f"{name} is there already")
            fields[name] = rest[0]
        elif name not in fields:
            raise ValueError(f"no field {name}")
        elif step == "drop_field":
            del fields[name]
        elif step == "rename_field":
            fields = {rest[0] if k == name else k: replace(f, name=rest[0]) if k == name else f for k, f in fields.items()}
        elif step == "change_type":
            fields[name] = replace(fields[name], type=rest[0])
        elif step == "set_required":
            fields[name] = replace(fields[name], required=rest[0])
        elif step == "set_unique":
            fields[name] = replace(fields[name], unique=rest[0])
        elif step == "widen_enum":
            enums[name] = tuple(dict.fromkeys([*enums.get(name, ()), *rest[0]]))
        elif step == "narrow_enum":
            enums[name] = tuple(m for m in enums.get(name, ()) if m not in rest[0])
        else:
            raise ValueError(f"unknown step {step}")
        schema = Schema(tuple(fields.values()), schema.unique, schema.version + 1, tuple(enums.items()))
    return schema


def is_breaking(step: tuple) -> bool:
    """A required field added, a requirement or uniqueness set, or one of BREAKING."""
    kind, _, *rest = step
    return kind in BREAKING or kind in ("set_required", "set_unique") and bool(rest[0]) or kind == "add_field" and rest[0].required


def schema_diff(old: Schema, new: Schema) -> list[tuple]:
    """Steps that turn one schema into the other; a renamed field shows as dropped and added."""
    a, b = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    out: list[tuple] = [("drop_field", n) for n in a if n not in b] + [("add_field", n, b[n]) for n in b if n not in a]
    for n in (n for n in a if n in b):
        out += [(step, n, getattr(b[n], what)) for step, what in (("change_type", "type"), ("set_required", "required"), ("set_unique", "unique")) if getattr(a[n], what) != getattr(b[n], what)]
        x, y = set(dict(old.enums).get(n, ())), set(dict(new.enums).get(n, ()))
        out += [("widen_enum", n, tuple(sorted(y - x)))] * bool(y - x) + [("narrow_enum", n, tuple(sorted(x - y)))] * bool(x - y)
    return out
