"""Functions over JSON text with strict paths: $, .field, ['field'], [n] ([-1] is the last, for reading), [*] and .*"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = re.compile(r"\.\*|\.([^.\[\]]+)|\[\*\]|\['((?:[^'\\]|\\.)*)'\]|\[(-?\d+)\]")
ALL = object()


class PathError(ValueError):
    """A path that is not in the grammar."""


def compile_path(path: str, many: bool = False, write: bool = False) -> list[Any]:
    """Steps: a string for a field, a number for a place, ALL for every element (only with `many`)."""
    if not path.startswith("$"):
        raise PathError(f"a path starts with $: {path!r}")
    out: list[Any] = []
    at = 1
    while at < len(path):
        m = STEP.match(path, at)
        if m is None:
            raise PathError(f"malformed path at {at}: {path!r}")
        if m[1] is not None or m[2] is not None:
            out.append(m[1] if m[1] is not None else m[2].replace("\\'", "'").replace("\\\\", "\\"))
        elif m[3] is not None:
            n = int(m[3])
            if n < -1 or n == -1 and write:
                raise PathError(f"negative place: {path!r}")
            out.append(n)
        elif many:
            out.append(ALL)
        else:
            raise PathError(f"a wildcard can't be used here: {path!r}")
        at = m.end()
    return out


def _dumps(v: Any) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _reach(v: Any, steps: list[Any]) -> list[Any]:
    now = [v]
    for s in steps:
        nxt = []
        for x in now:
            if s is ALL:
                nxt += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
            elif isinstance(s, str):
                nxt += [x[s]] if isinstance(x, dict) and s in x else []
            elif isinstance(x, list) and -len(x) <= s < len(x):
                nxt.append(x[s])
        now = nxt
    return now


def equal(a: Any, b: Any) -> bool:
    """Deep: 1 equals 1.0 but not true; arrays in order."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(equal, a, b))
    return type(a) is type(b) and a == b or isinstance(a, int | float) and isinstance(b, int | float) and a == b


def set_at(v: Any, steps: list[Any], new: Any) -> Any:
    """v with `new` at a path; objects on the way are made, an array takes one place past its end."""
    if not steps:
        return new
    s, rest = steps[0], steps[1:]
    if isinstance(s, str):
        base = dict(v) if isinstance(v, dict) else {}
        base[s] = set_at(base.get(s), rest, new)
        return base
    base = list(v) if isinstance(v, list) else []
    if s > len(base):
        raise PathError(f"place {s} is beyond the end")
    base[s : s + 1] = [set_at(base[s] if s < len(base) else None, rest, new)]
    return base


def delete_at(v: Any, steps: list[Any]) -> Any:
    if not steps:
        return None
    s, rest = steps[0], steps[1:]
    if isinstance(s, str) and isinstance(v, dict) and s in v:
        return {k: delete_at(x, rest) if k == s else x for k, x in v.items() if k != s or rest}
    if isinstance(s, int) and isinstance(v, list) and 0 <= s < len(v):
        return [delete_at(x, rest) if i == s else x for i, x in enumerate(v) if i != s or rest]
    return v


def changed(df: DataFrame, sets: list[str], removes: list[str]) -> DataFrame:
    """df (id, body, v0, v1, ... as JSON text) -> (id, body) with v0, v1, ... set at the dotted paths, then the others removed. The order of keys stays."""

    def run(batches):
        for pdf in batches:
            bodies = []
            for row in pdf.itertuples(index=False):
                doc = json.loads(row[1])
                for path, new in zip(sets, row[2:]):
                    doc = set_at(doc, path.split("."), None if new is None else json.loads(new))
                for path in removes:
                    doc = delete_at(doc, path.split("."))
                bodies.append(_dumps(doc))
            yield pd.DataFrame({"id": pdf["id"], "body": bodies})

    return df.mapInPandas(run, "id string, body string")


@F.pandas_udf(T.StringType())
def json_get_all(doc: pd.Series, path: pd.Series) -> pd.Series:
    """JSON array of all values that the path reaches; NULL for NULL."""
    return pd.Series([None if d is None or p is None else _dumps(_reach(json.loads(d), compile_path(p, many=True))) for d, p in zip(doc, path)])


@F.pandas_udf(T.StringType())
def json_set(doc: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    """The document with a JSON value at the path; the order of keys stays."""
    return pd.Series([None if d is None or p is None else _dumps(set_at(json.loads(d), compile_path(p, write=True), None if v is None else json.loads(v))) for d, p, v in zip(doc, path, value)])


@F.pandas_udf(T.StringType())
def json_delete(doc: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or p is None else _dumps(delete_at(json.loads(d), compile_path(p, write=True))) for d, p in zip(doc, path)])


@F.pandas_udf(T.StringType())
def json_merge(doc: pd.Series, other: pd.Series) -> pd.Series:
    """Keys of the second object over those of the first, at the root only."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return a if b is None else b
        x, y = json.loads(a), json.loads(b)
        if not isinstance(x, dict) or not isinstance(y, dict):
            raise ValueError("both documents must be objects")
        return _dumps(x | y)

    return pd.Series(map(one, doc, other))


def spark_path(path: str) -> str:
    """A compiled path as Spark's variant functions read it; without wildcards and negative places."""
    return "$" + "".join(f"['{s}']" if isinstance(s, str) else f"[{s}]" for s in compile_path(path))


def get(doc: Column, path: str) -> Column:
    """The value at the path as JSON text (strings quoted), NULL if there is none."""
    steps = compile_path(path)
    if any(s == -1 for s in steps):
        found = json_get_all(doc, F.lit(path))
        return F.when(F.get_json_object(found, "$[0]").isNotNull(), found.substr(F.lit(2), F.length(found) - 2))
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), spark_path(path), "variant"))


def kind(doc: Column, path: str = "$") -> Column:
    v = F.try_variant_get(F.try_parse_json(doc), spark_path(path), "variant")
    k = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string")).when(k == "VOID", "null").when(k == "STRING", "string").when(k == "BOOLEAN", "boolean")
        .when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").otherwise("number")
    )


def keys(doc: Column, path: str = "$") -> Column:
    """JSON array of the keys of the object at the path, sorted; NULL if it is no object."""
    at = F.to_json(F.try_variant_get(F.try_parse_json(doc), spark_path(path), "variant"))
    return F.when(kind(doc, path) == "object", F.to_json(F.json_object_keys(at)))


def array_length(doc: Column, path: str = "$") -> Column:
    at = F.to_json(F.try_variant_get(F.try_parse_json(doc), spark_path(path), "variant"))
    return F.when(kind(doc, path) == "array", F.json_array_length(at)).cast("bigint")


def canonical(doc: Column) -> Column:
    """JSON text with sorted keys and no spaces."""
    return F.to_json(F.try_parse_json(doc))


def contains(doc: Column, path: str, value: Column) -> Column:
    """Whether the array at the path holds the JSON value, or the value there equals it; compared in canonical form."""
    v = F.try_variant_get(F.try_parse_json(doc), spark_path(path), "variant")
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    want = canonical(value)
    return F.coalesce(F.exists(items, lambda x: F.to_json(x) == want), F.lit(False))
