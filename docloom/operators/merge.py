"""Three-way differences of documents, merging, and conflict policies."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.json_text import _dumps, equal

MISSING = object()
CHANGES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "side", "base", "local", "remote")]))
POLICIES = ("append_only", "last_write", "strict", "custom")
DECISIONS = ("defer", "take", "doc", "fork", "delete")


def leaves(v: Any, at: str = "") -> dict[str, Any]:
    """JSON Pointer to value; arrays, and objects without keys, are values."""
    if not isinstance(v, dict) or not v and at:
        return {at: v}
    out: dict[str, Any] = {}
    for k, x in v.items():
        out |= leaves(x, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")
    return out


def field_changes(base: Any, local: Any, remote: Any) -> list[dict]:
    """One entry for each path that a side changed: path, side (local, remote, same or both), and the three values as JSON text."""
    b, x, y = leaves(base), leaves(local), leaves(remote)
    out = []
    for p in sorted(b.keys() | x.keys() | y.keys()):
        o, l, r = b.get(p, MISSING), x.get(p, MISSING), y.get(p, MISSING)  # noqa: E741
        same = lambda u, v: u is v or u is not MISSING and v is not MISSING and equal(u, v)
        if same(o, l) and same(o, r):
            continue
        side = "remote" if same(o, l) else "local" if same(o, r) else "same" if same(l, r) else "both"
        out.append({"path": p, "side": side} | {k: None if v is MISSING else _dumps(v) for k, v in (("base", o), ("local", l), ("remote", r))})
    return out


@F.pandas_udf(CHANGES)
def three_way_json(base: pd.Series, local: pd.Series, remote: pd.Series) -> pd.Series:
    load = lambda s: {} if s is None else json.loads(s)
    return pd.Series([field_changes(load(b), load(x), load(y)) for b, x, y in zip(base, local, remote)])


def three_way_columns(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, path, side) for flat typed records: columns base_f, local_f and remote_f of each field; no JSON, so it stays in the JVM."""

    def side(f: str) -> Column:
        b, x, y = (F.col(f"{s}_{f}") for s in ("base", "local", "remote"))
        kept_x, kept_y = b.eqNullSafe(x), b.eqNullSafe(y)
        return F.when(kept_x & kept_y, None).when(kept_x, "remote").when(kept_y, "local").when(x.eqNullSafe(y), "same").otherwise("both")

    rows = F.array(*[F.struct(F.lit(f"/{f}").alias("path"), side(f).alias("side")) for f in fields])
    return df.select(key, F.explode(F.filter(rows, lambda r: r["side"].isNotNull())).alias("x")).select(key, "x.path", "x.side")


@F.pandas_udf(T.StringType())
def rebase(base: pd.Series, local: pd.Series, remote: pd.Series) -> pd.Series:
    """Root fields that local changed since base, put over remote; NULL where both changed one differently."""

    def one(b: str | None, x: str | None, y: str | None) -> str | None:
        o, l, r = (json.loads(v) if v else {} for v in (b, x, y))  # noqa: E741
        out = dict(r)
        for k in o.keys() | l.keys():
            was, now, there = o.get(k, MISSING), l.get(k, MISSING), r.get(k, MISSING)
            same = lambda u, v: u is v or u is not MISSING and v is not MISSING and equal(u, v)
            if same(was, now):
                continue
            if not same(was, there) and not same(now, there):
                return None
            if now is MISSING:
                out.pop(k, None)
            else:
                out[k] = now
        return _dumps(out)

    return pd.Series(map(one, base, local, remote))


#: Rows that a procedure's host may hold of one result.
HOST_ROWS = 100_000


class Host:
    """What a conflict procedure may read besides its row: rows by key, and whole small results."""

    def __init__(self, held: dict[str, dict]):
        self.held = held

    def get(self, name: str, key: Any) -> dict | None:
        return self.held[name].get(key)

    def query(self, name: str) -> list[dict]:
        return list(self.held[name].values())


def resolve(conflicts: DataFrame, policy: str, procedure: Callable[[dict], dict] | None = None) -> DataFrame:
    """(id, base, local, remote) JSON documents -> (id, kind, doc).

    append_only: defer whatever both changed. last_write: take local. strict: defer, unless the changes are to different root fields or equal.
    custom: `procedure` gets the row and returns {"kind": one of DECISIONS, "doc": ...}; it runs on the executors in Arrow batches.
    """
    if policy == "last_write":
        return conflicts.select("id", F.when(F.col("local").isNull(), "delete").otherwise("take").alias("kind"), F.col("local").alias("doc"))
    if policy == "append_only":
        return conflicts.select("id", F.when(F.col("base").isNull() & F.col("remote").isNull(), "take").otherwise("defer").alias("kind"), F.when(F.col("base").isNull() & F.col("remote").isNull(), F.col("local")).alias("doc"))
    if policy == "strict":
        merged = conflicts.withColumn("doc", rebase("base", "local", "remote"))
        return merged.select("id", F.when(F.col("doc").isNull(), "defer").otherwise("doc").alias("kind"), "doc")
    if policy != "custom" or procedure is None:
        raise ValueError(f"policy must be one of {POLICIES}; custom needs a procedure")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                d = procedure({k: json.loads(v) if k != "id" and v is not None else v for k, v in r.items()})
                if d.get("kind") not in DECISIONS:
                    raise ValueError(f"a decision must be one of {DECISIONS}")
                rows.append((r["id"], d["kind"], _dumps(d["doc"]) if d.get("doc") is not None else r["local"] if d["kind"] == "take" else None))
            yield pd.DataFrame(rows, columns=["id", "kind", "doc"])

    return conflicts.select("id", "base", "local", "remote").mapInPandas(run, "id string, kind string, doc string")
