"""Derived tables of an index: rows in order of a key, so that Parquet's statistics skip what a look-up does not need.

An index is built at a commit. Documents that later commits touch are looked at themselves, so an index that is behind gives the same rows, and is rebuilt
when it is worth it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import cells
from docloom.operators import history, search
from docloom.plans import syntax as S
from docloom.sources.store import GENESIS, Store

KEYS = "r int, d double, s string, id string, body string"


@dataclass(frozen=True)
class Built:
    """A derived table, the commit it was built at, and what is known of it."""

    commit: str
    folder: str
    several: bool = False  # a document may have several rows
    documents: int = 0
    lengths: tuple[int, ...] = ()


def build(store: Store, index: S.CreateIndex, stemmed: bool = True) -> Built | None:
    """Writes the derived table of an index at head; None for an empty collection. HASH and BTREE: a row for each value that a comparison with the first field sees, with the document.
    FULLTEXT: postings."""
    head = store.head()
    if head is None:
        return None
    folder = f"indexes/{uuid.uuid4().hex}"
    docs = store.snapshot(head).select("id", "body").withColumn("v", F.try_parse_json("body"))
    if index.using == "FULLTEXT":
        fields = [F.array_compact(F.transform(cells.spread(cells.walk(F.col("v"), f.split("."))), lambda v: F.try_variant_get(v, "$", "string"))).alias(f"f{i}") for i, (f, _) in enumerate(index.fields)]
        rows = search.postings(search.analyzed(docs.select("id", *fields), "id", {f"f{i}": 1.0 for i in range(len(fields))}, stemmed))
        rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{store.path}/{folder}")
        kept = store.spark.read.schema(search.POSTINGS.format(kind="string")).parquet(f"{store.path}/{folder}")
        n, lengths = search.totals(kept, len(fields))
        return Built(head, folder, True, n, tuple(lengths))
    values = keys(F.col("v"), index.fields[0][0])
    rows = docs.select("id", "body", F.explode(F.array_distinct(F.transform(values, lambda k: F.struct(k["r"].alias("r"), k["d"].alias("d"), k["s"].alias("s"))))).alias("k"))
    rows.select("k.r", "k.d", "k.s", "id", "body").repartitionByRange("r", "d", "s").sortWithinPartitions("r", "d", "s").write.parquet(f"{store.path}/{folder}")
    kept = store.spark.read.schema(KEYS).parquet(f"{store.path}/{folder}")
    several = not kept.groupBy("id").count().where("count > 1").isEmpty()
    return Built(head, folder, several)


def keys(v: Column, field: str) -> Column:
    """The keys of the values that a comparison with a field sees. A key asks its cell many times, so the cell is made once."""
    return F.transform(cells.opened(cells.walk(v, field.split("."))), lambda x: cells.let(cells.of_variant(x), cells.key))


def usable(store: Store, built: Built | None) -> bool:
    """Whether the table's commit is part of head's history still."""
    return built is not None and built.commit in store.commits and store.is_ancestor(built.commit, store.head() or GENESIS)


def since(store: Store, built: Built) -> DataFrame | None:
    """(id, op, body) of the documents that were touched since the table was built, the newest operation of each; None if none was."""
    parts = [p for c in store.commits_since(built.commit, store.head()) for p in c.parts]
    if not parts:
        return None
    log = store._parts(parts)
    return (log if len(parts) == 1 else history.snapshot(log, keep_deletes=True)).select("id", "op", "body")


def key_rows(store: Store, built: Built, wanted: Column) -> DataFrame:
    """(id, body) of the documents that may satisfy a comparison, given as a condition on the table's key columns r, d and s, and of all that are newer than the table."""
    rows = store.spark.read.schema(KEYS).parquet(f"{store.path}/{built.folder}").where(wanted).select("id", "body")
    rows = rows.dropDuplicates(["id"]) if built.several else rows
    newer = since(store, built)
    if newer is None:
        return rows
    return rows.join(newer.select("id"), "id", "left_anti").unionByName(newer.where("op = 'write'").select("id", "body"))


def condition(op: str, value: object) -> Column | None:
    """What key columns hold where a value compares so: a condition that is never too strict. None if the table does not help."""
    if isinstance(value, bool | int | float):
        d = F.lit(float(value))
        return (F.col("r") == 1) & {"=": F.col("d") == d, "<": F.col("d") <= d, "<=": F.col("d") <= d, ">": F.col("d") >= d, ">=": F.col("d") >= d}[op]
    if isinstance(value, str):
        s = F.lit(value)
        return (F.col("r") == 2) & {"=": F.col("s") == s, "<": F.col("s") < s, "<=": F.col("s") <= s, ">": F.col("s") > s, ">=": F.col("s") >= s}[op]
    return None


def text_hits(store: Store, built: Built, index: S.CreateIndex, query: str, stemmed: bool) -> DataFrame:
    """(id, score) by a stored full-text index. What newer commits touched is taken out of it, counts too, and analysed in its place."""
    fields = {f"f{i}": w for i, (_, w) in enumerate(index.fields)}
    rows = store.spark.read.schema(search.POSTINGS.format(kind="string")).parquet(f"{store.path}/{built.folder}")
    n, lengths = built.documents, list(built.lengths)
    newer = since(store, built)
    if newer is not None:
        gone, sizes = search.totals(rows.join(newer.select("id"), "id", "left_semi"), len(fields))
        own = newer.where("op = 'write'").withColumn("v", F.try_parse_json("body"))
        texts = [F.array_compact(F.transform(cells.spread(cells.walk(F.col("v"), f.split("."))), lambda v: F.try_variant_get(v, "$", "string"))).alias(f"f{i}") for i, (f, _) in enumerate(index.fields)]
        fresh = search.postings(search.analyzed(own.select("id", *texts), "id", fields, stemmed))
        more, added = search.totals(fresh, len(fields))
        n, lengths = n - gone + more, [a - b + c for a, b, c in zip(lengths, sizes, added)]
        rows = rows.join(newer.select("id"), "id", "left_anti").unionByName(fresh)
    return search.bm25_stored(rows, n, lengths, fields, query, stemmed)
