"""Versions of documents kept as an operation log: snapshots, histories and differences.

A log has seq (commit order), id, op ('write' or 'delete') and body columns of any type. All of it is one aggregation or one join on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(log: DataFrame, seq: int | None = None, *, order: str = "seq", key: str = "id", op: str = "op", keep_deletes: bool = False) -> DataFrame:
    """The live documents at a position: the newest operation of each id up to `seq`, deletes dropped unless asked for. Aggregates on the map side to (id, newest) first."""
    upto = log if seq is None else log.where(F.col(order) <= seq)
    newest = upto.groupBy(F.col(key).alias("__k")).agg(F.max(order).alias("__n"))
    last = upto.join(newest, (F.col(key) == F.col("__k")) & (F.col(order) == F.col("__n"))).drop("__k", "__n")
    return last if keep_deletes else last.where(F.col(op) != "delete").drop(op)


def snapshot_at(log: DataFrame, when: Column, *, time: str = "ts", order: str = "seq", key: str = "id", op: str = "op") -> DataFrame:
    """The live documents at an instant: the operations of all commits up to it."""
    return snapshot(log.where(F.col(time) <= when), order=order, key=key, op=op)


def document_history(log: DataFrame, *, order: str = "seq", key: str = "id", op: str = "op") -> DataFrame:
    """Each version of each document with its number from 1 and the position of its predecessor."""
    w = Window.partitionBy(key).orderBy(order)
    return log.withColumn("version", F.row_number().over(w)).withColumn("previous", F.lag(order).over(w))


def diff(old: DataFrame, new: DataFrame, *, key: str = "id", compare: list[str]) -> DataFrame:
    """(key, change): added, removed or modified, between two snapshots; equal documents are left out."""
    a = old.select(F.col(key).alias("__a"), F.struct(*compare).alias("__x"))
    b = new.select(F.col(key).alias("__b"), F.struct(*compare).alias("__y"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__x").eqNullSafe(F.col("__y")), "modified")
    return both.select(F.coalesce("__a", "__b").alias(key), change.alias("change")).where("change IS NOT NULL")


def revert_operations(now: DataFrame, target: DataFrame, *, key: str = "id", body: str = "body") -> DataFrame:
    """(key, op, body) that turn snapshot `now` into `target`."""
    changes = diff(now, target, key=key, compare=[body])
    back = changes.join(target.select(key, body), key, "left")
    return back.select(key, F.when(F.col("change") == "removed", "delete").otherwise("write").alias("op"), body)


def visible(df: DataFrame, expires: str, now: Column, grace_seconds: int = 0) -> DataFrame:
    """Rows that have not expired: no expiry, or one later than now less the grace."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(grace_seconds).cast("decimal(18,6)"))))


def expired_operations(df: DataFrame, expires: str, now: Column, key: str = "id") -> DataFrame:
    """The deletes of a sweep."""
    return df.where(F.col(expires) <= now).select(key, F.lit("delete").alias("op"))
