"""Change feeds over the operation log, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.sources.store import OPS


def change_feed(spark: SparkSession, path: str, after: int = 0, files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """The operations of a store as a stream, those of commits after `after` only. Restarts resume from the query's checkpoint.

    `files_per_batch` and `bytes_per_batch` bound a micro-batch, so a slow reader is not flooded.
    """
    reader = spark.readStream.schema(OPS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(f"{path.rstrip('/')}/ops").select("seq", "commit", "id", "op", "body").where(F.col("seq") > after)


def filtered(feed: DataFrame, keep: Column, op: str = "op", body: str = "body") -> DataFrame:
    """A subscriber's view: a write that does not satisfy the filter becomes a delete, so the subscriber drops what left its view."""
    passes = F.coalesce(keep, F.lit(False))
    goes = (F.col(op) == "write") & ~passes
    out = feed.withColumn(op, F.when(goes, "delete").otherwise(F.col(op)))
    return out.withColumn(body, F.when(F.col(op) == "write", F.col(body))) if body in feed.columns else out


def bootstrap(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catch-up by state: the operations (id, op, body) between two snapshots, where the commits between are not at hand."""
    from docloom.operators.history import revert_operations

    return revert_operations(old, new)


class FeedOverflow(RuntimeError):
    """A reader is too far behind: it starts again from a snapshot (bootstrap)."""


def frames(ops: DataFrame, max_bytes: int, order: str = "seq", key: str = "id", body: str = "body") -> DataFrame:
    """A batch of operations with `frame`: those of one commit, in order of their ids, cut so that no frame of several operations holds more than about max_bytes of bodies."""
    before = F.sum(F.coalesce(F.octet_length(body), F.lit(0)).cast("long")).over(Window.partitionBy(order).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return ops.withColumn("frame", F.floor(F.coalesce(before, F.lit(0)) / max_bytes).cast("int"))


def fan_out(feed: DataFrame, sinks: dict[str, tuple[Column, Callable[[DataFrame, int], None]]], checkpoint: str, trigger: dict | None = None, most: int | None = None) -> StreamingQuery:
    """One read of the feed for many subscribers: each micro-batch is cached, and each sink gets its filtered view of it, made once for sinks with the same filter.

    trigger: that of the stream, such as {"processingTime": "5 seconds"} to run until it is stopped; by default it ends when it has caught up. most: operations of a micro-batch; with
    more the query ends with FeedOverflow, and the sinks have seen nothing of the batch.
    """

    def batch(df: DataFrame, n: int) -> None:
        df.persist()
        views: dict[str, DataFrame] = {}
        try:
            if most is not None and df.limit(most + 1).count() > most:
                raise FeedOverflow(f"batch {n} has more than {most} operations")
            for keep, sink in sinks.values():
                if str(keep) not in views:
                    views[str(keep)] = filtered(df, keep).persist()
                sink(views[str(keep)], n)
        finally:
            for view in views.values():
                view.unpersist()
            df.unpersist()

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def desync(commits: DataFrame, namespace: str = "namespace") -> DataFrame:
    """(namespace, commit, expected): commits (namespace, seq, commit, parent) whose parent is not the commit seen before: a window over a batch, kept state over a stream."""
    own = commits.select(F.col(namespace).alias("namespace"), "seq", "commit", "parent")
    if not commits.isStreaming:
        before = F.lag("commit").over(Window.partitionBy("namespace").orderBy("seq"))
        return own.withColumn("expected", before).where(F.col("expected").isNotNull() & ~F.col("parent").eqNullSafe(F.col("expected"))).select("namespace", "commit", "expected")

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        bad = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if last is not None and r.parent != last:
                bad.append((key[0], r.commit, last))
            last = r.commit
        state.update((last,))
        yield pd.DataFrame(bad, columns=["namespace", "commit", "expected"])

    return own.groupBy("namespace").applyInPandasWithState(check, "namespace string, commit string, expected string", "last string", "append", GroupStateTimeout.NoTimeout)


def sweep_expired(snapshot: DataFrame, expires: str, now: Column, key: str = "id") -> DataFrame:
    """The delete operations that a sweep commits for expired documents."""
    from docloom.operators.history import expired_operations

    return expired_operations(snapshot, expires, now, key).withColumn("body", F.lit(None).cast("string"))
