"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Binds `value` to a lambda variable, so that `body` can use it many times and it is evaluated once."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that do not clash with those of df, ignoring case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in taken:
            k += 1
            name = f"{stem}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only where that is unset (tests on one machine) a folder is made up."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            base = at.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "/tmp/docloom-checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []
#: Hadoop's local file system keeps checksum files and starts a `chmod` for each file and each checksum file; a JVM that starts a process is in memory twice for
#: a moment. The plain one starts none. Folders on other file systems (HDFS, object stores) are written as ever.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df cut off from its lineage: written as Parquet to the shared folder and read again; and the folder."""
    path = shared_dir(df.sparkSession)
    df.write.options(**PLAIN_LOCAL).parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the folders that written() makes in it, but for those taken out of the list that it gives."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        forget(spark, *_scratch.pop())


#: Rows of a written table up to which it is sent to all executors; each is a few numbers, so some tens of MB.
BROADCAST_ROWS = 500_000
#: Bytes up to which a measured table of wider rows is sent.
BROADCAST_BYTES = 32 << 20


def sent_if_small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has BROADCAST_ROWS rows or fewer; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: A key with more than one in HEAVY of all rows is joined by a broadcast; fewer than HEAVY keys can be so frequent.
HEAVY = 10_000


def matched(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], rows: str, width: Column | int = 64) -> DataFrame:
    """left with the columns of right (null where none fits), a written table with one row a key. `rows`, which is left out, is how many rows of left have the key.

    A small right side (by width, the bytes of a row) is sent to all executors. Else its frequent keys are, of which there are fewer than HEAVY, and the
    rest goes by a shuffle in which no key has more than one in HEAVY of the rows. left is read up to twice.
    """
    size, total = right.agg(F.coalesce(F.sum(F.lit(width) if isinstance(width, int) else width), F.lit(0)), F.coalesce(F.sum(rows), F.lit(0))).first()
    fits = [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in on]
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.drop(rows)), fits, "left")
    heavy, light = right.where(F.col(rows) > total // HEAVY).drop(rows), right.where(F.col(rows) <= total // HEAVY).drop(rows)
    far = left.join(F.broadcast(heavy.select(*[b for _, b in on])), fits, "left_anti").join(light, fits, "left")
    return left.join(F.broadcast(heavy), fits).unionByName(far)


#: Rows alike that are unfolded from one row of counts at most.
COPIES = 10_000


def in_pieces(folded: DataFrame, n: str, piece: str) -> DataFrame:
    """Rows with a count n, those with more than COPIES split: a row for each piece, from 0, with its own count."""
    last = F.floor((F.col(n) - 1) / COPIES)
    split = folded.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return split.withColumn(n, F.least(F.col(n) - F.col(piece) * COPIES, F.lit(COPIES).cast("long")))


def unfolded(n: str) -> Column:
    """Explodes a row of in_pieces to its copies, numbered from 0."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that written() made, when nothing that is still to run reads them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_identity(text: Column) -> list[Column]:
    """120 bits by which a text is known, as two numbers; null as the empty text."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def values_table(spark: SparkSession, rows: Sequence[tuple[str, ...]], schema: str) -> DataFrame:
    """A list of the program as a table, in the plan itself: no Python worker makes its rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    made = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]) if rows else F.expr(f"CAST(array() AS ARRAY<STRUCT<{', '.join(f'{n}: string' for n in names)}>>)")
    return spark.range(1).select(F.explode(made).alias("x")).select("x.*")


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers are reused, and would keep the most that a batch ever took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Rows of an Arrow batch, set by the queries and the pipeline for executors of a few GB. Spark bounds a batch by 64 MB besides, which a JVM of that size keeps
#: several times over.
BATCH_ROWS = 1500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, for a program that has the session to itself; operators leave it alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Bytes of texts, about, that a Python worker works on at once; Spark's batches hold up to 64 MB, or one longer text.
PIECE_BYTES = 4 << 20


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, given its batches in pieces of about PIECE_BYTES, so that results are small too; memory is given back at the end of each partition."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, PIECE_BYTES))
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(pieces(batches))
        finally:
            give_back()

    return whole


def sha_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
