"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import in_pieces, let, unfolded

# Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
HALF = 2147483648.0

MASK32 = 0xFFFFFFFF
#: Sub-buckets of a shard within which slots are numbered; their counts (shards x BUCKETS rows at most) are the only broadcast data.
BUCKETS = 2048
FEW_STEPS = 12


def _low32(a: Column, c: int) -> Column:
    """The low 32 bits of a * c for a, c < 2**32, without leaving 63 bits (ANSI mode raises on overflow)."""
    high = (a * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (a * F.lit(c & 0xFFFF) + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK32))


def _next_key(hi: Column, lo: Column) -> Column:
    """struct(hi, lo) of key * MULTIPLIER + 1 modulo 2**64."""
    ch, cl = MULTIPLIER >> 32, MULTIPLIER & MASK32
    t0, t1 = lo * F.lit(cl & 0xFFFF), lo * F.lit(cl >> 16)
    s = t0 + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(s, 32) + F.shiftright(t1, 16)
    return F.struct(
        (carry + _low32(hi, cl) + _low32(lo, ch)).bitwiseAND(F.lit(MASK32)).alias("hi"),
        s.bitwiseAND(F.lit(MASK32)).alias("lo"),
    )


def _advance(state: Column, shards: int, steps: int) -> Column:
    def step(acc: Column, _: Column) -> Column:
        moved = let(
            _next_key(acc["hi"], acc["lo"]),
            lambda k: F.struct(
                acc["j"].alias("b"),
                F.floor((acc["j"] + 1).cast("double") * (F.lit(HALF) / (F.shiftright(k["hi"], 1) + 1).cast("double"))).cast("long").alias("j"),
                k["hi"].alias("hi"),
                k["lo"].alias("lo"),
            ),
        )
        return F.when(acc["j"] < F.lit(shards), moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)


def key_halves(key: Column) -> tuple[Column, Column]:
    """The first two 32-bit words of the MD5 of the key's text; a null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (0 to shards - 1) of a key. Most keys are settled in a few steps; the rest take up to `shards` steps, which is the exact bound."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    hi, lo = key_halves(key)
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
    return let(
        _advance(start, shards, FEW_STEPS),
        lambda s: F.when(s["j"] >= F.lit(shards), s["b"]).otherwise(_advance(s, shards, shards)["b"]),
    ).cast("int")


def shard_rows(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the key and the number of shards alone decide; with one more shard, rows move only into the new one.
    Slots number the rows of a shard from 0 without gaps, by (bucket, key, crc, size). Equal rows are folded to a count before any shuffle; a large count
    is split into pieces, which go to different buckets and are unfolded there. So a row that repeats many times is never gathered in one task. A shard's
    rows are numbered bucket by bucket, with offsets from a table of at most shards x BUCKETS counts.
    Null key: the empty key. Null text: size 8, crc of the empty text. A very long text counts with all its bytes. Columns other than key and text are not
    read. Empty input: no rows.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("k"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    bucket = F.pmod(F.xxhash64("k", "crc", "size", "piece"), F.lit(BUCKETS)).cast("int")
    folded = in_pieces(rows.groupBy("k", "size", "crc").agg(F.count(F.lit(1)).alias("n")), "n", "piece")
    keyed = folded.withColumn("shard", jump_shard(F.col("k"), shards)).withColumn("bucket", bucket)
    starts = _bucket_starts(keyed)
    within = F.expr("sum(n) OVER (PARTITION BY shard, bucket ORDER BY k, crc, size, piece ROWS UNBOUNDED PRECEDING) - n")
    placed = keyed.withColumn("first", within).join(F.broadcast(starts), ["shard", "bucket"])
    return placed.select("k", "size", "crc", "shard", (F.col("start") + F.col("first")).alias("at"), unfolded("n").alias("copy")).select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("at") + F.col("copy")).alias("slot"),
        jump_shard(F.col("k"), shards + 1).alias("grown_shard"),
    )


def _bucket_starts(keyed: DataFrame) -> DataFrame:
    """(shard, bucket, start): rows of the shard in lower buckets. At most shards x BUCKETS rows."""
    counts = keyed.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    start = F.expr("coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")
    return counts.select("shard", "bucket", start.alias("start"))
