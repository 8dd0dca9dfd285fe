"""URL filters: a blocked Bloom filter passes possible hits, an exact hash join removes its false positives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import matched, values_table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, BITS_A_WORD = 4, 2
#: Blocks of 256 bits of a filter at most: 2**18 rows of 40 bytes, which bounds what is broadcast. Beyond it, the filter only gets less selective.
MAX_BLOCKS = 1 << 18


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column, word: int) -> Column:
    """BITS_A_WORD bits of a word of the key's block."""
    h = F.xxhash64(key, F.lit(word))
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.pmod(F.shiftright(h, 8 * i), F.lit(64)).cast("int")) for i in range(BITS_A_WORD)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, w0 .. w3) of the listed keys: each key sets BITS_A_WORD bits in each of the four words of one block."""
    k = F.col(f"`{column}`")
    return keys.select(_block(k, blocks).alias("block"), *[_mask(k, w).alias(f"w{w}") for w in range(WORDS)]).groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def passing(candidates: DataFrame, column: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The candidates whose key may be listed; none that is listed is lost."""
    k = F.col(f"`{column}`")
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.col(f"w{w}").bitwiseAND(_mask(k, w)) == _mask(k, w))
    joined = candidates.withColumn("block", _block(k, blocks)).join(F.broadcast(bloom), "block")
    return joined.where(hit).select(*candidates.columns)


def listed_rules(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, verdict) of rules like ('block', 'example.org/es/'); the last of equal rules holds."""
    return values_table(spark, [(rule, verdict) for rule, verdict in {rule: verdict for verdict, rule in rules}.items()], "key string, verdict string")


def _looked_up(candidates: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """candidates, a written table, with the columns of listed (key, ...) where their key is: a Bloom filter first, then an exact join, in which a hot key of many candidates is split."""
    blocks = min(MAX_BLOCKS, max(16, listed.count() // 8))
    possible, _ = written(passing(candidates, column, bloom_filter(listed, "key", blocks), blocks))
    often = possible.groupBy(F.col(column).alias("of")).agg(F.count(F.lit(1)).alias("often"))
    found, _ = written(listed.join(often, F.col("key") == F.col("of")).drop("of"))
    return matched(possible, found, [(column, "key")], "often", 40 + F.octet_length("key")).where("key IS NOT NULL")


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """The rows of df (all columns) with host, path, rule and verdict; columns of df with these names are replaced.

    A rule (key = host + path, verdict) fits its host and all subdomains if the url's path starts with the rule's; the longest fitting rule wins. Each
    different (host, path) is looked up once, which folds hot urls: first the host and its parent domains among the hosts of rules, then the path's beginnings
    of such lengths as the rules of that host have, among the rules. Both go through a Bloom filter and an exact join, which splits hot keys.
    Null url, or one without ://: empty host and path, no rule; they are never moved for a join. Very long urls count whole. Repeated rows stay. An empty list:
    `otherwise` for all. Empty input: no rows.
    """
    base = df.drop(*[c for c in df.columns if c.lower() in ("host", "path", "rule", "verdict")])
    parts = base.withColumn("host", host_of(F.col(f"`{url}`"))).withColumn("path", path_of(F.col(f"`{url}`")))
    listed, _ = written(rules.where(F.col("key").isNotNull()).select("key", "verdict"))
    hosts, _ = written(listed.groupBy(F.substring_index("key", "/", 1).alias("key")).agg(F.collect_set(F.length("key") - F.length(F.substring_index("key", "/", 1))).alias("lengths")))
    longest = hosts.agg(F.max(F.size(F.split("key", r"\.")))).first()[0]
    if longest is None:
        return parts.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))
    places, _ = written(parts.where("host <> ''").groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.count(F.lit(1)).alias("rows")))
    labels = F.least(F.size(F.split("h", r"\.")), F.lit(longest))
    domains, _ = written(places.select("h", "p", F.explode(F.transform(F.sequence(F.lit(1), labels), lambda n: F.call_function("substring_index", F.col("h"), F.lit("."), -n))).alias("domain")))
    owned = _looked_up(domains, "domain", hosts)
    begins = F.transform(F.filter("lengths", lambda n: n <= F.length("p")), lambda n: F.concat("domain", F.col("p").substr(F.lit(1), n)))
    candidates, _ = written(owned.select("h", "p", F.explode(begins).alias("candidate")))
    exact = _looked_up(candidates, "candidate", listed)
    best = exact.groupBy("h", "p").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key"), F.col("verdict"))).alias("best"))
    best, _ = written(best.join(places, ["h", "p"]).select("h", "p", F.col("best.key").alias("rule"), F.col("best.verdict").alias("verdict"), "rows"))
    out = matched(parts, best, [("host", "h"), ("path", "p")], "rows", 40 + F.octet_length("h") + F.octet_length("p") + F.octet_length("rule"))
    return out.select(*parts.columns, "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
