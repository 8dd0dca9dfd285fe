"""Quality rules: counts within a text, and lines that too many documents of a host share, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, WS, forget, fresh, let, text_identity, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate of a host if more different texts of the host than this hold it, whatever the host's size.
MAX_DOCS = 10
#: A document is depleted if more than this share of its words is in lines that are removed from it.
MAX_REMOVED = 0.7
#: A line, or a text, with more than one in HEAVY of all rows is joined by a broadcast: fewer than HEAVY of them can exist.
HEAVY = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words that lie in an n-word window which the text has twice or more. Windows are compared by a 64-bit hash of their words' hashes."""

    def covered(starts: Column) -> Column:
        """Words below windows at these sorted starts."""
        gaps = F.zip_with(F.slice(starts, 2, F.size(starts)), starts, lambda later, at: F.when(later.isNotNull(), F.least(later - at, F.lit(n))))
        return F.aggregate(F.filter(gaps, lambda g: g.isNotNull()), F.lit(n), lambda a, g: a + g)

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            twin = lambda x, k: (F.when(k > 0, s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]).otherwise(False)) | (F.when(k < last, s[F.least(k + 1, last)]["h"] == x["h"]).otherwise(False))
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

        return let(pairs, lambda s: let(starts(s), covered))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))

    own = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(own, lambda o: F.transform(F.sequence(F.lit(1), F.size(o) - (n - 1)), lambda i: F.xxhash64(F.slice(o, i, n))))
    return F.when(F.size(words) > n, let(windows, count)).otherwise(F.lit(0)).cast("long")


def rows_in(text: Column) -> Column:
    """Lines (cut at \\n) that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    """Lower case, white space single: what is hashed to find a line again."""
    return F.trim(F.regexp_replace(F.lower(line), WS, " "))


def line_table(text: Column) -> Column:
    """array<struct<line long, n int, at int>>: for each line with a word, the hash of the normalised line, its words and its number among all lines."""
    numbered = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(normal_line(x).alias("x"), i.alias("at")))
    return F.transform(F.filter(numbered, lambda y: y["x"] != ""), lambda y: F.struct(F.xxhash64(y["x"]).alias("line"), F.size(F.split(y["x"], " ")).alias("n"), y["at"].alias("at")))


def _identity(text: Column, host: Column) -> list[Column]:
    """The host by 64 bits (null is a host of its own), the text by 120 bits."""
    halves = text_identity(text)
    return [F.xxhash64(host.isNull(), host).alias("h"), halves[0].alias("t"), halves[1].alias("u")]


def hot_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """lines (h, t, line): (h, line, first, rows) of the lines that more than max_docs different texts of a host hold. Copies fold on the map side."""
    each = lines.groupBy("h", "line", "t").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("h", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("t").alias("first"), F.sum("n").alias("rows")).where(F.col("docs") > max_docs).drop("docs")


def removed_lines(df: DataFrame, text: str, host: str, max_docs: int) -> tuple[DataFrame, str]:
    """(h, t, u, gone array<int>, lost): of each text of a host that loses lines, their numbers and words; a written table; and its folder.

    Texts are read once, into a table of numbers. Hot lines are joined back by a broadcast if they are few. Else those with more than one in HEAVY of
    all rows are, of which there are less than HEAVY, and the rest by a shuffle in which no key has more rows than that.
    """
    spark = df.sparkSession
    c = lambda name: F.col(f"`{name}`")
    slim, slim_path = written(df.select(*_identity(c(text), c(host)), line_table(c(text)).alias("lines")).where(F.size("lines") > 0))
    lines = slim.select("h", "t", "u", F.explode("lines").alias("x")).select("h", "t", "u", "x.line", "x.n", "x.at")
    over, over_path = written(hot_lines(slim.select("h", "t", F.explode(F.array_distinct(F.col("lines.line"))).alias("line")), max_docs))
    found = over.select(F.col("h").alias("oh"), F.col("line").alias("ol"), "first", "rows")
    same = (F.col("line") == F.col("ol")) & (F.col("h") == F.col("oh"))
    if over.count() <= BROADCAST_ROWS:
        hits = lines.join(F.broadcast(found), same)
    else:
        limit = slim.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0] // HEAVY
        heavy = lines.join(F.broadcast(found.where(F.col("rows") > limit)), same)
        hits = heavy.unionByName(lines.join(found.where(F.col("rows") <= limit), same))
    once = hits.where(F.col("t") != F.col("first")).groupBy("h", "t", "u", "at").agg(F.max("n").alias("n"))  # copies of a text count once
    gone, path = written(once.groupBy("h", "t", "u").agg(F.collect_list("at").alias("gone"), F.sum("n").alias("lost")))
    forget(spark, slim_path, over_path)
    return gone, path


def _base(words: Column, min_words: int, max_repeat_percent: int) -> Column:
    return let(words, lambda w: (F.size(w) >= min_words) & (repeat_words(w) * 100 <= F.size(w) * max_repeat_percent))


def _with_losses(base: DataFrame, text: str, host: str, max_docs: int, names: list[str]) -> DataFrame:
    """base with the columns `names`: gone and lost of removed_lines, null where a text keeps all lines. A large table of them is joined by a shuffle of
    (host, text); AQE splits the partition of a text with very many copies."""
    h, t, u, h2, t2, u2 = fresh(base, "h", "t", "u", "h_of", "t_of", "u_of")
    c = lambda name: F.col(f"`{name}`")
    gone, _ = removed_lines(base, text, host, max_docs)
    size = gone.agg(F.coalesce(F.sum(F.size("gone") + F.lit(12)), F.lit(0)) * 4).first()[0]
    gone = gone.toDF(h2, t2, u2, *names)
    keyed = base.select(*[c(x) for x in base.columns], *[k.alias(n) for k, n in zip(_identity(c(text), c(host)), (h, t, u))])
    joined = keyed.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, (c(h) == c(h2)) & (c(t) == c(t2)) & (c(u) == c(u2)), "left")
    return joined.select(*[c(x) for x in base.columns], *[c(n) for n in names])


def _rest(text: Column, gone: Column) -> Column:
    """The text without its lines of these numbers; a text that loses none stays as it is."""
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n"))


def keep_good(
    df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", *, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """The rows of df (all columns) that judge_quality keeps, each text without its boilerplate lines; nulls, empty, repeated and very long texts as there."""
    c = lambda name: F.col(f"`{name}`")
    gone, lost = fresh(df, "gone", "lost")
    n_words = F.size(words_of(c(text)))
    good = _with_losses(df, text, host, max_docs, [gone, lost]).where(c(lost).isNull() | (c(lost) <= n_words * max_removed)).where(_base(words_of(c(text)), min_words, max_repeat_percent))
    return good.select(*[_rest(c(text), c(gone)).alias(x) if x.lower() == text.lower() else c(x) for x in df.columns])


def judge_quality(
    df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", *, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """The rows of df (all columns) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept and cleaned.

    A normalised line that more than max_docs different texts of its host hold is boilerplate: it is removed from all of them but one (the least by a
    hash of the text), in all copies alike, so of a large group of near copies one stays whole. Equal texts of a host count as one document: copies alone
    make no line boilerplate. cleaned is the text without these lines (a very long text like any other); removed_words are their words; beyond the
    share max_removed of its words a document is depleted and not kept. Hosts and lines are known by 64-bit hashes, texts by 120 bits.
    Null text: no words, so base_failed, cleaned null. Null host: a host of its own. Null key: a key like any other. Repeated rows share one verdict. Empty
    input: no rows. Columns of df with these names are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "cleaned"]
    base = df.drop(*[c for c in df.columns if c.lower() in added])
    words, rows, gone, lost = fresh(base, "words", "rows", "gone", "lost")
    c = lambda name: F.col(f"`{name}`")
    own = _with_losses(base, text, host, max_docs, [gone, lost]).withColumn(words, words_of(c(text))).withColumn(rows, rows_in(c(text)))
    counted = own.select(
        *[c(x) for x in base.columns],
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(F.coalesce(c(text), F.lit("")), r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col(words)).alias("n_repeat_words"),
        c(gone),
        F.coalesce(c(lost), F.lit(0)).cast("long").alias("removed_words"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    kept = ~failed & (F.col("removed_words") <= F.col("n_words") * max_removed)
    return counted.select(*[c(x) for x in base.columns], *added[:5], failed.alias("base_failed"), "removed_words", kept.alias("kept"), _rest(c(text), c(gone)).alias("cleaned"))
