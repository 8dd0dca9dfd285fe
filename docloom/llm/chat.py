"""Chat formatting: turns of a conversation to one string with a loss mask, in Spark expressions only.

A conversation is a row of blocks, one for each run of turns with the same role:

    <s>[INST]role[/INST]text of a turn[TURN]text of the next turn</s>

The strings in CONTROL mark turns and nothing else. Where a role or a text holds one, a backslash is put behind its first character (and one more
where there are backslashes already), so no text can end a turn or open another, and unescape() restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, HEAD_END, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[TURN]", "</s>"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]"]
REST = r"(/?(?:s>|INST\]|TURN\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + REST, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + REST, "$1$2$3")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, n_turns, segments array<struct<text, loss>>, formatted.

    `formatted` is the concatenation of the segments; the segments with loss = true are the mask (each text of `loss_role`, markers left out).
    Turns sort by (turn, role, text): null turns first, ties in that order, repeated rows stay. Null role or text: empty. Rows with a null
    conversation id form one conversation with a null id. Very long texts count whole. No rows: no conversations. Other columns are not read.
    Texts are escaped before the shuffle. All turns of a conversation meet in one row because its output is one string.
    """
    turns = df.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        escape(F.coalesce(F.col(f"`{role}`"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"),
    )
    own = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    n = F.size("turns")
    # Neighbours of one role are merged: the turns from each change of role to the next one.
    first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.col("turns")[i - 1]["role"] != F.col("turns")[F.greatest(i - 2, F.lit(0))]["role"]))
    runs = own.withColumn("first", first).withColumn("runs", F.transform("first", lambda at, k: F.slice("turns", at, F.coalesce(F.get("first", k + 1), n + 1) - at)))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    mark = lambda text: piece(text, F.lit(False))

    def pieces(run: Column) -> Column:
        masked = run[0]["role"] == escape(F.lit(loss_role))
        texts = F.flatten(F.transform(run, lambda x: F.array(mark(F.lit(NEXT)), piece(x["text"], masked))))
        return F.concat(F.array(mark(F.concat(F.lit(OPEN), run[0]["role"], F.lit(HEAD_END)))), F.slice(texts, F.lit(2), F.size(texts) - 1), F.array(mark(F.lit(CLOSE))))

    cut = runs.select("conv", n.cast("long").alias("n_turns"), F.flatten(F.transform("runs", pieces)).alias("segments"))
    return cut.select(F.col("conv").alias(conv), "n_turns", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))


def parse_chat(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted conversation."""
    blocks = F.split(formatted, CLOSE)

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), HEAD_END, 1)
        body = F.substr(b, F.length(role) + F.lit(len(OPEN) + len(HEAD_END) + 1))
        return F.transform(F.split(body, r"\[TURN\]"), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns))


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
