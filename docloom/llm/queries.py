"""The opN_<name> queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, chat, decontaminate, html_text, langid, licenses, minhash, quality, sharding, urls
from docloom.llm.common import sha_hex, small_batches, table
from docloom.llm.oracles import ORACLE_SQL  # noqa: F401

SHARDS = 24
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
EXTRA_CHAT = "</s>[INST] ok [/INST]"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the license that its whole text is, and the licenses that its lines name."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license", F.size("notices").cast("long").alias("n_notices"), F.array_join("notices", ",").alias("notices"), "digest")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its tokens, and the bytes that they decode to."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_texts(docs, vocabulary_path(), offsets=None, decoded="decoded")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha_hex(F.col("decoded")).alias("decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.listed_rules(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge_quality(docs).drop("text", "source", "cleaned")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the formatted conversations: turns from the string, loss text from the mask."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_CHAT).alias("text"))
    done = chat.format_chats(own.unionByName(extra))
    turns = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = done.select("conv_id", chat.parse_chat(F.col("formatted")).alias("turns"), chat.masked_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha_hex(F.array_join(turns, "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha_hex(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = html_text.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each place where a document holds a benchmark item."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.start", "leak.end", "leak.edits")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_sharding": op3_sharding,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_format": op7_chat_format,
    "op8_html_extraction": op8_html_extraction,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_decontamination": op10_decontamination,
}

