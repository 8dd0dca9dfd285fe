"""The training-data pipeline: documents through language ID, quality rules, near-duplicate removal, decontamination and byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, langid, minhash, quality
from docloom.llm.common import forget, scratch, small_batches, table, written
from docloom.llm.queries import vocabulary_path

#: DuckDB has no equivalent of the first, third, fourth and fifth stage; test_pipeline in tests/llm/test_llm_queries.py holds run() against a brute-force version.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """docs with its columns renamed c0, c1, ..., so that no extra column clashes with what an operator adds; and the new name of a column."""
    at = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), lambda name: at[name]


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or whose language the calibrated model can't tell, go.

    Repeated rows and ties share a verdict. Very long texts are read whole. Extra columns stay, whatever their names. An empty table gives an empty one.
    """
    small_batches(spark)
    own, c = _plain(docs)
    return _named(langid.identify(own, c("doc_id"), c("text"), c("lang")).where("NOT rejected"), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules (null and empty texts too) or are depleted go; the others lose their boilerplate lines, and n_chars follows the text.

    A null source is a host of its own. Repeated rows and copies share a verdict and stay alike. Very long texts are read whole. Extra columns stay,
    whatever their names. An empty table gives an empty one.
    """
    own, c = _plain(docs)
    kept = quality.keep_good(own, c("doc_id"), c("text"), c("source"))
    return _named(kept.withColumn(c("n_chars"), F.length(c("text")).cast(kept.schema[c("n_chars")].dataType)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the least doc_id, a null first, then of the least hash of its text; repeated rows stay once.

    Texts without words (null and empty ones) all stay. Very long texts are compared whole. Extra columns stay, whatever their names. An empty table
    gives an empty one.
    """
    small_batches(spark)
    own, c = _plain(docs)
    return _named(minhash.one_of_each(own, c("doc_id"), c("text")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, wherever in the text it is, however long the text.

    Null and empty texts hold none; an empty benchmark leaves all documents. Repeated rows share a verdict. Extra columns stay, whatever their names. An empty
    table gives an empty one.
    """
    small_batches(spark)
    own, c = _plain(docs)
    return _named(decontaminate.find_leaks(own, table(spark, sf_dir, "benchmark"), c("text")).where("size(leaks) = 0"), docs)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text again; a row for each row, of the whole text. A null text has no tokens.
    Extra columns are left out, whatever their names. An empty table gives an empty one."""
    small_batches(spark)
    own = docs.select("doc_id", "lang", "source", "text")
    done = bpe.encode_texts(own, vocabulary_path(), offsets=None, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again. What a stage wrote on its way is deleted behind it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs, path = written(stage(spark, docs, sf_dir))
            made.remove(path)
        forget(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
