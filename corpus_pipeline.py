"""Corpus preparation in stages; each stage's documents are written and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.contamination import contaminated, find_passages
from locusflow.llm.language import UNKNOWN, identify_languages
from locusflow.llm.packing import pack_documents
from locusflow.llm.setsketch import near_groups, text_key
from locusflow.llm.templates import LONG_DOCS, drop_recurring_lines
from locusflow.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, to which no language can be given, go."""
    found = identify_languages(docs, as_column="__language")
    return found.where(F.col("__language.lang_pred") != UNKNOWN).drop("__language")


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates and repeated passages leave the texts; n_chars follows, every document stays."""
    found = drop_recurring_lines(docs, dropped_column="__dropped", long_docs=LONG_DOCS)
    chars = F.when(F.size("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).drop("__dropped")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; documents without words, or without an id, stay.

    Rows of one id with different texts are different documents; rows that repeat id and text stay or go together."""
    gone = near_groups(docs).where("not stays").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = (F.col("doc_id") == F.col("__id")) & (text_key("text") == F.col("__key"))
    return docs.join(gone, same, "left_anti")


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words are passages of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_passages(docs, benchmark, as_column="__passages")
    return found.where(~contaminated("__passages")).drop("__passages")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", without_recurring_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_test_items),
    ("packing", packed),
]

#: Fitted models and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
