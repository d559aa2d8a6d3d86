"""A document pipeline built from the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  Rows that repeat an id are
one document: a decision about it holds for all of them.  Null and empty texts pass
the filters unless the classifier rejects a text without words; empty tables stay
empty; columns beside those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm import bpe, decontam, filters, neardup, quality, substring
from contestry.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier gives at least grade 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.grade(docs.select(*COLUMNS), quality.fit(docs, labels)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar five-word shingle sets."""
    copies = neardup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id")
    return filters.without(docs.select(*COLUMNS), materialise(copies, "pipeline_copies"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occurred before; those that consist of such passages go."""
    cut = substring.remove_repeats(docs.select(*COLUMNS))
    changed = F.size("removed") > 0
    left = cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; a row without id can't be named and stays."""
    found, _ = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = materialise(found.where("n_hit > 0").select("doc_id"), "pipeline_contaminated")
    return filters.without(docs.select(*COLUMNS), found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and of the text decoded from them."""
    return bpe.digests(bpe.round_trip(docs), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", encode),
]

#: A model fit, components of similar sets and ranked merges have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
