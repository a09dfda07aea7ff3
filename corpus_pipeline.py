"""The corpus pipeline: language, repeated lines, near copies, benchmark passages, source weights.

Each stage takes the documents that the one before it kept, and its decisions take effect. All
but the last return the columns of ``documents``; the last repeats documents and numbers their
copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from riskframe.llm.common import free_name, materialise
from riskframe.session import prepare


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that at least five labelled ones teach.

    Text without letters goes, null text too, and so does text of no clear language (a score below 0.35).
    """
    return language_id.keep_known(docs, language_id.fit(docs, least=5))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated three-line windows out; a document of nothing else goes."""
    count, gone = free_name(docs, "n_lines", "n_removed")
    rows = line_dedup.dedup(docs, n_lines=count, n_removed=gone)
    rows = rows.where((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near copies; documents with null text stay, rows with null id come last."""
    return near_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, asked with other values or not."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until every source has its share of words; a null source is a source, a null text has no words."""
    return mixing.mix(docs)


STAGES = [
    ("language identification", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near-duplicate removal", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
]

# The stages learn models, draw hashes and follow links, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the rows of every stage are written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs


