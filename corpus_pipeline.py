"""From documents to packed sequences: five stages, each on all rows that the one before kept.

Every stage but the last returns the columns of documents; a stage's result is written as Parquet and reread as the next one's input.

Defined results: a document without text or of few words fails the quality rules; nulls, ties and repeated rows in line dedup, decontamination and packing are as their modules
say; of a group of linked texts the Jaccard join keeps the rows that carry its least id (repeated ones included), and every row of a null id; an empty table
gives an empty result of the same columns; further columns of documents pass through every stage but the last, under whatever names, and the last returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from podium.llm.tables import pin


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated windows of lines; those with no line left go."""
    cut = line_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group linked at five words and a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage aligns with a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("best-fit packing", sequences)]

#: The verdict of a trained model, alignments and packing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
