"""From raw documents to training token files, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and
returns a DataFrame that is written as Parquet and read again as the next one's input.
All but the last return the columns of ``documents``. Nulls, empty and very long texts,
repeated rows and empty tables are handled as each operator states; an empty input
gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse.llm import mixing, neardup, quality, tiling, tokens
from wirepulse.llm.files import output_folder
from wirepulse.llm.rows import table, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or fall below the log-likelihood ratio go."""
    ratios = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, ratios).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest id."""
    rows = neardup.near_duplicate_rows(docs, "doc_id", "text")
    return without(docs, rows.where(~F.col("kept")).select("id", "key"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item go."""
    found = tiling.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("id"), "key"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes once for each of its uses."""
    return mixing.mix(docs).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending id order; what they hold of each document, read back."""
    return tokens.token_report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Hashes, tiles and tokens are not SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the cluster's shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = output_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
