"""The feed registry: a table the user supplies, and its integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse import schemas


def read_registry(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.SOURCES).format(fmt).load(path)


def read_rejected(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.REJECTED_SOURCES).format(fmt).load(path)


def check_registry(sources: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rule violations as (rule, source_id): empty when the registry is sound."""
    def repeated(column: str, rule: str) -> DataFrame:
        twice = sources.groupBy(column).agg(F.count("*").alias("_n")).where("_n > 1").select(column)
        return sources.join(twice, column, "left_semi").select(F.lit(rule).alias("rule"), "source_id")

    def broken(condition, rule: str) -> DataFrame:
        return sources.where(condition).select(F.lit(rule).alias("rule"), "source_id")

    both = sources.where("enabled").join(rejected.select("url").distinct(), "url", "left_semi")
    return (
        repeated("source_id", "id is not unique")
        .unionByName(repeated("url", "url is not unique"))
        .unionByName(broken(~F.col("url").startswith("https://"), "url is not https"))
        .unionByName(broken(F.col("min_interval_seconds") < 60, "polled more than once a minute"))
        .unionByName(both.select(F.lit("enabled and rejected").alias("rule"), "source_id"))
    )
