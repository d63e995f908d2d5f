"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse.llm import (
    centroids, licenses, mixing, neardup, periodic, quality, secrets, tiling, token_counts, tokens, toxicity, urls, warc,
)
from wirepulse.llm.rows import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and block list over every url of ``pages``; the list comes from page contents."""
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.listed_urls(pages))


ORACLES["op1_url_filter"] = urls.ORACLE


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of ``documents`` by source, as many tokens as there are."""
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, in any order of their parts."""
    found = tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "n_words", F.size("tiles").cast("long").alias("n_tiles"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("found")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts, log-likelihood ratio and verdict of every document."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every whole text of ``documents``."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labelled rows that are not held out."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    return warc.archive_report(table(spark, sf_dir, "pages"))


ORACLES["op4_warc"] = warc.ORACLE


@query
def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to binary files and read back."""
    return tokens.token_report(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole text of ``documents``, a tenth of which get a planted period."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodic.planted_period)
    return periodic.run_digest(found)


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid clusters of all vectors of ``embeddings``."""
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


ORACLES["op12_centroids"] = centroids.oracle()


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))
