"""Confidence gate: which verdicts become alerts, and why the others do not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse import config
from wirepulse.functions import text as tx

EVENT_SCHEMA = "event string, icon string, label string, enabled boolean, min_confidence double, window_hours int"


def event_table(spark: SparkSession, events=config.EVENTS) -> DataFrame:
    """The event settings as a table: one row per event type."""
    rows = [(e.id, e.icon, e.label, e.enabled, e.min_confidence, e.window_hours) for e in events]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def with_event_config(df: DataFrame, events: DataFrame) -> DataFrame:
    """Attach event settings. The table has one row per event type, so it is broadcast."""
    return df.join(F.broadcast(events), "event", "left")


def gate_verdicts(
    verdicts: DataFrame, events: DataFrame, global_floor: float = 0.7, paused: bool = False
) -> DataFrame:
    """Add ``threshold``, ``alert`` and ``rejected_reason`` (null when alerting)."""
    joined = with_event_config(verdicts, events.select("event", "enabled", "min_confidence"))
    threshold = F.greatest(F.coalesce("min_confidence", F.lit(global_floor)), F.lit(global_floor))
    allowed = F.coalesce("enabled", F.lit(False))
    passes = F.coalesce(F.col("relevant") & allowed & (F.col("confidence") >= threshold), F.lit(False))
    why = (
        F.when(~F.col("is_fintech"), "not fintech")
        .when(F.col("region") == "other", "region other")
        .when(F.col("event").isNull(), "not a tracked event")
        .when(~allowed, F.concat(F.lit("event "), F.col("event"), F.lit(" is disabled")))
        .otherwise(
            F.concat(F.lit("confidence "), tx.to_fixed(F.col("confidence"), 2), F.lit(" below "), threshold.cast("string"))
        )
    )
    reason = F.when(~passes, why).when(F.lit(paused), "paused")
    return joined.select(
        *verdicts.columns, threshold.alias("threshold"), (passes & F.lit(not paused)).alias("alert"),
        reason.alias("rejected_reason"),
    )
