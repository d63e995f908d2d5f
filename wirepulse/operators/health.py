"""Source and scorer health from append-only logs.

The fetch log has one row per check: source_id, ts, check_id, ok, etag,
last_modified, body_hash, error. State is always "as of now" and derived; a
source with most of the log is still reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirepulse import config
from wirepulse.functions import times as tm
from wirepulse.operators.ordered import failure_streaks, previous, side_by_side


def state_asof(log: DataFrame, now) -> DataFrame:
    """Per source: last check, last success, errors since, last error.

    Two passes of plain aggregates: the last success first, then what came
    after it.
    """
    seen = log.where(F.col("ts") <= tm.instant(now))
    order = F.struct("ts", "check_id")
    ok = F.col("ok")
    base = seen.groupBy("source_id").agg(
        F.max("ts").alias("last_checked_at"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success_at"),
        F.max(F.when(ok, order)).alias("_good"),
    )
    after = seen.join(base.select("source_id", "_good"), "source_id").where(
        ~ok & (F.col("_good").isNull() | (order > F.col("_good")))
    ).groupBy("source_id").agg(F.count("*").alias("error_count"), F.max_by("error", order).alias("last_error"))
    return base.join(after, "source_id", "left").select(
        "source_id", "last_checked_at", "last_success_at",
        F.coalesce("error_count", F.lit(0)).cast("bigint").alias("error_count"),
        F.substring("last_error", 1, 300).alias("last_error"),
    )


def latest_validators(log: DataFrame) -> DataFrame:
    """Per source the latest value of each validator that a success carried.

    A response without a validator never wipes an older one.
    """
    order = F.struct("ts", "check_id")
    good = log.where("ok")
    return good.groupBy("source_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("etag", "last_modified", "body_hash")]
    )


def changed_only(docs: DataFrame) -> DataFrame:
    """Drop documents whose body equals the previous stored one of their source.

    Needs source_id, ts, check_id, status and body. Failed fetches store
    nothing; "not modified" rows carry no body.
    """
    stored = docs.where(F.col("status") == "ok").withColumn("body_hash", F.substring(F.sha2("body", 256), 1, 32))
    # Only hashes travel through the ordering; bodies are joined back by row.
    chain = previous(
        stored.select("source_id", "ts", "check_id", "body_hash"), ["source_id"], "ts", "check_id", {"_before": "body_hash"}
    )
    changed = chain.where(F.col("_before").isNull() | (F.col("_before") != F.col("body_hash"))).select("source_id", "check_id")
    return stored.join(changed, ["source_id", "check_id"], "left_semi").select(*docs.columns, "body_hash")


def error_streak(log: DataFrame) -> DataFrame:
    """Each check with the number of failures in a row it ends."""
    return failure_streaks(log, ["source_id"], "ts", "check_id", ~F.col("ok"))


def failing_since(calls: DataFrame, now, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Start of the failure streak that is open at ``now``; null when healthy."""
    seen = calls.where(F.col("ts") <= tm.instant(now))
    good = seen.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.struct("ts", "call_id"))).alias("_good"))
    later = F.col("_good").isNull() | (F.struct("ts", "call_id") > F.col("_good"))
    open_ = seen.join(good, list(keys)).groupBy(*keys).agg(
        F.min(F.when(~F.col("ok") & later, F.col("ts"))).alias("failing_since"),
        F.count_if(~F.col("ok") & later).alias("failures"),
    )
    return open_.withColumn("offline_ms", tm.ms_between(F.col("failing_since"), tm.instant(now)))


def backoff_ms(failures: Column) -> Column:
    """60 s doubling per failure in a row, at most 10 minutes; 0 for none."""
    doublings = F.least(failures - 1, F.lit(20))
    delay = F.least(F.lit(config.BACKOFF_BASE_MS) * F.pow(F.lit(2.0), doublings), F.lit(float(config.BACKOFF_MAX_MS)))
    return F.when(failures <= 0, F.lit(0)).otherwise(delay).cast("bigint")


def backoff_schedule(calls: DataFrame, interval_ms: int, now, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Each call with the streak it ends, when the next may follow, and whether
    that is due at ``now``."""
    runs = failure_streaks(calls, list(keys), "ts", "call_id", ~F.col("ok")).drop("streak_since")
    wait = F.when(F.col("ok"), F.lit(interval_ms)).otherwise(backoff_ms(F.col("streak")))
    next_at = F.timestamp_millis(F.unix_millis("ts") + wait)
    return runs.withColumn("next_at", next_at).withColumn("due", tm.instant(now) >= F.col("next_at"))


def due_sources(sources: DataFrame, state: DataFrame, now) -> DataFrame:
    """Enabled sources never checked, or last checked at least an interval ago."""
    joined = sources.where("enabled").join(state.select("source_id", "last_checked_at"), "source_id", "left")
    waited = tm.ms_between(F.col("last_checked_at"), tm.instant(now)) >= F.col("min_interval_seconds") * 1000
    return joined.where(F.col("last_checked_at").isNull() | waited)


def gap_detection(cycles: DataFrame, job: str = "job", ts: str = "ts", tie: str = "cycle_id") -> DataFrame:
    """Each cycle with the time since the one before, flagged above five minutes."""
    stepped = previous(cycles, [job], ts, tie, {"_previous": ts})
    gap = tm.ms_between(F.col("_previous"), F.col(ts))
    return stepped.withColumn("gap_ms", gap).withColumn(
        "gap_detected", F.coalesce(gap > config.GAP_SECONDS * 1000, F.lit(False))
    ).drop("_previous")


# ---------------------------------------------------------------- reports


def _silent_ms(now) -> Column:
    return tm.ms_between(F.col("last_success_at"), tm.instant(now))


def stale_sources(sources: DataFrame, state: DataFrame, now) -> DataFrame:
    """Known sources without a success for 15 minutes *and* three errors in a row."""
    quiet = F.coalesce(_silent_ms(now) >= config.STALE_SECONDS * 1000, F.lit(True))
    return (
        sources.where("enabled").join(state, "source_id")
        .where(quiet & (F.col("error_count") >= config.MIN_ERRORS_TO_WARN))
        .select("source_id", "last_success_at", "error_count", "last_error")
    )


def unhealthy_sources(sources: DataFrame, state: DataFrame, now) -> DataFrame:
    """Sources without a success in the last 15 minutes, errors or not."""
    joined = sources.where("enabled").join(state, "source_id", "left")
    quiet = F.coalesce(_silent_ms(now) > config.STALE_SECONDS * 1000, F.lit(True))
    return joined.where(quiet).select(
        "source_id", tm.ago(F.col("last_success_at"), tm.instant(now)).alias("last_ok")
    )


def source_status(sources: DataFrame, state: DataFrame, bootstrapped: DataFrame, now) -> DataFrame:
    """Status per source: not polled / ok / warn, with its detail text."""
    known = F.col("last_checked_at").isNotNull()
    joined = (
        sources.where("enabled").join(state, "source_id", "left")
        .join(bootstrapped.select("source_id", F.lit(True).alias("_boot")).distinct(), "source_id", "left")
    )
    fresh = F.coalesce(_silent_ms(now) < config.STALE_SECONDS * 1000, F.lit(False))
    last = tm.ago(F.col("last_success_at"), tm.instant(now))
    detail = (
        F.when(~known, "not yet polled")
        .when(F.col("error_count") > 0, F.concat(F.col("error_count").cast("string"), F.lit(" error(s), last ok "), last))
        .otherwise(F.concat(F.lit("ok "), last))
    )
    return joined.select(
        "source_id",
        F.when(~known, "not polled").when(fresh, "ok").otherwise("warn").alias("status"),
        F.coalesce("error_count", F.lit(0)).cast("bigint").alias("error_count"),
        (known & F.col("_boot").isNull()).alias("bootstrapping"),
        detail.alias("detail"),
        F.substring("last_error", 1, 90).alias("last_error"),
    )


def status_summary(
    cycles: DataFrame, deals: DataFrame, cands: DataFrame, sources: DataFrame, state: DataFrame, usage: DataFrame, now
) -> DataFrame:
    """One row: last cycle and stall flag, today's counters, queue, health.

    Each part is a one-row aggregate.
    """
    moment = tm.instant(now)
    c = F.col
    parts = [
        cycles.where(c("ts") <= moment).agg(F.max("ts").alias("last_cycle_at")),
        usage.where(c("day") == tm.day_key(moment)).agg(
            *[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(f"{x}_today") for x in ("cycles", "items_seen", "candidates")]
        ),
        deals.where((c("alert_state") == "sent") & (c("alerted_at") >= tm.shift(moment, -86_400))).agg(F.count("*").alias("alerts_24h")),
        cands.agg(F.count_if(c("status") == "pending").alias("pending")),
        sources.where("enabled").join(state, "source_id", "left").agg(
            F.count("*").alias("sources"),
            F.count_if(F.coalesce(_silent_ms(now) < config.STALE_SECONDS * 1000, F.lit(False))).alias("sources_healthy"),
        ),
    ]
    row = side_by_side(*parts)
    gap = tm.ms_between(c("last_cycle_at"), moment)
    return row.withColumn("last_cycle", tm.ago(c("last_cycle_at"), moment)).withColumn(
        "stalled", F.coalesce(gap > config.GAP_SECONDS * 1000, F.lit(False))
    )
