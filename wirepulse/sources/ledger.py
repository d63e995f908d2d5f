"""What was delivered: leases and results of every delivery, and deliveries that survive a crash.

The ledger is an append-only table of (deal_key, emit_ts, channel, kind, at) with kind "lease", "ack" or "fail". A delivery
is done once it is acknowledged. Until then it is due, except while a lease on it runs or its last
failures keep it waiting. Before rows are handed to a channel a lease is written, after that the result; if the
driver dies in between, the lease runs out and the delivery is due again under the same ``delivery_id``,
by which a channel recognises what it already has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse.functions import times as tm
from wirepulse.operators.health import backoff_ms
from wirepulse.sources.sinks import append_once, appended

LEDGER = "deal_key string, emit_ts timestamp, channel string, kind string, at timestamp"
DELIVERY = ["deal_key", "emit_ts", "channel"]
#: How long a lease keeps others from a delivery.
LEASE_MS = 300_000

Channel = Callable[[DataFrame], DataFrame | None]


def delivery_state(ledger: DataFrame) -> DataFrame:
    """Per delivery: acknowledged or not, failures, last failure, and the lease that no result has followed."""
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    return ledger.groupBy(*DELIVERY).agg(
        (at("ack").isNotNull()).alias("acked"), F.count_if(F.col("kind") == "fail").alias("failures"), at("fail").alias("failed_at"),
        at("lease").alias("leased_at"), F.max(F.when(F.col("kind") != "lease", F.col("at"))).alias("_result_at"),
    ).withColumn("leased_at", F.when(F.col("_result_at").isNull() | (F.col("leased_at") > F.col("_result_at")), F.col("leased_at"))).drop("_result_at")


def pending_deliveries(outbox: DataFrame, ledger: DataFrame, now, lease_ms: int = LEASE_MS) -> DataFrame:
    """Outbox rows that are due at ``now``, with ``failures`` and ``delivery_id``; repeated rows of a delivery count once."""
    moment = F.unix_millis(tm.instant(now))
    known = delivery_state(ledger)
    rows = outbox.dropDuplicates(DELIVERY).join(known, DELIVERY, "left")
    waits = F.unix_millis("failed_at") + backoff_ms(F.col("failures")) > moment
    leased = F.unix_millis("leased_at") + lease_ms > moment
    no = lambda c: ~F.coalesce(c, F.lit(False))
    due = rows.where(no(F.col("acked")) & no(waits) & no(leased))
    return due.select(
        *outbox.columns, F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"),
        F.sha2(F.concat_ws("|", "deal_key", F.unix_micros("emit_ts").cast("string"), "channel"), 256).alias("delivery_id"),
    )


def read_ledger(spark: SparkSession, path: str, channels: Iterable[str]) -> DataFrame:
    """The ledger of some channels at ``path``."""
    rows = appended(spark, f"{path}/leases", LEDGER).where(F.col("channel").isin(list(channels)))
    for name in channels:
        rows = rows.unionByName(appended(spark, f"{path}/results-{name}", LEDGER))
    return rows


def deliver_due(outbox: DataFrame, path: str, channels: dict[str, Channel], now, batch: int, lease_ms: int = LEASE_MS) -> None:
    """Hand every channel what is due; ``batch`` is a number that no earlier round had.

    A channel raises if it could deliver nothing; else it returns the ``delivery_id`` of what it failed on, or None. All
    leases of the round are written first, with the rows that are handed over, then each channel's results right after its turn; so
    what one channel has delivered stays delivered whatever happens to the others.
    """
    spark = outbox.sparkSession
    mine = outbox.where(F.col("channel").isin(list(channels)))
    due = pending_deliveries(mine, read_ledger(spark, path, channels), now, lease_ms)
    leases = due.withColumn("kind", F.lit("lease")).withColumn("at", tm.instant(now))
    append_once(leases, f"{path}/leases", batch)
    leased = spark.read.schema(leases.schema).parquet(f"{path}/leases/batch={batch}")
    for name, send in channels.items():
        rows = leased.where(F.col("channel") == name)
        try:
            failed = send(rows.drop("kind", "at"))
            result = rows.withColumn("kind", F.lit("ack"))
            if failed is not None:
                bad = failed.select("delivery_id").distinct().withColumn("_bad", F.lit(True))
                result = rows.join(bad, "delivery_id", "left").withColumn("kind", F.when(F.col("_bad"), "fail").otherwise("ack"))
        except Exception:  # noqa: BLE001 - user code; its rows come again
            result = rows.withColumn("kind", F.lit("fail"))
        append_once(result.select(*DELIVERY, "kind", "at"), f"{path}/results-{name}", batch)
