"""Writing results: append-only tables, upserts, the outbox, retention.

A growing table (seen keys, candidates, outbox) is a folder of ``batch=N``
parts. A batch only ever adds its own part and reads the parts before it, so a
repeated batch overwrites what it had started and nothing is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse.functions import times as tm
from wirepulse.operators.dedupe import insert_if_absent


def append_once(rows: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch under its own folder, so that repeating it overwrites it."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def appended(spark: SparkSession, path: str, schema: str, before: int | None = None, after: int | None = None) -> DataFrame:
    """All rows appended so far, or by batches before ``before`` and later than ``after`` (pruned by folder)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if after is not None:
        rows = rows.where(F.col("batch") > after)
    return rows.drop("batch")


def upsert(target: DataFrame, updates: DataFrame, key: str, order: list[str], replace: bool = False) -> DataFrame:
    """Insert rows of new keys; with ``replace`` the latest update wins instead."""
    if not replace:
        return insert_if_absent(target, updates, key, order)
    latest = updates.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in target.columns if c != key]), F.struct(*order)).alias("_row")
    ).select(key, "_row.*")
    kept = target.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.select(*target.columns))


def apply_retention(df: DataFrame, column: str, days: int, now) -> DataFrame:
    """Rows still inside their time to live; rows without a date never expire."""
    return df.where(F.col(column).isNull() | (F.col(column) > tm.shift(tm.instant(now), -days * 86_400)))


def drop_expired(df: DataFrame, column: str, now) -> DataFrame:
    """Rows whose own expiry time has not come."""
    return df.where(F.col(column).isNull() | (F.col(column) > tm.instant(now)))


def deliver(outbox: DataFrame, channels: dict[str, Callable[[DataFrame], None]]) -> None:
    """Hand each channel its rows. One failing channel never stops the others."""
    failures = []
    for name, send in channels.items():
        try:
            send(outbox.where(F.col("channel") == name))
        except Exception as error:  # noqa: BLE001 - user code
            failures.append(f"{name}: {error}")
    if failures and len(failures) == len(channels):
        raise RuntimeError("; ".join(failures))
