"""Cool-down on a stream: keyed state with event-time timers.

A key's rows count in the order of their times, not of their arrival: a row waits in state until the
watermark has passed it, so the emissions are those of the batch rule
(``operators.deals.cooldown``) over all rows that are not late. Rows behind the
watermark leave through the same sink in the same commit, marked ``late``.

A key's state is its last emission and the waiting rows that can still become one, packed into
parts by slices of time. Of rows that are less than a window apart only the earliest can, so where the
window is longer than the watermark's delay that is about one row a key. A batch's rows of a hot key pass
through its task a part at a time; what waits is not read again until the watermark reaches its
slice, and then slice by slice, so a task holds a part or the rows of one slice. Timers drop the last emission
once its window lies behind the watermark. No batch reads earlier output.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wirepulse.operators import deals as dl

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows of a key after which a task packs them into parts.
GATHERED = 1 << 18
#: Milliseconds of a slice.
SLICE_MS = 3_600_000
#: A packed row; ``untied`` marks a null tie.
ROW = np.dtype([("ms", "<i8"), ("tie", "<i8"), ("untied", "?")])


class CoolDown(StatefulProcessor):
    """Emits ``(key, ms, tie, untied, late)``; input rows have ``ms``, ``tie`` and ``untied``."""

    def __init__(self, window_ms: int):
        self.window = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")
        self.waiting = handle.getMapState("waiting", "slice long, part long", "packed binary")
        self.parts = handle.getValueState("parts", "n long")
        #: No waiting row is earlier.
        self.first = handle.getValueState("first", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, free = timerValues.getCurrentWatermarkInMs(), self._free()
        found, size = [], 0
        for frame in rows:
            given = np.empty(len(frame), ROW)
            for name in ROW.names:
                given[name] = frame[name]
            behind = (given["ms"] <= mark) & (mark > 0)
            if behind.any():
                yield _frame(key, given[behind], late=True)
            found.append(given[~behind])
            size += len(found[-1])
            if size >= GATHERED:
                self._add(_earliest(found), mark, free)
                found, size = [], 0
        if size:
            self._add(_earliest(found), mark, free)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, free = timerValues.getCurrentWatermarkInMs(), self._free()
        emitted, first = [], _value(self.first)
        if first is not None and first <= mark:
            self.first.clear()
            ahead = None
            for at, keys in groupby(sorted(tuple(k) for k in self.waiting.keys()), lambda k: k[0]):
                if at * SLICE_MS > mark:
                    ahead = at * SLICE_MS
                    break
                parts = []
                for k in keys:
                    if free is None or (at + 1) * SLICE_MS > free:
                        parts.append(np.frombuffer(self.waiting.getValue(k)[0], ROW))
                    self.waiting.removeKey(k)
                if not parts:
                    continue
                found = _earliest(parts)
                end = np.searchsorted(found["ms"], mark, "right")
                row = 0 if free is None else np.searchsorted(found["ms"], free)
                while row < end:
                    emitted.append(found[row : row + 1])
                    free = int(found["ms"][row]) + self.window
                    row = np.searchsorted(found["ms"], free)
                self._add(found[max(row, end) :], mark, free)
            if ahead is not None:
                self._expect(ahead)
        if emitted:
            yield _frame(key, np.concatenate(emitted), late=False)
            self.last.update((free - self.window,))
        if free is not None and mark >= free:
            self.last.clear()
        elif emitted:
            self.handle.registerTimer(free)

    def close(self) -> None:
        pass

    def _free(self) -> int | None:
        """The time from which rows are no longer suppressed by the last emission."""
        last = _value(self.last)
        return None if last is None else last + self.window

    def _add(self, rows: np.ndarray, mark: int, free: int | None) -> None:
        """Let rows wait, given in the order of their times, one for each."""
        if free is not None:
            rows = rows[rows["ms"] >= free]
        if not len(rows):
            return
        first, known = int(rows["ms"][0]), _value(self.first)
        least = self._least(first if known is None else min(first, known), mark, free)
        rows = rows[(rows["ms"] == first) | (rows["ms"] >= least)]
        number = _value(self.parts) or 0
        self.parts.update((number + 1,))
        for part in np.split(rows, np.flatnonzero(np.diff(rows["ms"] // SLICE_MS)) + 1):
            self.waiting.updateValue((int(part["ms"][0]) // SLICE_MS, number), (part.tobytes(),))
        self._expect(first)

    def _expect(self, ms: int) -> None:
        """A timer for the earliest time that a waiting row may have."""
        known = _value(self.first)
        if known is None or ms < known:
            self.first.update((ms,))
            self.handle.registerTimer(ms)

    def _least(self, first: int, mark: int, free: int | None) -> int:
        """The time before which rows, the earliest one apart, cannot be emitted whatever still comes.

        The next emission is the earliest row known, or one still to come before it: after the watermark and not
        before ``free``. What lies less than a window after that bound, the earliest row apart, is suppressed.
        """
        return self.window + max(min(first, mark + 1) if mark > 0 else first - self.window, first - self.window if free is None else free)

    def _needed(self, found: dict[int, int], mark: int, free: int | None) -> dict[int, int]:
        """Of times and ties, those of rows that can still be emitted."""
        first = min(found)
        least = self._least(first, mark, free)
        return {ms: tie for ms, tie in found.items() if ms == first or ms >= least}


def _value(state) -> int | None:
    return state.get()[0] if state.exists() else None


def _earliest(parts: list[np.ndarray]) -> np.ndarray:
    """One row for each time, with its least tie, in the order of times."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows["tie"], rows["untied"], rows["ms"]))]
    return rows[np.diff(rows["ms"], prepend=rows["ms"][:1] - 1) != 0]


def _frame(key: tuple, rows: np.ndarray, late: bool) -> pd.DataFrame:
    return pd.DataFrame({"key": key[0], **{name: rows[name] for name in ROW.names}, "late": late})


def emit_with_cooldown(
    stream: DataFrame, key: str, ts: str, tie: str, window_ms: int, out: str, checkpoint: str, delay: str = "1 hour", **trigger,
) -> StreamingQuery:
    """Write the rows of each key that are a window after the last one written.

    Rows may come up to ``delay`` after newer ones. ``out`` receives (key, ms, tie, late): emissions as the watermark
    passes them, and late rows. Rows without key or time are in no cool-down. ``all_emissions`` adds those still waiting.
    """
    spark = stream.sparkSession
    # Without the time column itself, late rows reach the processor instead of being dropped before it.
    rows = stream.withWatermark(ts, delay).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.unix_millis(ts).alias("ms"),
        F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"), F.col(tie).cast("long").isNull().alias("untied"),
    )
    cooled = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=CoolDown(window_ms), outputStructType="key string, ms long, tie long, untied boolean, late boolean",
        outputMode="Append", timeMode="EventTime",
    ).select("key", "ms", F.when(~F.col("untied"), F.col("tie")).alias("tie"), "late")
    writer = cooled.writeStream.format("parquet").outputMode("append").partitionBy("late").option("path", out).option("checkpointLocation", checkpoint)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def written(spark: SparkSession, out: str, late: bool) -> DataFrame:
    """(key, ms, tie) of the emissions, or of the late rows, written so far."""
    rows = spark.read.schema("key string, ms long, tie long, late boolean").parquet(out)
    return rows.where(F.col("late") == late).drop("late")


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for key, packed in zip(frame["key"], frame["packed"]):
            yield pd.DataFrame({"key": key, **{name: np.frombuffer(packed, ROW)[name] for name in ROW.names}})


def all_emissions(spark: SparkSession, out: str, checkpoint: str, window_ms: int) -> DataFrame:
    """(key, ms, tie) of what is written and of what the waiting rows would emit if nothing came any more."""

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    last = state("last").select(F.col("key.key").alias("key"), F.col("value.ms").alias("_last"))
    packed = state("waiting").select(F.col("key.key").alias("key"), F.col("user_map_value.packed").alias("packed"))
    waiting = packed.mapInPandas(_unpacked, "key string, ms long, tie long, untied boolean").select(
        "key", "ms", F.when(~F.col("untied"), F.col("tie")).alias("tie")
    ).join(last, "key", "left")
    due = waiting.where(F.col("_last").isNull() | (F.col("ms") - F.col("_last") >= window_ms)).withColumn("ts", F.timestamp_millis("ms"))
    rest = dl.cooldown(due.select("key", "ms", "tie", "ts"), "key", "ts", "tie", F.lit(window_ms)).where("emitted").select("key", "ms", "tie")
    return written(spark, out, late=False).unionByName(rest)
