"""Time-ordered operators that never put one key's history into one task.

A plain window gives a key's whole history to a single task. These range-cut the
rows by (key, time, tie) into evenly sized slices, work inside (key, slice), and
carry a one-row summary per (key, slice) to the next slice. A key with a third
of all rows simply spans a third of the slices; only the summaries, at most one
per key and slice, are ever ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirepulse.session import checkpointed


def sliced_by(df: DataFrame, *order: str | Column) -> DataFrame:
    """Range-cut rows by ``order`` and add the slice number as ``_slice``.

    The order must identify rows, so that the cuts can fall anywhere. The rows
    are checkpointed because the cut points come from a sample and every branch
    that follows has to see the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *order).withColumn("_slice", F.spark_partition_id()))


def previous(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, columns: dict[str, str], keep_slice: bool = False
) -> DataFrame:
    """Add, for each ``columns`` entry (new name -> column), the previous row's value.

    Same answer as ``lag(column) over (partition by keys order by ts, tie)``.
    """
    sliced = sliced_by(df, *keys, ts, tie)
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    rows = sliced.withColumn("_first", F.row_number().over(inside) == 1)
    for name, column in columns.items():
        rows = rows.withColumn(name, F.lag(column).over(inside))

    last = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), F.struct(ts, tie))
    summaries = sliced.groupBy(*keys, "_slice").agg(last.alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    carried = summaries.select(*keys, "_slice", F.lag("_last").over(across).alias("_carry"))

    joined = rows.join(carried, [*keys, "_slice"])
    return joined.select(
        *df.columns,
        *[F.when(F.col("_first"), F.col("_carry")[n]).otherwise(F.col(n)).alias(n) for n in columns],
        *(["_slice"] if keep_slice else []),
    )


def failure_streaks(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, failed: Column
) -> DataFrame:
    """Add ``streak`` (failures in a row up to this row, 0 on success) and
    ``streak_since`` (time of the streak's first failure)."""
    sliced = sliced_by(df.withColumn("_bad", F.coalesce(failed, F.lit(False))), *keys, ts, tie)
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sliced.withColumn("_island", F.count_if(~F.col("_bad")).over(running))
    island = Window.partitionBy(*keys, "_slice", "_island").orderBy(ts, tie)
    island = island.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_n", F.count_if("_bad").over(island)).withColumn(
        "_since", F.min(F.when(F.col("_bad"), F.col(ts))).over(island)
    )

    # One row per slice: did anything succeed, and the failures it ends with.
    ending = F.max_by(F.struct("_island", "_n", "_since"), F.struct(ts, tie))
    summaries = rows.groupBy(*keys, "_slice").agg(ending.alias("_end")).select(
        *keys, "_slice",
        (F.col("_end._island") > 0).alias("_ok"), F.col("_end._n").alias("_tail"), F.col("_end._since").alias("_tail_since"),
    )
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = summaries.withColumn("_run", F.count_if("_ok").over(across))
    in_run = Window.partitionBy(*keys, "_run").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("_open", F.sum("_tail").over(in_run)).withColumn("_open_since", F.min("_tail_since").over(in_run))
    step = Window.partitionBy(*keys).orderBy("_slice")
    carried = runs.select(
        *keys, "_slice",
        F.coalesce(F.lag("_open").over(step), F.lit(0)).alias("_carry"),
        F.lag("_open_since").over(step).alias("_carry_since"),
    )

    joined = rows.join(carried, [*keys, "_slice"])
    continues = (F.col("_island") == 0) & (F.col("_carry") > 0)
    return joined.select(
        *df.columns,
        F.when(~F.col("_bad"), F.lit(0)).when(continues, F.col("_n") + F.col("_carry")).otherwise(F.col("_n"))
        .cast("bigint").alias("streak"),
        F.when(F.col("_bad"), F.when(continues, F.col("_carry_since")).otherwise(F.col("_since"))).alias("streak_since"),
    )


def sessions(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_ms: int) -> DataFrame:
    """Runs of rows no more than ``gap_ms`` apart: one row per run.

    Slices are first reduced to their own runs; runs are then joined across
    slice borders, so only run summaries are ordered per key.
    """
    sliced = previous(df.select(*keys, ts, tie), keys, ts, tie, {"_prev": ts}, keep_slice=True)
    opens = F.col("_prev").isNull() | (F.unix_millis(ts) - F.unix_millis("_prev") > gap_ms)
    return _runs(sliced, keys, ts, tie, opens, F.max(ts), F.count("*"))


def _stretch(ts: str, gap_us: int) -> Column:
    micros = F.unix_micros(ts)
    return (micros - F.pmod(micros, F.lit(gap_us))).alias("_stretch")


def session_pieces(df: DataFrame, keys: Sequence[str], ts: str, gap_us: int) -> DataFrame:
    """Rows of one key in one stretch of ``gap_us``, which are always one session's: ``first``, ``last``, ``n``.

    Rows without a time are in no session.
    """
    pieces = df.where(F.col(ts).isNotNull()).groupBy(*keys, _stretch(ts, gap_us))
    return pieces.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("_stretch")


def merged_sessions(pieces: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """As :func:`sessions`, from the :func:`session_pieces` of any number of batches, in any order."""
    whole = pieces.groupBy(F.struct(*keys).alias("_key"), _stretch("first", gap_us)).agg(  # a struct, so that null keys meet in joins
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
    )
    sliced = previous(whole, ["_key"], "first", "last", {"_prev": "last"}, keep_slice=True)
    opens = F.col("_prev").isNull() | (F.unix_micros("first") - F.unix_micros("_prev") > gap_us)
    return _runs(sliced, ["_key"], "first", "last", opens, F.max("last"), F.sum("n")).select("_key.*", "session", "started_at", "ended_at", "n")


def _runs(sliced: DataFrame, keys: Sequence[str], ts: str, tie: str, opens: Column, stop: Column, rows: Column) -> DataFrame:
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn("_run", F.count_if(opens).over(inside))
    parts = local.groupBy(*keys, "_slice", "_run").agg(
        F.min(ts).alias("_start"), stop.alias("_stop"), rows.alias("_rows")
    )
    # Run 0 of a slice continues whatever was open before it.
    counts = parts.groupBy(*keys, "_slice").agg(F.max("_run").alias("_opened"))
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_opened").over(across), F.lit(0)).alias("_base"))
    return (
        parts.join(offsets, [*keys, "_slice"])
        .groupBy(*keys, (F.col("_base") + F.col("_run")).alias("session"))
        .agg(F.min("_start").alias("started_at"), F.max("_stop").alias("ended_at"), F.sum("_rows").alias("n"))
    )


def numbered(df: DataFrame, *order: str | Column, name: str = "rn") -> DataFrame:
    """Add a global row number: rank inside the slice plus the slices before it."""
    placed = sliced_by(df, *order)
    sizes = placed.groupBy("_slice").count()
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(F.broadcast(offsets), "_slice")  # one row per shuffle partition
        .withColumn(name, (F.col("_base") + F.col("_local")).cast("bigint"))
        .drop("_slice", "_local", "_base")
    )


def numbered_within(df: DataFrame, key: Column, *order: str | Column, name: str = "rn") -> DataFrame:
    """Add the row number within ``key``: rank inside (key, slice) plus the key's rows in the slices before it."""
    placed = sliced_by(df.withColumn("_key", F.struct(key.alias("k"))), "_key", *order)  # a struct, so that null keys meet in the join
    sizes = placed.groupBy("_key", "_slice").count()
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_key", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_key", "_slice").orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(offsets, ["_key", "_slice"])
        .withColumn(name, (F.col("_base") + F.col("_local")).cast("bigint"))
        .drop("_key", "_slice", "_local", "_base")
    )


def nearest_rank(df: DataFrame, value: str, percents: Sequence[int]) -> DataFrame:
    """Nearest-rank percentiles of a non-negative BIGINT column, as one row.

    Columns: ``count``, ``min``, ``max`` and ``p<percent>``. The value at a rank
    is located 21 bits at a time: count values by their leading bits, pick the
    block the rank falls in, and look only inside that block. Each of the three
    rounds ranks at most 2^21 counts per percentile, whatever the number of rows.
    """
    base = df.select(F.col(value).alias("v")).where(F.col("v") >= 0)
    total = base.agg(F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"))

    # Leading bits first: every percentile looks at the same blocks.
    everything = Window.partitionBy(F.lit(1))
    blocks = base.groupBy(F.shiftright("v", 42).alias("block")).count()
    blocks = blocks.withColumn("n", F.sum("count").over(everything)).withColumn("p", F.explode(F.array(*map(F.lit, percents))))
    rank = F.greatest(F.ceil(F.col("p") * F.col("n") / 100.0), F.lit(1)).cast("bigint")
    wanted = _at_rank(blocks.withColumn("rank", rank))
    for low in (21, 0):
        # One row per percentile, so the broadcast is of a fixed size.
        blocks = (
            base.withColumn("prefix", F.shiftright("v", low + 21))
            .join(F.broadcast(wanted), "prefix")
            .groupBy("p", "rank", F.shiftright("v", low).alias("block"))
            .count()
        )
        wanted = _at_rank(blocks)
    picked = wanted.agg(*[F.max(F.when(F.col("p") == p, F.col("prefix"))).alias(f"p{p}") for p in percents])
    return side_by_side(total, picked)


def _at_rank(blocks: DataFrame) -> DataFrame:
    """Per percentile the block its rank falls in, and the rank inside it."""
    upto = Window.partitionBy("p").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = blocks.withColumn("upto", F.sum("count").over(upto))
    before = F.col("upto") - F.col("count")
    return ranked.where((F.col("upto") >= F.col("rank")) & (before < F.col("rank"))).select(
        "p", (F.col("rank") - before).alias("rank"), F.col("block").alias("prefix")
    )


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Several one-row tables as one row: stacked, then folded. No join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def running(df: DataFrame, key: Column, order: Sequence[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Add running totals within ``key``, the row's own value included, and its row number there as ``rn``.

    Checkpointed, as :func:`sliced_by` is, so that filters on the result read it again without another shuffle.
    """
    named = df.withColumn("_key", F.struct(key.alias("k"))).withColumns({f"_v_{n}": c.cast("bigint") for n, c in {**sums, "rn": F.lit(1)}.items()})
    placed = sliced_by(named, "_key", *order)
    names = [*sums, "rn"]
    inside = Window.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_key", "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    carried = totals.select("_key", "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    local = placed.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    joined = local.join(carried, ["_key", "_slice"])
    return checkpointed(joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in names]))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Add to each row of ``left`` the ``columns`` of the last row of ``right`` with its keys and a time up to its own.

    Both tables are range-cut together by (keys, time), right rows before left ones of the same time; inside a slice a left row takes the
    last right row before it, and what a slice ends with is carried on, one row per key and slice. So a hot key of
    either side spans many slices, and no pairs are made. Among right rows of one key and time that with the greatest
    ``tie`` (a column of ``right``) counts. Null keys match each other; rows without a time match nothing.
    """
    names = [f"_r_{c}" for c in columns]
    key = F.struct(*keys).alias("_key")
    known = right.where(F.col(ts).isNotNull()).select(
        key, F.col(ts).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("string").alias("_order"), F.col(tie).alias("_tie"),
        F.struct(*[F.col(c).alias(n) for c, n in zip(columns, names)]).alias("_right"),
    )
    asked = left.select(key, F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.xxhash64(F.struct(*left.columns)).cast("string").alias("_order"), F.struct(*left.columns).alias("_left"))
    order = ("_at", "_side", "_tie", "_order")
    sliced = sliced_by(known.unionByName(asked, allowMissingColumns=True), "_key", *order)
    inside = Window.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sliced.withColumn("_here", F.last("_right", ignorenulls=True).over(inside))
    ends = sliced.groupBy("_key", "_slice").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_end"))
    across = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_slice", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    found = rows.where("_side = 1").join(carried, ["_key", "_slice"]).withColumn("_match", F.coalesce("_here", "_carry"))
    found = found.withColumn("_match", F.when(F.col("_at").isNotNull(), F.col("_match")))
    return found.select("_left.*", *[F.col("_match")[n].alias(c) for c, n in zip(columns, names)])
