"""Reports: latency, usage, projections, funnel, probes and the daily digest.

All are aggregates with map-side partial results; the only single-task steps run
over tables of a fixed number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirepulse import config
from wirepulse.functions import text as tx, times as tm
from wirepulse.operators.deals import cooldown
from wirepulse.operators.ordered import nearest_rank, running
from wirepulse.session import written

COUNTERS = ("requests", "cycles", "wall_ms", "cpu_ms", "items_seen", "candidates", "alerts")


def sent_since(deals: DataFrame, since: Column) -> DataFrame:
    return deals.where((F.col("alert_state") == "sent") & (F.col("alerted_at") >= since))


def trailing(df: DataFrame, ts: str, days: int, now) -> DataFrame:
    """Rows of the last ``days`` days, inclusive."""
    return df.where(F.col(ts) >= tm.shift(tm.instant(now), -days * 86_400))


def latencies(deals: DataFrame, days: int, now) -> DataFrame:
    sent = trailing(deals.where(F.col("alert_state") == "sent"), "alerted_at", days, now)
    return sent.select(tm.ms_between(F.col("published_at"), F.col("alerted_at")).alias("ms")).where("ms >= 0")


def latency_stats(deals: DataFrame, days: int, now) -> DataFrame:
    """Published-to-alerted latency: count, nearest-rank p50 and p95, min, max."""
    stats = nearest_rank(latencies(deals, days, now), "ms", (50, 95))
    return stats.select(
        "count", F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms"),
        F.col("min").alias("min_ms"), F.col("max").alias("max_ms"),
    )


def latency_lines(stats: DataFrame) -> DataFrame:
    d = tm.format_duration
    return stats.select(
        F.when(F.col("count") == 0, "No alerts with a known publish time yet.").otherwise(
            F.concat_ws(
                "\n",
                F.concat(F.lit("Alerts measured: "), F.col("count").cast("string")),
                F.concat(F.lit("p50: "), d(F.col("p50_ms"))), F.concat(F.lit("p95: "), d(F.col("p95_ms"))),
                F.concat(F.lit("best: "), d(F.col("min_ms"))), F.concat(F.lit("worst: "), d(F.col("max_ms"))),
            )
        ).alias("report")
    )


def alerts_since(deals: DataFrame, since) -> DataFrame:
    return sent_since(deals, tm.instant(since)).agg(F.count("*").alias("alerts"))


# ---------------------------------------------------------------- usage


def daily_counters(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Zero-filled counters per UTC day from a log that carries any of them."""
    sums = [
        (F.sum(F.coalesce(c, F.lit(0))) if c in log.columns else F.lit(0)).cast("bigint").alias(c) for c in COUNTERS
    ]
    return log.groupBy(tm.day_key(F.col(ts)).alias("day")).agg(*sums)


def model_requests(calls: DataFrame, ts: str = "ts") -> DataFrame:
    """Requests per UTC day and model that counted against the quota."""
    counted = calls.where(consumes_quota(F.col("status")))
    return counted.groupBy(tm.day_key(F.col(ts)).alias("day"), F.replace("model", F.lit("."), F.lit("_")).alias("model")).agg(
        F.count("*").alias("requests")
    )


def consumes_quota(status: Column) -> Column:
    """Answered calls count, rejections too; overload and network failures do not."""
    return status.isNotNull() & ~status.isin(500, 502, 503, 504)


def daily_usage(cycles: DataFrame, calls: DataFrame) -> DataFrame:
    """Counters per day with a map of requests per model.

    The map is built from (day, model) totals, so it has one entry per model.
    """
    per_model = model_requests(calls)
    maps = per_model.groupBy("day").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "requests")))).alias("model_requests"),
        F.sum("requests").alias("_requests"),
    )
    days = daily_counters(cycles).join(maps, "day", "full")
    return days.select(
        "day",
        *[
            (F.coalesce(c, F.lit(0)) + (F.coalesce("_requests", F.lit(0)) if c == "requests" else F.lit(0)))
            .cast("bigint").alias(c)
            for c in COUNTERS
        ],
        F.coalesce("model_requests", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("model_requests"),
    )


def recent_usage(daily: DataFrame, days: int) -> DataFrame:
    return daily.orderBy(F.desc("day")).limit(days)


def quota_usage(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """Per day and model of ``limits`` (model, daily_limit): used and remaining."""
    used = model_requests(calls)
    shown = F.broadcast(limits.withColumn("_key", F.replace("model", F.lit("."), F.lit("_"))))  # one row per model
    return used.withColumnRenamed("model", "_key").join(shown, "_key").select(
        "day", "model", "requests", "daily_limit",
        F.greatest(F.col("daily_limit") - F.col("requests"), F.lit(0)).alias("remaining"),
    )


def model_choice(calls: DataFrame, primary: str, primary_limit: int, fallback: str | None, fallback_limit: int = 0) -> DataFrame:
    """Per day: the model the next call should use, null when none has quota left."""
    def used(model: str | None) -> Column:
        name = (model or "").replace(".", "_")
        return F.coalesce(F.sum(F.when(F.col("model") == name, F.col("requests"))), F.lit(0))

    totals = model_requests(calls).groupBy("day").agg(used(primary).alias("primary_used"), used(fallback).alias("fallback_used"))
    second = F.when((F.lit(fallback is not None)) & (F.col("fallback_used") < fallback_limit), F.lit(fallback))
    return totals.withColumn("model", F.when(F.col("primary_used") < primary_limit, F.lit(primary)).otherwise(second))


def quota_allocation(
    calls: DataFrame, primary_limit: int, fallback_limit: int | None, throttle_at: float = config.THROTTLE_AT, parity: str = "parity",
) -> DataFrame:
    """The model each call gets at its moment: ``grant`` is "primary", "fallback" or null, ``reason`` says why null.

    Calls (day, ts, call_id, counts, and the ``parity`` of their cycle) of a day are served in the sequence of (ts, call_id). A granted call uses quota
    if it ``counts``. The primary serves until its limit, from ``throttle_at`` of it on only in even cycles; then the fallback, if there
    is one; then nobody.

    A day is four stretches, and each ends where a running count of the day reaches a number: of all counting
    calls, or of those in even cycles while throttled. So the allocation takes running totals, which are carried across
    slices of a hot day, and one row per day and border; no call waits for the one before it.
    """
    even = F.coalesce(F.pmod(F.col(parity), F.lit(2)) == 0, F.lit(True))
    uses = F.coalesce(F.col("counts"), F.lit(False))
    rows = running(calls, F.col("day"), ["ts", "call_id"], {"_all": uses.cast("int"), "_even": (uses & even).cast("int")})
    throttled_from = min(primary_limit, math.ceil(primary_limit * throttle_at))
    start = rows.groupBy("day").agg(*[F.lit(0).cast("bigint").alias(c) for c in ("_r", "_a", "_e")])

    def border(after: DataFrame, count: str, base: str, number: int, filtered: Column) -> DataFrame:
        """Per day the row at which ``count`` has grown by ``number`` since the border before; none if it never does."""
        if number == 0:
            return after
        reached = rows.join(after, "day").where((F.col("rn") > F.col("_r")) & filtered & (F.col(count) == F.col(base) + number))
        return reached.select("day", F.col("rn").alias("_r"), F.col("_all").alias("_a"), F.col("_even").alias("_e"))

    first = border(start, "_all", "_a", throttled_from, uses)
    second = border(first, "_even", "_e", primary_limit - throttled_from, uses & even)
    third = border(second, "_all", "_a", fallback_limit or 0, uses)
    ends = {"_1": first, "_2": second, "_3": third}
    for name, rest in ends.items():
        rows = rows.join(rest.select("day", F.col("_r").alias(name)), "day", "left")
    upto = lambda c: F.col(c).isNull() | (F.col("rn") <= F.col(c))
    served = F.when(upto("_1"), "primary").when(upto("_2"), F.when(even, "primary")).when(upto("_3"), "fallback")
    why = F.when(upto("_1"), None).when(upto("_2"), F.when(~even, "throttled")).when(~upto("_3"), "exhausted")
    return rows.select(*calls.columns, served.alias("grant"), why.alias("reason"))


def project_usage(daily: DataFrame) -> DataFrame:
    """A month's cost at one cycle a minute, from each day's average cycle."""
    cycles = F.greatest("cycles", F.lit(1))
    wall, cpu = F.col("wall_ms") / cycles, F.col("cpu_ms") / cycles
    monthly = config.CYCLES_PER_MONTH
    cpu_hours = cpu * monthly / 1000 / 3600
    gb_hours = wall * monthly / 1000 / 3600 * config.MEMORY_GB
    percent = lambda used, limit: used / limit * 100
    return daily.select(
        "day", "cycles",
        F.floor(wall + 0.5).alias("avg_wall_ms"), F.floor(cpu + 0.5).alias("avg_cpu_ms"),
        cpu_hours.alias("cpu_hours"), gb_hours.alias("gb_hours"),
        F.lit(monthly).cast("bigint").alias("invocations"),
        percent(cpu_hours, config.CPU_HOURS_LIMIT).alias("cpu_percent"),
        percent(gb_hours, config.GB_HOURS_LIMIT).alias("memory_percent"),
        F.lit(monthly / config.INVOCATIONS_LIMIT * 100).alias("invocation_percent"),
    ).withColumn("warn", (F.col("cpu_percent") > config.WARN_PERCENT) | (F.col("memory_percent") > config.WARN_PERCENT))


# ---------------------------------------------------------------- cycles and sources


def cycle_report(fetches: DataFrame) -> DataFrame:
    """Per cycle: outcomes and item counts. Needs cycle, status, items_seen, items_new, added."""
    status = F.col("status")
    return fetches.groupBy("cycle").agg(
        F.count("*").alias("sources_due"),
        F.count_if(status == "ok").alias("sources_ok"),
        F.count_if(status == "not-modified").alias("sources_not_modified"),
        F.count_if(status == "error").alias("sources_failed"),
        F.sum("items_seen").cast("bigint").alias("items_seen"),
        F.sum("items_new").cast("bigint").alias("items_new"),
        F.sum("added").cast("bigint").alias("candidates_added"),
    )


def usage_warnings(usage: DataFrame, least_cycles: int = 30, window_ms: int = 86_400_000) -> DataFrame:
    """Readings ``(ts, id, cycles, warn)`` that send a warning.

    A reading counts from ``least_cycles`` on, and of those that say so at most one
    per window is sent; the window runs from the last one sent.
    """
    due = usage.where(F.col("warn") & (F.col("cycles") >= least_cycles)).withColumn("_key", F.lit("usage"))
    return cooldown(due, "_key", "ts", "id", F.lit(window_ms)).where("emitted").select(*usage.columns)


def source_probe(items: DataFrame, now) -> DataFrame:
    """Per source: items, bytes, newest publish time with its age, a sample title.

    All items count; undated ones and those dated ahead of ``now`` give no age.
    """
    moment = tm.instant(now)
    per_source = items.groupBy("source_id").agg(
        F.count("*").alias("items"),
        F.sum(F.octet_length("summary")).cast("bigint").alias("bytes"),
        F.max(F.when(F.col("published_at") <= moment, F.col("published_at"))).alias("newest_at"),
        F.substring(F.min_by("title", "position"), 1, 120).alias("sample_title"),
    )
    age = tm.ms_between(F.col("newest_at"), moment)
    return per_source.withColumn("newest_age", tm.age_text(age)).withColumn(
        "stale", F.coalesce(age > 7 * 86_400_000, F.lit(False))
    )


def fetches_by_host(docs: DataFrame, url: str) -> DataFrame:
    return docs.groupBy(tx.host_of(F.col(url)).alias("host")).agg(F.count("*").alias("n"))


def funnel(fetched: DataFrame, unique: DataFrame, filtered: DataFrame) -> DataFrame:
    """Rows per stage, and rejected rows per reason: (stage, reason, n, percent).

    ``filtered`` is ``unique`` with the prefilter outcome. Percentages are of the
    rows that entered the stage.
    """
    outcome = F.when(F.col("pass"), "passed").otherwise("rejected")
    none = F.lit(None).cast("string")
    counted = fetched.agg(F.count("*").alias("n")).select(F.lit("fetched").alias("stage"), none.alias("reason"), "n")
    kept = unique.agg(F.count("*").alias("n")).select(F.lit("unique").alias("stage"), none.alias("reason"), "n")
    split = (
        filtered.select(outcome.alias("stage"), F.when(~F.col("pass"), F.col("reason")).alias("reason"))
        .rollup("stage", "reason").agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
        # Stage totals, and reasons below the rejected stage.
        .where("_g = 1 or (_g = 0 and reason is not null)")
        .select("stage", "reason", "n")
    )
    rows = counted.unionByName(kept).unionByName(split)
    total = Window.partitionBy(F.lit(1))  # a handful of rows: one per stage and reason
    entered = F.when(F.col("stage").isin("fetched", "unique"), F.max(F.when(F.col("stage") == "fetched", F.col("n"))).over(total)).otherwise(
        F.max(F.when(F.col("stage") == "unique", F.col("n"))).over(total)
    )
    return rows.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / entered, 1))


# ---------------------------------------------------------------- digest


def _lines(df: DataFrame, section: str, ord_: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), ord_.cast("int").alias("ord"), line.alias("line"))


def daily_digest(
    deals: DataFrame, events: DataFrame, usage_today: DataFrame, projection: DataFrame,
    cands: DataFrame, sources: DataFrame, state: DataFrame, quota_today: DataFrame, now,
) -> DataFrame:
    """The daily summary as (section, ord, line) rows."""
    moment = tm.instant(now)
    c = F.col
    text = lambda name: c(name).cast("string")
    recent = sent_since(deals, tm.shift(moment, -86_400))
    count = recent.agg(F.count("*").alias("n"))
    icons = F.broadcast(events.select("event", "icon"))
    detail = F.concat_ws(" · ", F.nullif("round", F.lit("")), F.nullif(F.coalesce("amount", "deal_value"), F.lit("")))
    top = recent.orderBy(F.desc("alerted_at"), "deal_key").limit(10).join(icons, "event")
    top = top.withColumn("_ord", F.row_number().over(Window.orderBy(F.desc("alerted_at"), "deal_key")))  # ten rows
    headline = F.concat(
        c("icon"), F.lit(" <b>"), tx.escape_html(c("company")), F.lit("</b>"),
        F.when(detail != "", F.concat(F.lit(" — "), tx.escape_html(detail))).otherwise(""),
    )
    pending = cands.agg(F.count_if(c("status") == "pending").alias("pending"))
    stats = latency_stats(deals, 7, now)
    health = sources.where("enabled").join(state.select("source_id", "last_success_at"), "source_id", "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(tm.ms_between(c("last_success_at"), moment) <= config.STALE_SECONDS * 1000, F.lit(False))).alias("healthy"),
    )
    mark = lambda p: F.when(c(p) > config.WARN_PERCENT, "⚠️").otherwise("✅")
    whole = lambda p: tx.to_fixed(c(p), 0)
    sections = [
        _lines(count, "alerts", F.lit(0), F.concat(F.lit("<b>Alerts (24h): "), text("n"), F.lit("</b>"))),
        _lines(count.where("n = 0"), "alerts", F.lit(1), F.lit("<i>Nothing was alerted in the last 24 hours.</i>")),
        _lines(top, "alerts", c("_ord"), headline),
        _lines(count.where("n > 10"), "alerts", F.lit(11), F.concat(F.lit("<i>…and "), (c("n") - 10).cast("string"), F.lit(" more</i>"))),
        _lines(usage_today, "pipeline", F.lit(0), F.concat(F.lit("Cycles: "), text("cycles"), F.lit(" · items seen: "), text("items_seen"))),
        _lines(usage_today, "pipeline", F.lit(1), F.concat(F.lit("Candidates: "), text("candidates"))),
        _lines(pending, "pipeline", F.lit(2), F.concat(F.lit("Pending now: "), text("pending"))),
        _lines(
            stats, "latency", F.lit(0),
            F.when(c("count") == 0, "<i>No alert has a known publish time.</i>").otherwise(
                F.concat(
                    F.lit("p50 "), tm.format_duration(c("p50_ms")), F.lit(" · p95 "), tm.format_duration(c("p95_ms")),
                    F.lit(" ("), text("count"), F.lit(" alerts)"),
                )
            ),
        ),
        _lines(health, "sources", F.lit(0), F.concat(F.lit("<b>Sources: "), text("healthy"), F.lit("/"), text("total"), F.lit(" healthy</b>"))),
        _lines(quota_today, "models", c("ord"), F.concat(tx.escape_html(c("model")), F.lit(": "), text("requests"), F.lit("/"), text("daily_limit"))),
        _lines(projection, "budget", F.lit(0), F.concat(F.lit("avg cycle: "), text("avg_wall_ms"), F.lit("ms wall · "), text("avg_cpu_ms"), F.lit("ms cpu"))),
        _lines(
            projection, "budget", F.lit(1),
            F.concat(mark("cpu_percent"), F.lit(" CPU "), tx.to_fixed(c("cpu_hours"), 2), F.lit(f"h / {config.CPU_HOURS_LIMIT}h ("), whole("cpu_percent"), F.lit("%)")),
        ),
        _lines(
            projection, "budget", F.lit(2),
            F.concat(mark("memory_percent"), F.lit(" Memory "), whole("gb_hours"), F.lit(f" / {config.GB_HOURS_LIMIT} GB-h ("), whole("memory_percent"), F.lit("%)")),
        ),
    ]
    return reduce(DataFrame.unionByName, sections)


# ---------------------------------------------------------------- trailing percentiles


def day_histogram(rows: DataFrame, ts: str, value: str) -> DataFrame:
    """``(day, value, n)``: how often each value occurs on each UTC day. Histograms of any batches add up."""
    known = rows.where(F.col(value).isNotNull() & (F.col(value) >= 0) & F.col(ts).isNotNull())
    return known.groupBy(F.to_date(ts).alias("day"), F.col(value).cast("bigint").alias("value")).agg(F.count("*").alias("n"))


def trailing_percentiles(histogram: DataFrame, windows: Sequence[int] = (1, 7, 30), percents: Sequence[int] = (50, 90, 99)) -> DataFrame:
    """Nearest-rank percentiles of the last ``w`` days for every day with data: (day, days, n, p50, ...).

    From day histograms alone (``day_histogram``, parts of one day may come several times), no row is read again. A value at a rank is
    located 21 bits at a time, as in ``ordered.nearest_rank``, here for all days and windows at once: a day's counts go to the windows
    that hold it, and each round orders at most 2^21 counts per day, window and percentile. Between rounds the blocks looked for, a few
    rows per day of any size, are dealt to the days of their windows, so counts are met by day and block and never multiplied before.
    """
    whole = written(histogram.groupBy("day", "value").agg(F.sum("n").alias("n")))
    days = whole.select("day").distinct()
    spans = F.explode(F.array(*[F.struct(F.lit(w).alias("days"), F.lit(i).alias("ahead")) for w in windows for i in range(w)]))
    rank = F.greatest(F.ceil(F.col("p") * F.col("whole") / 100.0), F.lit(1)).cast("bigint")
    # Counts of days as counts of the windows that end on a day with data.
    moved = whole.groupBy("day", F.shiftright("value", 42).alias("block")).agg(F.sum("n").alias("n")).select("*", spans.alias("_s"))
    top = moved.select(F.date_add("day", F.col("_s.ahead")).alias("end"), F.col("_s.days").alias("days"), "block", "n").join(
        days.withColumnRenamed("day", "end"), "end", "left_semi"
    )
    blocks = written(top.groupBy("end", "days", "block").agg(F.sum("n").alias("n")))
    totals = written(blocks.groupBy("end", "days").agg(F.sum("n").alias("whole")))
    ranks = totals.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).select("end", "days", "p", rank.alias("rank"))
    wanted = _blocks_at(blocks.join(ranks, ["end", "days"]))
    ahead = F.explode(F.sequence(F.lit(0), F.col("days") - 1))
    for low in (21, 0):
        asked = written(wanted.select("*", ahead.alias("_a")).withColumn("day", F.expr("date_sub(end, _a)")).drop("_a"))
        finer = whole.groupBy("day", F.shiftright("value", low).alias("block")).agg(F.sum("n").alias("n")).withColumn("prefix", F.shiftright("block", 21))
        met = finer.join(asked, ["day", "prefix"]).groupBy("end", "days", "p", "rank", "block").agg(F.sum("n").alias("n"))
        wanted = _blocks_at(met)
    found = wanted.groupBy("end", "days").agg(*[F.max(F.when(F.col("p") == p, F.col("prefix"))).alias(f"p{p}") for p in percents])
    return found.join(totals, ["end", "days"]).select(F.col("end").alias("day"), "days", F.col("whole").alias("n"), *[f"p{p}" for p in percents])


def _blocks_at(blocks: DataFrame) -> DataFrame:
    """Per window and percentile the block its rank falls in, and the rank inside it; a table, so that the planner knows how few they are."""
    upto = Window.partitionBy("end", "days", "p").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = blocks.withColumn("_upto", F.sum("n").over(upto))
    before = F.col("_upto") - F.col("n")
    hit = (F.col("_upto") >= F.col("rank")) & (before < F.col("rank"))
    return written(ranked.where(hit).select("end", "days", "p", (F.col("rank") - before).alias("rank"), F.col("block").alias("prefix")))
