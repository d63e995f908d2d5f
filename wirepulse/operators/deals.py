"""Deals: cool-down per company and event, source merging, alert rendering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirepulse import config
from wirepulse.functions import text as tx, times as tm
from wirepulse.operators.ordered import sliced_by
from wirepulse.session import discard, written



def cooldown(
    df: DataFrame, key: str, ts: str, tie: str, window_ms: Column
) -> DataFrame:
    """Add ``emitted`` and ``emit_ts`` (the last emission up to the row).

    In time order per key, a row is emitted iff nothing was emitted yet or at
    least ``window_ms`` passed since the last *emission*. ``window_ms`` must be
    the same for all rows of a key; ``tie`` decides between equal times.

    The recurrence only depends on the distinct times of a key, and emissions of
    a key are a window apart, so at most one falls into each window-wide bucket.
    """
    rows = df.withColumn("_ms", F.unix_millis(ts)).withColumn("_w", window_ms.cast("bigint"))
    moments = written(
        rows.groupBy(F.col(key).alias("k"), "_w", "_ms").agg(F.min(tie).alias("_tie"))
    )
    emitted = emissions(moments.select("k", F.col("_w").alias("w"), F.col("_ms").alias("t")))

    # A row's last emission lies in its own bucket or in the one before.
    bucket = F.floor(F.col("t") / F.col("w"))
    here = emitted.select("k", bucket.alias("b"), "t", F.lit(None).cast("bigint").alias("before"))
    there = emitted.select("k", (bucket + 1).alias("b"), F.lit(None).cast("bigint").alias("t"), F.col("t").alias("before"))
    lookup = here.unionByName(there).groupBy("k", "b").agg(F.max("t").alias("_here"), F.max("before").alias("_before"))
    first = emitted.join(
        moments.select("k", F.col("_ms").alias("t"), "_tie"), ["k", "t"]
    ).select("k", F.floor(F.col("t") / F.col("w")).alias("b"), F.col("_tie").alias("_emit_tie"))
    lookup = lookup.join(first, ["k", "b"], "left").withColumnsRenamed({"k": key, "b": "_b"})
    joined = rows.withColumn("_b", F.floor(F.col("_ms") / F.col("_w"))).join(lookup, [key, "_b"])
    emit_ms = F.when(F.col("_here") <= F.col("_ms"), F.col("_here")).otherwise(F.col("_before"))
    return joined.select(
        *df.columns,
        F.coalesce((F.col("_here") == F.col("_ms")) & (F.col(tie) == F.col("_emit_tie")), F.lit(False)).alias("emitted"),
        F.timestamp_millis(emit_ms).alias("emit_ts"),
    )


def emissions(moments: DataFrame) -> DataFrame:
    """Emission times per key, from distinct times: (k, w, t in ms).

    Every time points at the first time at least a window later. Emissions are
    what is reached from a key's first time, so marking them takes as many
    rounds as the emission count has bits. Each round joins on (key, time),
    which is unique, and only keys with enough windows in their span take part,
    so the work shrinks from round to round.
    """
    spans = moments.groupBy("k", "w").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    spans = written(spans.withColumn("steps", F.floor((F.col("hi") - F.col("lo")) / F.col("w"))))
    pointers = written(_next_emission(moments).join(spans.select("k", "steps"), "k"))
    marked = spans.select("k", "w", F.col("lo").alias("t"), "steps")
    most = spans.agg(F.max("steps")).first()[0] or 0
    reach = 1
    while reach <= most:
        # What is marked lies fewer than ``reach`` emissions from the first, so a jump by ``reach`` always marks new ones.
        jumped = marked.where(F.col("steps") >= reach).join(pointers.drop("steps"), ["k", "t"]).select("k", "w", F.col("nxt").alias("t"), "steps")
        marked = marked.unionByName(written(jumped))
        reach *= 2
        if reach > most:
            break
        open_keys = pointers.where(F.col("steps") >= reach)
        far = open_keys.select("k", F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        farther = written(open_keys.join(far, ["k", "nxt"]).select("k", "t", F.col("far").alias("nxt"), "steps"))
        discard(pointers)
        pointers = farther
    discard(pointers)
    return marked.select("k", "w", "t")


def _next_emission(moments: DataFrame) -> DataFrame:
    """(k, t, nxt): the first time of the key that is at least ``w`` after ``t``.

    Times and probes (``t + w``) are range-cut together, latest first, into even
    slices; inside a slice a probe takes the last time before it in that order, and
    what a slice ends with is carried to the next, one row per key and slice.
    """
    times = moments.select("k", (-F.col("t")).alias("x"), F.lit(0).alias("probe"), "t")
    probes = moments.select("k", (-F.col("t") - F.col("w")).alias("x"), F.lit(1).alias("probe"), "t")
    sliced = sliced_by(times.unionByName(probes), "k", "x", "probe")
    seen = F.when(F.col("probe") == 0, F.col("t"))
    inside = Window.partitionBy("k", "_slice").orderBy("x", "probe").rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced.withColumn("_here", F.last(seen, ignorenulls=True).over(inside))
    across = Window.partitionBy("k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sliced.groupBy("k", "_slice").agg(F.min(seen).alias("_least")).select(
        "k", "_slice", F.last("_least", ignorenulls=True).over(across).alias("_carry")
    )
    found = rows.where("probe = 1").join(carried, ["k", "_slice"])
    return found.select("k", "t", F.coalesce("_here", "_carry").alias("nxt")).where("nxt is not null")


def deal_cooldown(reports: DataFrame, events: DataFrame) -> DataFrame:
    """Cool-down of deal reports: needs deal_key, event, reported_at, report_id."""
    windows = events.select("event", (F.col("window_hours").cast("bigint") * 3_600_000).alias("_window"))
    timed = reports.join(F.broadcast(windows), "event")  # one row per event type
    return cooldown(timed, "deal_key", "reported_at", "report_id", F.col("_window")).drop("_window")


SOURCE = ["source_id", "title", "link", "published_at"]


def merge_sources(reports: DataFrame) -> DataFrame:
    """Distinct reporting sources per deal, one row each.

    Rows rather than an array per deal: a deal everybody reports stays spread
    over the cluster.
    """
    return reports.groupBy("deal_key", *SOURCE).agg(F.min("reported_at").alias("first_reported_at"))


def source_counts(reports: DataFrame) -> DataFrame:
    """Per deal: how many distinct sources reported it, and how many others."""
    return merge_sources(reports).groupBy("deal_key").agg(F.count("*").alias("n_sources")).withColumn(
        "also_reported_by", F.col("n_sources") - 1
    )


def emitted_deals(reported: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Alerts out of ``deal_cooldown`` rows, with the sources merged so far.

    ``n_sources`` counts the distinct sources of all reports of the deal up to
    and including the alert; ``prior`` holds sources recorded by earlier runs.
    First reports are counted per emission interval, then summed over a deal's
    emissions, which are a window apart. Rows without ``emit_ts`` precede them.
    """
    firsts = reported.groupBy("deal_key", *SOURCE).agg(
        F.min(F.struct("reported_at", "report_id", "emit_ts", "emitted")).alias("_f")
    )
    base = None
    if prior is not None:
        known = prior.select("deal_key", *SOURCE).distinct()
        old = known.select(*[F.col(c).alias(f"_{c}") for c in known.columns])
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in known.columns])
        firsts = firsts.join(old, same, "left_anti")
        base = known.groupBy("deal_key").agg(F.count("*").alias("_base"))
    firsts = firsts.select("deal_key", "_f.*")
    per_emit = firsts.where("emit_ts is not null").groupBy("deal_key", "emit_ts").agg(
        F.count("*").alias("_all"), F.count_if("emitted").alias("_opening")
    )
    early = firsts.where("emit_ts is null").groupBy("deal_key").agg(F.count("*").alias("_early"))
    before = Window.partitionBy("deal_key").orderBy("emit_ts").rowsBetween(Window.unboundedPreceding, -1)
    alerts = (
        reported.where("emitted").join(per_emit, ["deal_key", "emit_ts"], "left")
        .withColumn("_sum", F.sum("_all").over(before)).join(early, "deal_key", "left")
    )
    counts = ["_sum", "_opening", "_early"]
    if base is not None:
        alerts, counts = alerts.join(base, "deal_key", "left"), [*counts, "_base"]
    total = reduce(Column.__add__, [F.coalesce(c, F.lit(0)) for c in counts])
    return alerts.select(*reported.columns, total.cast("bigint").alias("n_sources"))


def cooldown_after(reports: DataFrame, events: DataFrame, history: DataFrame) -> DataFrame:
    """``deal_cooldown`` of new reports, given the alerts of earlier runs.

    ``history`` has (deal_key, emit_ts). Reports inside the window of the deal's
    last alert are suppressed; for the rest that alert no longer matters, so the
    rule starts afresh with them.
    """
    last = history.groupBy("deal_key").agg(F.max("emit_ts").alias("_last"))
    windows = events.select("event", (F.col("window_hours").cast("bigint") * 3_600_000).alias("_w"))
    joined = reports.join(last, "deal_key", "left").join(F.broadcast(windows), "event")  # one row per event type
    due = F.col("_last").isNull() | (F.unix_millis("reported_at") - F.unix_millis("_last") >= F.col("_w"))
    held = joined.where(~due).select(
        *reports.columns, F.lit(False).alias("emitted"), F.lit(None).cast("timestamp").alias("emit_ts")
    )
    return deal_cooldown(joined.where(due).select(*reports.columns), events).select(
        *reports.columns, "emitted", "emit_ts"
    ).unionByName(held)


def route_alerts(
    deals: DataFrame, public_enabled: bool, dm_enabled: bool = True, also_dm: bool = False
) -> DataFrame:
    """One row per (deal, channel).

    The public channel carries everything but unverified deals; direct messages
    stand in when there is no public channel, or run beside it on request.
    """
    channels = []
    if public_enabled:
        channels.append("public")
    if dm_enabled and (also_dm or not public_enabled):
        channels.append("dm")
    fan_out = F.explode(F.array(*[F.lit(c) for c in channels]).cast("array<string>"))
    routed = deals.withColumn("channel", fan_out)
    return routed.where((F.col("channel") != "public") | ~F.col("unverified"))


def render_alert(deals: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``alert_html``.

    Optional lines are null when they do not apply and ``concat_ws`` skips them.
    Needs event, region, company, round, amount, deal_value, lead_investors,
    other_investors, acquirer, target, summary, source_name, link, published_at,
    latency_ms, unverified and n_sources.
    """
    esc = tx.escape_html
    c = F.col

    def blank(column: Column) -> Column:
        return F.nullif(column, F.lit(""))

    leads = F.filter(F.coalesce("lead_investors", F.array().cast("array<string>")), lambda s: s != "")
    others = F.filter(F.coalesce("other_investors", F.array().cast("array<string>")), lambda s: s != "")
    details = F.concat_ws(" · ", esc(blank(c("round"))), esc(blank(F.coalesce("amount", "deal_value"))))
    both = blank(c("acquirer")).isNotNull() & blank(c("target")).isNotNull()
    buyer = F.concat_ws(
        " · ", F.concat(esc(c("acquirer")), F.lit(" → "), esc(c("target"))), esc(blank(c("deal_value")))
    )
    parties = F.when(c("event") == "acquisition", F.when(both, buyer)).otherwise(
        F.when(
            F.size(leads) > 0,
            F.concat(
                F.lit("Led by: "), esc(F.array_join(leads, ", ")),
                F.when(F.size(others) > 0, F.concat(F.lit(" (+"), F.size(others).cast("string"), F.lit(" more)"))).otherwise(""),
            ),
        ).when(F.size(others) > 0, F.concat(F.lit("Investors: "), esc(F.array_join(F.slice(others, 1, 3), ", "))))
    )
    meta = F.concat_ws(
        " · ",
        esc(c("source_name")),
        F.concat(F.lit("published "), tm.format_et_time(c("published_at")), F.lit(" ET")),
        F.concat(F.lit("detected in "), tm.format_duration(c("latency_ms"))),
    )
    lines = F.concat_ws(
        "\n",
        F.when(c("unverified"), "⚠️ <b>UNVERIFIED</b> (AI offline — keyword match only)"),
        F.concat(c("_icon"), F.lit(" <b>"), c("_label"), F.lit("</b> · "), tx.region_flag(c("region"))),
        F.concat(
            F.lit("<b>"), esc(c("company")), F.lit("</b>"),
            F.when(details != "", F.concat(F.lit(" — "), details)).otherwise(""),
        ),
        parties,
        esc(blank(c("summary"))),
        F.concat(F.lit("<i>"), meta, F.lit("</i>")),
        F.concat(F.lit('<a href="'), esc(c("link")), F.lit('">Read source →</a>')),
        F.when(
            c("n_sources") > 1,
            F.concat(F.lit("<i>also reported by "), (c("n_sources") - 1).cast("string"), F.lit(" other source(s)</i>")),
        ),
    )
    shown = events.select("event", F.col("icon").alias("_icon"), F.col("label").alias("_label"))
    return deals.join(F.broadcast(shown), "event").select(*deals.columns, lines.alias("alert_html"))


def search_deals(
    deals: DataFrame, now, event: str | None = None, region: str | None = None,
    days: int | str | None = None, q: str | None = None,
) -> DataFrame:
    """Sent deals of the last ``days``; values outside the allow-lists mean "all"."""
    try:
        span = int(days) if days is not None else 30
    except ValueError:
        span = 30
    span = span if span in config.SEARCH_DAYS else 30
    needle = (q or "").strip()[:80]
    found = deals.where((F.col("alert_state") == "sent") & (F.col("alerted_at") >= tm.shift(tm.instant(now), -span * 86_400)))
    if event in {e.id for e in config.EVENTS}:
        found = found.where(F.col("event") == event)
    if region in config.SEARCH_REGIONS:
        found = found.where(F.col("region") == region)
    if needle:
        found = found.where(F.contains(F.lower("company"), F.lit(needle.lower())))
    return found


def recent_deals(deals: DataFrame, k: int, tie: str = "deal_key") -> DataFrame:
    """The ``k`` most recently sent deals, newest first (a top-k, not a full sort)."""
    return deals.where(F.col("alert_state") == "sent").orderBy(F.desc("alerted_at"), tie).limit(k)


def last_alert_state(alerts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Latest emission per deal: the stored deal record."""
    return alerts.groupBy("deal_key").agg(F.max_by(F.struct(*columns), F.struct("emit_ts")).alias("_d")).select("deal_key", "_d.*")
