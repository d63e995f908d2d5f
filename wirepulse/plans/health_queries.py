"""Queries over check, call and cycle logs: streaks, state, usage, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirepulse.functions import times as tm
from wirepulse.operators import deals as dl, gate, health, ordered, reports
from wirepulse.plans import inputs as I, oracle_views as V
from wirepulse.plans.inputs import ntz
from wirepulse.plans.registered import query

T = f"TIMESTAMP '{I.NOW_EVENTS}'"

# ---------------------------------------------------------------- source state


@query(V.query(V.FETCH_LOG, V.STATE, select="SELECT source_id, last_checked_at, last_success_at, error_count, last_error FROM state"))
def source_state_asof(spark, d):
    return ntz(health.state_asof(I.fetch_log(spark, d), I.NOW_EVENTS))


@query(V.query(V.FETCH_LOG, V.STATE, V.REGISTRY, select=f"""
SELECT source_id FROM registry LEFT JOIN state USING (source_id)
WHERE enabled AND (last_checked_at IS NULL OR {V.ms_between('last_checked_at', T)} >= min_interval_seconds * 1000)"""))
def due_sources(spark, d):
    state = health.state_asof(I.fetch_log(spark, d), I.NOW_EVENTS)
    return health.due_sources(I.registry(spark, d), state, I.NOW_EVENTS).select("source_id")


_ISLANDS = """SELECT *, count_if(NOT ok) OVER (PARTITION BY {key}, island ORDER BY ts, {tie}) AS streak
FROM (SELECT *, count_if(ok) OVER (PARTITION BY {key} ORDER BY ts, {tie}) AS island FROM {log})"""


@query(V.query(V.FETCH_LOG, f"runs AS ({_ISLANDS.format(key='source_id', tie='check_id', log='fetch_log')})", select="""
SELECT check_id, source_id, CAST(CASE WHEN ok THEN 0 ELSE streak END AS BIGINT) AS streak,
  CASE WHEN NOT ok THEN min(ts) FILTER (NOT ok) OVER (PARTITION BY source_id, island) END AS streak_since FROM runs"""))
def error_streak(spark, d):
    return ntz(health.error_streak(I.fetch_log(spark, d)).select("check_id", "source_id", "streak", "streak_since"))


@query(V.query(V.CALLS, select=f"""
SELECT c.model, min(c.ts) FILTER (NOT ok AND (g IS NULL OR c.ts > g)) AS failing_since,
  CAST(count_if(NOT ok AND (g IS NULL OR c.ts > g)) AS BIGINT) AS failures,
  {V.ms_between("min(c.ts) FILTER (NOT ok AND (g IS NULL OR c.ts > g))", T)} AS offline_ms
FROM calls c JOIN (SELECT model, max(ts) FILTER (ok) AS g FROM calls WHERE ts <= {T} GROUP BY model) s USING (model) WHERE c.ts <= {T} GROUP BY c.model"""))
def failing_since(spark, d):
    return ntz(health.failing_since(I.calls(spark, d), I.NOW_EVENTS))


@query(V.query(V.CALLS, f"runs AS ({_ISLANDS.format(key='model', tie='call_id', log='calls')})", select=f"""
SELECT call_id, CAST(streak AS BIGINT) AS streak, make_timestamp(1000 * (epoch_us(ts) // 1000 + wait)) AS next_at, {T} >= make_timestamp(1000 * (epoch_us(ts) // 1000 + wait)) AS due
FROM (SELECT call_id, ts, CASE WHEN ok THEN 0 ELSE streak END AS streak,
        CASE WHEN ok THEN 180000 ELSE CAST(least(60000 * power(2, streak - 1), 600000) AS BIGINT) END AS wait FROM runs)"""))
def backoff_schedule(spark, d):
    rows = health.backoff_schedule(I.calls(spark, d), 180_000, I.NOW_EVENTS)
    return ntz(rows.select("call_id", "streak", "next_at", "due"))


@query(V.query(V.FETCH_LOG, select="""
SELECT source_id, arg_max(etag, ts) FILTER (etag IS NOT NULL) AS etag, arg_max(last_modified, ts) FILTER (last_modified IS NOT NULL) AS last_modified,
  arg_max(body, ts) FILTER (body IS NOT NULL) AS body_hash FROM fetch_log WHERE ok GROUP BY source_id"""))
def validators_latest(spark, d):
    return health.latest_validators(I.fetch_log(spark, d))


@query(V.query(V.FETCH_LOG, select="""
SELECT check_id, source_id, substr(sha256(body), 1, 32) AS body_hash FROM (
  SELECT *, lag(body) OVER (PARTITION BY source_id ORDER BY ts, check_id) AS before FROM fetch_log WHERE status = 'ok')
WHERE before IS NULL OR before <> body"""))
def unchanged_skip(spark, d):
    docs = I.fetch_log(spark, d).drop("body_hash")
    return health.changed_only(docs).select("check_id", "source_id", "body_hash")


@query(V.query(V.CYCLES, select="""
SELECT cycle_id, job, gap_ms, COALESCE(gap_ms > 300000, FALSE) AS gap_detected FROM (
  SELECT *, epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY job ORDER BY ts, cycle_id)) // 1000 AS gap_ms FROM cycles)"""))
def gap_detection(spark, d):
    return health.gap_detection(I.cycles(spark, d)).select("cycle_id", "job", "gap_ms", "gap_detected")


@query(V.query(V.CYCLES, select="""
SELECT job, count(*) AS n, min(ts) AS started_at, max(ts) AS ended_at FROM (
  SELECT *, count_if(opens) OVER (PARTITION BY job ORDER BY ts, cycle_id) AS s FROM (
    SELECT *, COALESCE(epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY job ORDER BY ts, cycle_id)) // 1000 > 300000, TRUE) AS opens FROM cycles))
GROUP BY job, s"""))
def gap_sessions(spark, d):
    rows = ordered.sessions(I.cycles(spark, d), ["job"], "ts", "cycle_id", 300_000)
    return ntz(rows.select("job", "n", "started_at", "ended_at"))


_WARN = """spans AS (SELECT job AS k, cycle_id AS id, epoch_us(ts) // 1000 AS t FROM cycles),
chain(k, t) AS (SELECT k, min(t) FROM spans GROUP BY k UNION ALL
  SELECT c.k, (SELECT min(s.t) FROM spans s WHERE s.k = c.k AND s.t >= c.t + 3600000) FROM chain c WHERE c.t IS NOT NULL)"""


@query(V.query(V.CYCLES, _WARN, select="""
SELECT k AS job, t AS ms, min(id) AS cycle_id FROM spans JOIN chain USING (k, t) GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1))
def warning_rate_limit(spark, d):
    rows = dl.cooldown(I.cycles(spark, d), "job", "ts", "cycle_id", F.lit(3_600_000))
    return rows.where("emitted").select("job", F.unix_millis("ts").alias("ms"), "cycle_id")


# ---------------------------------------------------------------- health reports

_S = (V.FETCH_LOG, V.STATE, V.REGISTRY)
_QUIET = V.ms_between("last_success_at", T)


def _state(spark, d):
    return health.state_asof(I.fetch_log(spark, d), I.NOW_EVENTS)


_FLAKY = V.FETCH_LOG.replace("event_type <> 'error' AS ok", "event_type = 'click' AS ok").replace(
    "WHEN event_type = 'error' THEN 'HTTP '", "WHEN event_type <> 'click' THEN 'HTTP '"
)


@query(V.query(_FLAKY, V.STATE, V.REGISTRY, select=f"""
SELECT source_id, last_success_at, error_count, last_error FROM registry JOIN state USING (source_id)
WHERE enabled AND (last_success_at IS NULL OR {_QUIET} >= 900000) AND error_count >= 3"""))
def stale_sources(spark, d):
    state = health.state_asof(I.fetch_log(spark, d, healthy="event_type = 'click'"), I.NOW_EVENTS)
    return ntz(health.stale_sources(I.registry(spark, d), state, I.NOW_EVENTS))


@query(V.query(*_S, select=f"""
SELECT source_id, {V.ago('last_success_at', T)} AS last_ok FROM registry LEFT JOIN state USING (source_id)
WHERE enabled AND COALESCE({_QUIET} > 900000, TRUE)"""))
def unhealthy_sources(spark, d):
    return health.unhealthy_sources(I.registry(spark, d), _state(spark, d), I.NOW_EVENTS)


@query(V.query(*_S, select=f"""
SELECT source_id, CASE WHEN last_checked_at IS NULL THEN 'not polled' WHEN {_QUIET} < 900000 THEN 'ok' ELSE 'warn' END AS status,
  COALESCE(error_count, 0) AS error_count, last_checked_at IS NOT NULL AND last_success_at IS NULL AS bootstrapping,
  CASE WHEN last_checked_at IS NULL THEN 'not yet polled' WHEN error_count > 0 THEN error_count || ' error(s), last ok ' || ({V.ago('last_success_at', T)})
       ELSE 'ok ' || ({V.ago('last_success_at', T)}) END AS detail, last_error
FROM registry LEFT JOIN state USING (source_id) WHERE enabled"""))
def source_status(spark, d):
    state = _state(spark, d)
    booted = state.where("last_success_at is not null")
    return health.source_status(I.registry(spark, d), state, booted, I.NOW_EVENTS)


_DAILY = """SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(cycles) AS BIGINT) AS cycles, CAST(sum(wall_ms) AS BIGINT) AS wall_ms, CAST(sum(cpu_ms) AS BIGINT) AS cpu_ms,
  CAST(sum(items_seen) AS BIGINT) AS items_seen, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(alerts) AS BIGINT) AS alerts FROM cycles GROUP BY 1"""
_DAYS = f"days AS ({_DAILY})"
_MODELS = """models AS (SELECT strftime(ts, '%Y-%m-%d') AS day, replace(model, '.', '_') AS model, count(*) AS requests
  FROM calls WHERE status IS NOT NULL AND status NOT IN (500, 502, 503, 504) GROUP BY ALL)"""


@query(V.query(*_S, V.HEADLINES, V.VERDICTS, V.REPORTS, V.DEALS, V.CANDIDATES, V.CYCLES, _DAYS, select=f"""
SELECT (SELECT max(ts) FROM cycles WHERE ts <= {T}) AS last_cycle_at,
  (SELECT {V.ago('max(ts)', T)} FROM cycles WHERE ts <= {T}) AS last_cycle,
  (SELECT {V.ms_between('max(ts)', T)} > 300000 FROM cycles WHERE ts <= {T}) AS stalled,
  COALESCE((SELECT cycles FROM days WHERE day = '{I.NOW_EVENTS[:10]}'), 0) AS cycles_today,
  COALESCE((SELECT items_seen FROM days WHERE day = '{I.NOW_EVENTS[:10]}'), 0) AS items_seen_today,
  COALESCE((SELECT candidates FROM days WHERE day = '{I.NOW_EVENTS[:10]}'), 0) AS candidates_today,
  (SELECT count(*) FROM deals WHERE alert_state = 'sent' AND alerted_at >= {T} - INTERVAL 1 DAY) AS alerts_24h,
  (SELECT count(*) FROM candidates WHERE status = 'pending') AS pending,
  (SELECT count(*) FROM registry WHERE enabled) AS sources,
  (SELECT count(*) FROM registry JOIN state USING (source_id) WHERE enabled AND {_QUIET} < 900000) AS sources_healthy"""))
def status_summary(spark, d):
    usage = reports.daily_counters(I.cycles(spark, d))
    row = health.status_summary(
        I.cycles(spark, d), I.deals(spark, d), I.candidates(spark, d), I.registry(spark, d), _state(spark, d), usage, I.NOW_EVENTS
    )
    return ntz(row)


# ---------------------------------------------------------------- usage


@query(V.query(V.CYCLES, V.CALLS, _DAYS, _MODELS, select="""
SELECT day, COALESCE(cycles, 0) AS cycles, COALESCE(wall_ms, 0) AS wall_ms, COALESCE(cpu_ms, 0) AS cpu_ms, COALESCE(items_seen, 0) AS items_seen,
  COALESCE(candidates, 0) AS candidates, COALESCE(alerts, 0) AS alerts, COALESCE(requests, 0) AS requests, COALESCE(m, '') AS model_requests
FROM days FULL JOIN (SELECT day, CAST(sum(requests) AS BIGINT) AS requests, string_agg(model || '=' || requests, ',' ORDER BY model) AS m FROM models GROUP BY day) USING (day)"""))
def daily_usage(spark, d):
    daily = reports.daily_usage(I.cycles(spark, d), I.calls(spark, d))
    pairs = F.transform(F.map_entries("model_requests"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return daily.withColumn("model_requests", F.array_join(pairs, ","))


@query(V.query(V.CYCLES, _DAYS, select="SELECT day, cycles, items_seen FROM days ORDER BY day DESC LIMIT 7"))
def recent_usage(spark, d):
    return reports.recent_usage(reports.daily_counters(I.cycles(spark, d)), 7).select("day", "cycles", "items_seen")


_PROJECT = """projected AS (SELECT day, cycles, wall_ms / CAST(greatest(cycles, 1) AS DOUBLE) AS w, cpu_ms / CAST(greatest(cycles, 1) AS DOUBLE) AS c FROM days)"""


@query(V.query(V.CYCLES, _DAYS, _PROJECT, select="""
SELECT day, cycles, CAST(floor(w + 0.5) AS BIGINT) AS avg_wall_ms, CAST(floor(c + 0.5) AS BIGINT) AS avg_cpu_ms,
  c * 43200 / 1000 / 3600 AS cpu_hours, w * 43200 / 1000 / 3600 * 2 AS gb_hours, CAST(43200 AS BIGINT) AS invocations,
  c * 43200 / 1000 / 3600 / 4 * 100 AS cpu_percent, w * 43200 / 1000 / 3600 * 2 / 360 * 100 AS memory_percent, CAST(4.32 AS DOUBLE) AS invocation_percent,
  c * 43200 / 1000 / 3600 / 4 * 100 > 70 OR w * 43200 / 1000 / 3600 * 2 / 360 * 100 > 70 AS warn FROM projected"""))
def usage_projection(spark, d):
    return reports.project_usage(reports.daily_counters(I.cycles(spark, d)))


@query(V.query(V.CALLS, _MODELS, select="""
SELECT day, l.model, requests, CAST(daily_limit AS BIGINT) AS daily_limit, greatest(daily_limit - requests, 0) AS remaining
FROM models m JOIN (VALUES ('model-0.5', 4), ('model-1.5', 900)) AS l(model, daily_limit) ON replace(l.model, '.', '_') = m.model"""))
def quota_usage(spark, d):
    limits = spark.createDataFrame([("model-0.5", 4), ("model-1.5", 900)], "model string, daily_limit bigint")
    return reports.quota_usage(I.calls(spark, d), limits)


@query(V.query(V.CALLS, _MODELS, select="""
SELECT day, primary_used, fallback_used, CASE WHEN primary_used < 140 THEN 'model-0.5' WHEN fallback_used < 150 THEN 'model-1.5' END AS model FROM (
  SELECT day, CAST(COALESCE(sum(requests) FILTER (model = 'model-0_5'), 0) AS BIGINT) AS primary_used, CAST(COALESCE(sum(requests) FILTER (model = 'model-1_5'), 0) AS BIGINT) AS fallback_used
  FROM models GROUP BY day)"""))
def model_choice(spark, d):
    return reports.model_choice(I.calls(spark, d), "model-0.5", 140, "model-1.5", 150)


# ---------------------------------------------------------------- cycles and probes


@query(V.query(V.FETCH_LOG, select="""
SELECT strftime(ts, '%Y-%m-%d %H') AS cycle, count(*) AS sources_due, CAST(count_if(status = 'ok') AS BIGINT) AS sources_ok, CAST(count_if(status = 'not-modified') AS BIGINT) AS sources_not_modified,
  CAST(count_if(status = 'error') AS BIGINT) AS sources_failed, CAST(sum(check_id % 12) AS BIGINT) AS items_seen, CAST(sum(check_id % 5) AS BIGINT) AS items_new,
  CAST(sum(check_id % 3) AS BIGINT) AS candidates_added FROM fetch_log GROUP BY 1"""))
def cycle_report(spark, d):
    fetches = I.fetch_log(spark, d).selectExpr(
        "date_format(ts, 'yyyy-MM-dd HH') as cycle", "status", "check_id % 12 as items_seen", "check_id % 5 as items_new", "check_id % 3 as added"
    )
    return reports.cycle_report(fetches)


@query(V.query(V.CYCLES, select="""
, due AS (SELECT ts, min(cycle_id) AS id FROM (
    SELECT ts, cycle_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, cycle_id) AS n FROM cycles)
  WHERE n >= 30 AND cycle_id % 2 = 0 GROUP BY ts),
sent AS (SELECT min(ts) AS ts FROM due
  UNION ALL SELECT (SELECT min(d.ts) FROM due d WHERE d.ts >= s.ts + INTERVAL 1 DAY) FROM sent s WHERE s.ts IS NOT NULL)
SELECT id FROM due JOIN sent USING (ts)""").replace("WITH ", "WITH RECURSIVE ", 1).replace("\n\n, due", ", due"))
def usage_warning(spark, d):
    """Cycles of a day so far, half of them over the limit: at most one warning in 24 hours."""
    counted = ordered.numbered_within(I.cycles(spark, d).select("ts", "cycle_id"), F.to_date("ts"), "ts", "cycle_id", name="cycles")
    usage = counted.select("ts", F.col("cycle_id").alias("id"), "cycles", (F.col("cycle_id") % 2 == 0).alias("warn"))
    return reports.usage_warnings(usage).select("id")


_AGE = V.ms_between("newest_at", f"TIMESTAMP '{I.NOW_ITEMS}'")


@query(V.query(V.HEADLINES, select=f"""
SELECT source_id, items, bytes, newest_at, sample_title, CASE WHEN m < 60 THEN CAST(m AS BIGINT) || 'm' WHEN m < 1440 THEN {V.to_fixed('(m / 60.0)', 1)} || 'h' ELSE {V.to_fixed('(m / 1440.0)', 1)} || 'd' END AS newest_age,
  COALESCE(age > 604800000, FALSE) AS stale FROM (SELECT *, {_AGE} AS age, floor({_AGE} / 60000.0 + 0.5) AS m FROM (
    SELECT source_id, count(*) AS items, CAST(sum(strlen(summary)) AS BIGINT) AS bytes, max(published_at) FILTER (WHERE published_at <= TIMESTAMP '{I.NOW_ITEMS}') AS newest_at, substr(arg_min(title, k), 1, 120) AS sample_title
    FROM headlines GROUP BY source_id))"""))
def source_probe(spark, d):
    items = I.headlines(spark, d).withColumn("position", F.col("k"))
    return ntz(reports.source_probe(items, I.NOW_ITEMS))


_N = f"TIMESTAMP '{I.NOW_ITEMS}'"
_MARK = "CASE WHEN {0} > 70 THEN '⚠️' ELSE '✅' END"


@query(V.query(*_S, V.HEADLINES, V.VERDICTS, V.REPORTS, V.DEALS, V.CANDIDATES, V.CYCLES, V.CALLS, _DAYS, _MODELS, f"""
recent AS (SELECT * FROM deals WHERE alert_state = 'sent' AND alerted_at >= {_N} - INTERVAL 1 DAY),
top AS (SELECT *, row_number() OVER (ORDER BY alerted_at DESC, deal_key) AS rn, nullif(round, '') AS r, COALESCE(amount, deal_value) AS m FROM recent JOIN events_cfg USING (event)),
lat AS (SELECT {V.ms_between('published_at', 'alerted_at')} AS ms FROM deals WHERE alert_state = 'sent' AND alerted_at >= {_N} - INTERVAL 7 DAY),
stats AS (SELECT count(*) AS n, CAST(quantile_disc(ms, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(ms, 0.95) AS BIGINT) AS p95 FROM lat WHERE ms >= 0),
today AS (SELECT *, wall_ms / CAST(cycles AS DOUBLE) AS w, cpu_ms / CAST(cycles AS DOUBLE) AS c FROM days WHERE day = '{I.NOW_EVENTS[:10]}'),
cost AS (SELECT w, c, c * 43200 / 1000 / 3600 AS ch, w * 43200 / 1000 / 3600 * 2 AS gh, c * 43200 / 1000 / 3600 / 4 * 100 AS cp, w * 43200 / 1000 / 3600 * 2 / 360 * 100 AS mp FROM today)""",
    select=f"""
SELECT section, CAST(ord AS INT) AS ord, line FROM (
SELECT 'alerts' AS section, 0 AS ord, '<b>Alerts (24h): ' || count(*) || '</b>' AS line FROM recent
UNION ALL SELECT 'alerts', 1, '<i>Nothing was alerted in the last 24 hours.</i>' FROM recent HAVING count(*) = 0
UNION ALL SELECT 'alerts', rn, icon || ' <b>' || {V.escape('company')} || '</b>' || CASE WHEN r IS NULL AND m IS NULL THEN '' ELSE ' — ' || {V.escape("concat_ws(' · ', r, m)")} END FROM top WHERE rn <= 10
UNION ALL SELECT 'alerts', 11, '<i>…and ' || (count(*) - 10) || ' more</i>' FROM recent HAVING count(*) > 10
UNION ALL SELECT 'pipeline', 0, 'Cycles: ' || cycles || ' · items seen: ' || items_seen FROM today
UNION ALL SELECT 'pipeline', 1, 'Candidates: ' || candidates FROM today
UNION ALL SELECT 'pipeline', 2, 'Pending now: ' || count(*) FROM candidates WHERE status = 'pending'
UNION ALL SELECT 'latency', 0, 'p50 ' || ({V.duration('p50')}) || ' · p95 ' || ({V.duration('p95')}) || ' (' || n || ' alerts)' FROM stats
UNION ALL SELECT 'sources', 0, '<b>Sources: ' || count_if(last_success_at IS NOT NULL AND {V.ms_between('last_success_at', _N)} <= 900000) || '/' || count(*) || ' healthy</b>' FROM registry LEFT JOIN state USING (source_id) WHERE enabled
UNION ALL SELECT 'models', CASE WHEN model = 'model-0_5' THEN 0 ELSE 1 END, replace(model, '_', '.') || ': ' || requests || '/900' FROM models WHERE day = '{I.NOW_EVENTS[:10]}'
UNION ALL SELECT 'budget', 0, 'avg cycle: ' || CAST(floor(w + 0.5) AS BIGINT) || 'ms wall · ' || CAST(floor(c + 0.5) AS BIGINT) || 'ms cpu' FROM cost
UNION ALL SELECT 'budget', 1, {_MARK.format('cp')} || ' CPU ' || printf('%.2f', ch) || 'h / 4h (' || printf('%.0f', cp) || '%)' FROM cost
UNION ALL SELECT 'budget', 2, {_MARK.format('mp')} || ' Memory ' || printf('%.0f', gh) || ' / 360 GB-h (' || printf('%.0f', mp) || '%)' FROM cost)"""))
def daily_digest(spark, d):
    now = I.NOW_ITEMS
    usage = reports.daily_counters(I.cycles(spark, d)).where(F.col("day") == I.NOW_EVENTS[:10])
    limits = spark.createDataFrame([("model-0.5", 900), ("model-1.5", 900)], "model string, daily_limit bigint")
    quota = reports.quota_usage(I.calls(spark, d), limits).where(F.col("day") == I.NOW_EVENTS[:10])
    quota = quota.withColumn("ord", F.when(F.col("model") == "model-0.5", 0).otherwise(1))
    state = health.state_asof(I.fetch_log(spark, d), I.NOW_EVENTS)
    return reports.daily_digest(
        I.deals(spark, d), gate.event_table(spark), usage, reports.project_usage(usage), I.candidates(spark, d),
        I.registry(spark, d), state, quota, now,
    )
