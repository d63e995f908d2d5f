"""Queries over verdicts and deals: gate, cool-down, merging, rendering, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirepulse.functions import text as tx, times as tm
from wirepulse.operators import deals as dl, gate, queue, reports
from wirepulse.plans import inputs as I, oracle_views as V
from wirepulse.plans.inputs import ntz
from wirepulse.plans.registered import query

T = f"TIMESTAMP '{I.NOW_ITEMS}'"
_V = (V.HEADLINES, V.VERDICTS)
_R = (*_V, V.REPORTS)
_D = (*_R, V.DEALS)

# ---------------------------------------------------------------- gate


def _gate(paused: str) -> str:
    return V.query(*_V, select=f"""
SELECT item_id, threshold, ok AND NOT {paused} AS alert, CASE WHEN NOT ok THEN
    CASE WHEN NOT is_fintech THEN 'not fintech' WHEN region = 'other' THEN 'region other' WHEN event IS NULL THEN 'not a tracked event'
         ELSE 'confidence ' || {V.to_fixed('CAST(confidence AS DOUBLE)', 2)} || ' below ' || CAST(threshold AS VARCHAR) END
    WHEN {paused} THEN 'paused' END AS rejected_reason
FROM (SELECT *, relevant AND event IS NOT NULL AND confidence >= threshold AS ok FROM (
  SELECT v.*, CAST(greatest(COALESCE(min_confidence, 0.72), 0.72) AS DOUBLE) AS threshold FROM verdicts v LEFT JOIN events_cfg USING (event)))""")


def _gated(spark, d, paused):
    rows = gate.gate_verdicts(I.verdicts(spark, d), gate.event_table(spark), 0.72, paused)
    return rows.select("item_id", "threshold", "alert", "rejected_reason")


@query(_gate("FALSE"))
def confidence_gate(spark, d):
    return _gated(spark, d, False)


@query(_gate("TRUE"))
def confidence_gate_paused(spark, d):
    return _gated(spark, d, True)


@query(V.query(*_V, V.CANDIDATES, select="""
SELECT c.id, CASE WHEN v.item_id IS NULL THEN 'pending' ELSE 'classified' END AS status, v.company
FROM candidates c LEFT JOIN verdicts v ON v.item_id = c.id AND v.k % 6 <> 0 WHERE c.status = 'pending'"""))
def verdict_assoc(spark, d):
    cands = I.candidates(spark, d).where("status = 'pending'").select("id", "status")
    answers = I.verdicts(spark, d).where("k % 6 <> 0").selectExpr("item_id as id", "company")
    return queue.associate(cands, answers, ["id"]).select("id", "status", "company")


# ---------------------------------------------------------------- cool-down and merging

_COOL = """spans AS (SELECT deal_key, report_id, reported_at, source_id, title, link, published_at, epoch_ms(reported_at) AS t, window_hours * 3600000 AS w FROM reports JOIN events_cfg USING (event)),
chain(deal_key, t, w) AS (
  SELECT deal_key, min(t), any_value(w) FROM spans GROUP BY deal_key
  UNION ALL
  SELECT c.deal_key, (SELECT min(s.t) FROM spans s WHERE s.deal_key = c.deal_key AND s.t >= c.t + c.w), c.w FROM chain c WHERE c.t IS NOT NULL),
emits AS (SELECT deal_key, t FROM chain WHERE t IS NOT NULL),
cooled AS (SELECT s.*, e.t AS emit_t, s.t = e.t AND s.report_id = min(s.report_id) OVER (PARTITION BY s.deal_key, s.t) AS emitted
  FROM spans s ASOF JOIN emits e ON s.deal_key = e.deal_key AND s.t >= e.t)"""


def _rec(*views: str, select: str) -> str:
    return V.query(*views, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_rec(*_R, _COOL, select="SELECT report_id, deal_key, emitted, make_timestamp(emit_t * 1000) AS emit_ts FROM cooled"))
def deal_cooldown(spark, d):
    rows = dl.deal_cooldown(I.reports(spark, d), gate.event_table(spark))
    return ntz(rows.select("report_id", "deal_key", "emitted", "emit_ts"))


@query(_rec(*_R, _COOL, select="""
SELECT report_id, deal_key, (SELECT count(DISTINCT (r.source_id, r.title, r.link, r.published_at)) FROM cooled r
  WHERE r.deal_key = c.deal_key AND (r.t < c.t OR (r.t = c.t AND r.report_id <= c.report_id))) AS n_sources
FROM cooled c WHERE emitted"""))
def deal_alert_sources(spark, d):
    rows = dl.deal_cooldown(I.reports(spark, d), gate.event_table(spark))
    return dl.emitted_deals(rows).select("report_id", "deal_key", "n_sources")


@query(V.query(*_R, select="""
SELECT deal_key, count(*) AS n_sources, count(*) - 1 AS also_reported_by FROM (
  SELECT DISTINCT deal_key, source_id, title, link, published_at FROM reports) GROUP BY deal_key"""))
def deal_source_merge(spark, d):
    return dl.source_counts(I.reports(spark, d))


@query(V.query(*_D, select="""
SELECT deal_key, channel FROM deals, (VALUES ('public'), ('dm')) AS ch(channel)
WHERE alert_state = 'sent' AND NOT (channel = 'public' AND unverified)"""))
def alert_routing(spark, d):
    sent = I.deals(spark, d).where("alert_state = 'sent'")
    return dl.route_alerts(sent, public_enabled=True, also_dm=True).select("deal_key", "channel")


@query(V.query(*_R, select="SELECT deal_key, source_id, title, link, min(reported_at) AS first_reported_at, published_at FROM reports GROUP BY ALL"))
def deal_sources(spark, d):
    return ntz(dl.merge_sources(I.reports(spark, d)))


# ---------------------------------------------------------------- rendering

_X = V.escape


def _line(expr: str) -> str:
    return f"CASE WHEN {expr} IS NOT NULL THEN {expr} END"


_LEADS = "list_filter(lead_investors, lambda s: s <> '')"
_OTHERS = "list_filter(other_investors, lambda s: s <> '')"
_LATENCY = V.ms_between("published_at", "alerted_at")
_ALERTS = f"""alerts AS (
  SELECT r.item_id, r.k, r.event, r.region, r.company, nullif(r.round, '') AS round, r.amount, r.deal_value, r.lead_investors, r.other_investors,
    r.acquirer, r.target, r.summary, r.source_id, r.link, r.published_at, r.unverified, r.k % 4 AS n_sources,
    r.fetched_at + to_seconds(CAST(r.k % 7200 AS INT)) AS alerted_at, icon, label FROM reports r JOIN events_cfg USING (event)),
rendered AS (SELECT item_id, concat_ws(chr(10),
  CASE WHEN unverified THEN '⚠️ <b>UNVERIFIED</b> (AI offline — keyword match only)' END,
  icon || ' <b>' || label || '</b> · ' || CASE region WHEN 'US' THEN '🇺🇸' WHEN 'CA' THEN '🇨🇦' WHEN 'US+CA' THEN '🇺🇸🇨🇦' ELSE '🌐' END,
  '<b>' || {_X('company')} || '</b>' || CASE WHEN round IS NULL AND COALESCE(amount, deal_value) IS NULL THEN '' ELSE ' — ' || concat_ws(' · ', {_X('round')}, {_X('COALESCE(amount, deal_value)')}) END,
  CASE WHEN event = 'acquisition' THEN CASE WHEN acquirer IS NOT NULL AND target IS NOT NULL THEN concat_ws(' · ', {_X('acquirer')} || ' → ' || {_X('target')}, {_X('deal_value')}) END
       WHEN len({_LEADS}) > 0 THEN 'Led by: ' || {_X(f"array_to_string({_LEADS}, ', ')")} || CASE WHEN len({_OTHERS}) > 0 THEN ' (+' || len({_OTHERS}) || ' more)' ELSE '' END
       WHEN len({_OTHERS}) > 0 THEN 'Investors: ' || {_X(f"array_to_string({_OTHERS}[1:3], ', ')")} END,
  {_X('summary')},
  '<i>' || concat_ws(' · ', {_X('source_id')}, 'published ' || strftime(timezone('America/New_York', timezone('UTC', published_at)), '%H:%M') || ' ET', 'detected in ' || ({V.duration(_LATENCY)})) || '</i>',
  '<a href="' || {_X('link')} || '">Read source →</a>',
  CASE WHEN n_sources > 1 THEN '<i>also reported by ' || (n_sources - 1) || ' other source(s)</i>' END) AS alert_html FROM alerts)"""


def _rendered(spark, d):
    alerted = "timestampadd(SECOND, k % 7200, fetched_at)"
    rows = I.reports(spark, d).selectExpr(
        "*", "k % 4 as n_sources", "source_id as source_name",
        f"unix_millis({alerted}) - unix_millis(published_at) as latency_ms",
    )
    return dl.render_alert(rows, gate.event_table(spark)).select("item_id", "alert_html")


@query(V.query(*_R, _ALERTS, select="SELECT item_id, alert_html FROM rendered"))
def render_alert(spark, d):
    return _rendered(spark, d)


_PLAIN = r"""regexp_replace(regexp_replace(alert_html, '<a href="([^"]*)">([^<]*)</a>', '\2 \1', 'g'), '</?[bi]>', '', 'g')"""


@query(V.query(*_R, _ALERTS, select=f"""
SELECT item_id, replace(replace(replace(replace(replace({_PLAIN}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS text FROM rendered"""))
def plain_text(spark, d):
    return _rendered(spark, d).select("item_id", tx.plain_text(F.col("alert_html")).alias("text"))


_ODD = "title || ' <' || COALESCE(acquirer, 'x') || '> & \"' || COALESCE(amount, '') || '\"'"


@query(V.query(*_V, select=f"SELECT item_id, {_X('(' + _ODD + ')')} AS escaped FROM verdicts"))
def escape_html(spark, d):
    odd = F.expr("concat(title, ' <', coalesce(acquirer, 'x'), '> & \"', coalesce(amount, ''), '\"')")
    return I.verdicts(spark, d).select("item_id", tx.escape_html(odd).alias("escaped"))


_MS = "(k * 7919) % 9000000 - 5000"


@query(V.query(V.HEADLINES, select=f"SELECT item_id, {V.duration('(' + _MS + ')')} AS text FROM headlines"))
def format_duration(spark, d):
    return I.headlines(spark, d).select("item_id", tm.format_duration(F.expr(_MS)).alias("text"))


_MIN = f"floor({_MS.replace('9000000', '500000000').join('()')} / 60000.0 + 0.5)"


@query(V.query(V.HEADLINES, select=f"""
SELECT item_id, CASE WHEN k % 9 = 0 THEN 'unknown' WHEN m < 60 THEN CAST(m AS BIGINT) || 'm' WHEN m < 1440 THEN {V.to_fixed('(m / 60.0)', 1)} || 'h'
  ELSE {V.to_fixed('(m / 1440.0)', 1)} || 'd' END AS text FROM (SELECT *, {_MIN} AS m FROM headlines)"""))
def age_text(spark, d):
    ms = F.when(F.expr("k % 9 <> 0"), F.expr(_MS.replace("9000000", "500000000")))
    return I.headlines(spark, d).select("item_id", tm.age_text(ms).alias("text"))


@query(V.query(V.HEADLINES, select="""
SELECT item_id, strftime(et, '%H:%M') AS time, strftime(et, '%b %-d, %H:%M') AS datetime
FROM (SELECT item_id, timezone('America/New_York', timezone('UTC', fetched_at)) AS et FROM headlines)"""))
def format_et(spark, d):
    t = F.col("fetched_at")
    return I.headlines(spark, d).select("item_id", tm.format_et_time(t).alias("time"), tm.format_et_datetime(t).alias("datetime"))


# ---------------------------------------------------------------- deal reports


@query(V.query(*_D, select=f"""
SELECT deal_key, company, alerted_at FROM deals WHERE alert_state = 'sent' AND alerted_at >= {T} - INTERVAL 90 DAY
  AND event = 'funding' AND region = 'US' AND contains(lower(company), 'chant 1')"""))
def deal_search(spark, d):
    found = dl.search_deals(I.deals(spark, d), I.NOW_ITEMS, "funding", "US", "90", " CHANT 1")
    return ntz(found.select("deal_key", "company", "alerted_at"))


@query(V.query(*_D, select=f"SELECT deal_key, event, alerted_at FROM deals WHERE alert_state = 'sent' AND alerted_at >= {T} - INTERVAL 30 DAY"))
def deal_search_defaults(spark, d):
    found = dl.search_deals(I.deals(spark, d), I.NOW_ITEMS, "ipo", "mars", "31", "  ")
    return ntz(found.select("deal_key", "event", "alerted_at"))


@query(V.query(*_D, select="SELECT deal_key, company, alerted_at FROM deals WHERE alert_state = 'sent' ORDER BY alerted_at DESC, deal_key LIMIT 100"))
def recent_deals(spark, d):
    return ntz(dl.recent_deals(I.deals(spark, d), 100).select("deal_key", "company", "alerted_at"))


_LAT = f"SELECT {V.ms_between('published_at', 'alerted_at')} AS ms FROM deals WHERE alert_state = 'sent' AND alerted_at >= {T} - INTERVAL 3650 DAY"
_STATS = f"""SELECT count(*) AS count, CAST(quantile_disc(ms, 0.5) AS BIGINT) AS p50_ms, CAST(quantile_disc(ms, 0.95) AS BIGINT) AS p95_ms,
  min(ms) AS min_ms, max(ms) AS max_ms FROM ({_LAT}) WHERE ms >= 0"""


@query(V.query(*_D, select=_STATS))
def latency_stats(spark, d):
    return reports.latency_stats(I.deals(spark, d), 3650, I.NOW_ITEMS)


_SAY = lambda label, c: f"'{label}: ' || ({V.duration(c)})"


@query(V.query(*_D, f"s AS ({_STATS})", select=f"""
SELECT 'Alerts measured: ' || count || chr(10) || {_SAY('p50', 'p50_ms')} || chr(10) || {_SAY('p95', 'p95_ms')} || chr(10) || {_SAY('best', 'min_ms')}
  || chr(10) || {_SAY('worst', 'max_ms')} AS report FROM s"""))
def latency_lines(spark, d):
    return reports.latency_lines(reports.latency_stats(I.deals(spark, d), 3650, I.NOW_ITEMS))


@query(V.query(*_D, select=f"SELECT count(*) AS alerts FROM deals WHERE alert_state = 'sent' AND alerted_at >= {T} - INTERVAL 1 DAY"))
def alerts_since(spark, d):
    return reports.alerts_since(I.deals(spark, d), tm.shift(tm.instant(I.NOW_ITEMS), -86_400))
