"""Tables kept across commits, deliveries, and rules over whole histories."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse.operators import ordered, queue, reports
from wirepulse.plans import inputs as I, oracle_views as V
from wirepulse.plans.inputs import ntz
from wirepulse.plans.registered import query
from wirepulse.session import scratch_folder
from wirepulse.sources import ledger, versioned
from wirepulse.sources.sinks import append_once, appended


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


STATE = "source string, last_checked_at timestamp, etag string, last_modified string, last_error string"


@query(V.query(V.FETCH_LOG, """given AS (SELECT source_id || '/' || (check_id % 7) AS source, ts, check_id, etag, last_modified, error,
  (date_part('day', ts) - 1) // 5 AS batch FROM fetch_log)""", select="""
SELECT CAST(v AS BIGINT) AS version, source, max(ts) AS last_checked_at, arg_max(etag, (ts, check_id)) FILTER (etag IS NOT NULL) AS etag,
  arg_max(last_modified, (ts, check_id)) FILTER (last_modified IS NOT NULL) AS last_modified,
  arg_max(error, (ts, check_id)) FILTER (error IS NOT NULL) AS last_error
FROM given JOIN (SELECT unnest(range(1, 7)) AS v) ON batch < v GROUP BY v, source"""))
def upsert_table(spark, d):
    """State per source, upserted in six commits; every version is read after the last one.

    Each commit is tried twice, and before each another one is lost between its parts and its manifest.
    """
    log = I.fetch_log(spark, d).withColumns({
        "source": F.concat("source_id", F.lit("/"), (F.col("check_id") % 7).cast("string")), "last_checked_at": F.col("ts"), "last_error": F.col("error"),
    })
    path = scratch(spark, "state")
    for batch in range(6):
        rows = log.where(F.floor((F.dayofmonth("ts") - 1) / 5) == batch)
        lost = rows.select("source", "last_checked_at", F.lit("lost").alias("etag"), F.lit("0").alias("_part"))
        versioned.write_parts(lost, path, ["0"])
        for _ in range(2):
            versioned.upsert_table(rows, path, STATE, ["source"], ["ts", "check_id"], how="fill", buckets=8, writer="log", batch=batch)
    versions = [versioned.read_version(spark, path, STATE, v).withColumn("version", F.lit(v).cast("bigint")) for v in range(1, 7)]
    whole = versions[0]
    for more in versions[1:]:
        whole = whole.unionByName(more)
    return ntz(whole)


LOG = "check_id bigint, ts timestamp, status string"


@query(V.query(V.FETCH_LOG, select=f"""
SELECT check_id, CASE WHEN check_id % 50 <> 0 THEN ts END AS ts, status, CAST(v AS BIGINT) AS version
FROM fetch_log JOIN (SELECT unnest([4, 5]) AS v) ON
  CASE WHEN v = 4 THEN check_id % 50 = 0 OR ts > TIMESTAMP '{I.NOW_EVENTS}' - INTERVAL 20 DAY ELSE check_id % 50 = 0 OR ts > TIMESTAMP '{I.NOW_EVENTS}' - INTERVAL 12 DAY END"""))
def retention_partitions(spark, d):
    """A log of three commits, expired to twenty and then to twelve days; both versions."""
    log = I.fetch_log(spark, d).select("check_id", F.expr("case when check_id % 50 <> 0 then ts end").alias("ts"), "status")
    path = scratch(spark, "log")
    for batch in range(3):
        versioned.append_days(log.where(F.col("check_id") % 3 == batch), path, LOG, "ts", writer="log", batch=batch)
    for days in (20, 12):
        versioned.retain(spark, path, LOG, "ts", days, I.NOW_EVENTS)
    both = [versioned.read_version(spark, path, LOG, v).withColumn("version", F.lit(v).cast("bigint")) for v in (4, 5)]
    return ntz(both[0].unionByName(both[1]))


# ---------------------------------------------------------------- histories


@query(V.query(V.FETCH_LOG, """asked AS (SELECT event_id, 'src' || (user_id % 33) AS source_id, ts + INTERVAL 1 SECOND AS ts FROM events WHERE event_type <> 'view')""", select="""
SELECT a.event_id, a.source_id, f.check_id, f.status, f.etag FROM asked a ASOF LEFT JOIN fetch_log f ON a.source_id = f.source_id AND a.ts >= f.ts"""))
def asof_state(spark, d):
    """For every event the check of its source that was the last one at that moment."""
    asked = I.event_log(spark, d).where("event_type <> 'view'").selectExpr(
        "event_id", "concat('src', user_id % 33) as source_id", "timestampadd(SECOND, 1, ts) as ts"
    )
    return ordered.asof(asked, I.fetch_log(spark, d), ["source_id"], "ts", "check_id", ["check_id", "status", "etag"]).drop("ts")


@query(V.query(V.CALLS, """given AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, ts, call_id, COALESCE(status < 500, FALSE) AS counts, call_id // 3 % 2 = 0 AS even FROM calls),
r AS (SELECT *, count_if(counts) OVER w AS a, count_if(counts AND even) OVER w AS e, row_number() OVER w AS rn FROM given
  WINDOW w AS (PARTITION BY day ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b1 AS (SELECT day, min(rn) AS rn, min(e) AS e FROM r WHERE a >= 10 GROUP BY day),
b2 AS (SELECT r.day, min(r.rn) AS rn, min(r.a) AS a FROM r JOIN b1 USING (day) WHERE r.e >= b1.e + 2 GROUP BY r.day),
b3 AS (SELECT r.day, min(r.rn) AS rn FROM r JOIN b2 USING (day) WHERE r.a >= b2.a + 7 GROUP BY r.day)""", select="""
SELECT r.call_id, CASE WHEN b1.rn IS NULL OR r.rn <= b1.rn THEN 'primary' WHEN b2.rn IS NULL OR r.rn <= b2.rn THEN CASE WHEN even THEN 'primary' END
  WHEN b3.rn IS NULL OR r.rn <= b3.rn THEN 'fallback' END AS "grant",
  CASE WHEN b1.rn IS NULL OR r.rn <= b1.rn THEN NULL WHEN b2.rn IS NULL OR r.rn <= b2.rn THEN CASE WHEN NOT even THEN 'throttled' END
  WHEN b3.rn IS NOT NULL AND r.rn > b3.rn THEN 'exhausted' END AS reason
FROM r LEFT JOIN b1 USING (day) LEFT JOIN b2 USING (day) LEFT JOIN b3 USING (day)"""))
def quota_allocation(spark, d):
    """The model each call gets at its moment, from twelve and seven requests a day."""
    calls = I.calls(spark, d).selectExpr(
        "date_format(ts, 'yyyy-MM-dd') as day", "ts", "call_id", "coalesce(status < 500, false) as counts", "floor(call_id / 3) % 2 as parity"
    )
    return reports.quota_allocation(calls, 12, 7).select("call_id", "grant", "reason")


_SENT = f"SELECT CAST(alerted_at AS DATE) AS day, {V.ms_between('published_at', 'alerted_at')} AS ms FROM deals WHERE alert_state = 'sent'"


@query(V.query(V.HEADLINES, V.VERDICTS, V.REPORTS, V.DEALS, f"lags AS (SELECT * FROM ({_SENT}) WHERE ms >= 0)", select="""
SELECT day, CAST(w AS INT) AS days, count(*) AS n, CAST(quantile_disc(ms, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(ms, 0.9) AS BIGINT) AS p90,
  CAST(quantile_disc(ms, 0.99) AS BIGINT) AS p99
FROM (SELECT DISTINCT day FROM lags) e, (SELECT unnest([1, 7, 30]) AS w) s JOIN (SELECT day AS on_day, ms FROM lags) l ON l.on_day <= e.day AND l.on_day > e.day - CAST(w AS INT)
GROUP BY day, w"""))
def trailing_latency(spark, d):
    """Latency percentiles of the 1, 7 and 30 days up to every day, from histograms that four batches of deals leave."""
    sent = I.deals(spark, d).where("alert_state = 'sent'").select("item_id", "alerted_at", F.expr("unix_millis(alerted_at) - unix_millis(published_at)").alias("ms"))
    path = scratch(spark, "histogram")
    for batch in range(4):
        append_once(reports.day_histogram(sent.where(F.col("item_id") % 4 == batch), "alerted_at", "ms"), path, batch)
    return reports.trailing_percentiles(appended(spark, path, "day date, value bigint, n bigint"))


_STATUS = {"view": "pending", "click": "classified", "purchase": "alerted", "error": "rejected", "signup": "pending"}


@query("""WITH log AS (
  SELECT user_id % 40 AS id, event_id AS seq, ts, (event_id // 2) % 7 AS attempts,
    CASE event_type WHEN 'click' THEN 'classified' WHEN 'purchase' THEN 'alerted' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status FROM events),
chain AS (SELECT *, lag(status) OVER w AS b, lag(attempts) OVER w AS c,
  count_if(status = 'alerted') OVER (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alerts FROM log WINDOW w AS (PARTITION BY id ORDER BY ts, seq))
SELECT id, seq, 'illegal' AS kind FROM chain WHERE NOT (status = 'pending' OR (b = 'pending' AND status IN ('classified', 'rejected')) OR (b = 'classified' AND status IN ('alerted', 'rejected')))
  OR (b IS NULL AND status <> 'pending')
UNION ALL SELECT id, seq, 'lost attempt' FROM chain WHERE attempts < c AND NOT (status = 'pending' AND (attempts = c - 1 OR (attempts = 0 AND c >= 5)))
UNION ALL SELECT id, seq, 'double alert' FROM chain WHERE status = 'alerted' AND alerts > 1""")
def transition_violations(spark, d):
    """``events`` read as states of forty candidates: steps, attempts and alerts that cannot be right."""
    status = F.coalesce(F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])[F.col("event_type")], F.lit("pending"))
    log = I.event_log(spark, d).select((F.col("user_id") % 40).alias("id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), F.expr("floor(event_id / 2) % 7").alias("attempts"))
    return queue.transition_violations(log)


_TRIES = """SELECT deal_key, channel, emit_ts, moment, kind FROM (
  SELECT *, CASE WHEN step % 2 = 0 THEN 'lease' WHEN step = 2 * tries - 1 AND n % 3 = 0 THEN 'ack' ELSE 'fail' END AS kind,
    emit_ts + to_seconds(CAST(200 * step AS INT)) AS moment FROM (
    SELECT *, unnest(range(0, 2 * tries + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END)) AS step FROM outbox))"""


@query(V.query(V.HEADLINES, V.VERDICTS, V.REPORTS, V.DEALS, f"""base AS (SELECT deal_key, alerted_at AS emit_ts, item_id FROM deals WHERE alerted_at IS NOT NULL),
outbox AS (SELECT deal_key, emit_ts, channel, item_id + length(channel) AS n, (item_id + length(channel)) % 4 AS tries FROM base, (VALUES ('public'), ('dm')) c(channel)),
tries AS ({_TRIES}), last AS (SELECT max(emit_ts) + INTERVAL 5 MINUTE AS now FROM outbox),
state AS (SELECT deal_key, channel, emit_ts, count_if(kind = 'ack') > 0 AS acked, count_if(kind = 'fail') AS failures, max(moment) FILTER (kind = 'fail') AS failed_at,
  max(moment) FILTER (kind = 'lease') AS leased_at, max(moment) FILTER (kind <> 'lease') AS result_at FROM tries GROUP BY ALL)""", select="""
SELECT o.deal_key, o.channel, o.emit_ts, COALESCE(failures, 0) AS failures FROM outbox o LEFT JOIN state s USING (deal_key, channel, emit_ts), last
WHERE NOT COALESCE(acked, FALSE)
  AND NOT COALESCE(epoch_us(failed_at) // 1000 + CASE WHEN failures = 0 THEN 0 ELSE least(60000 * power(2, failures - 1), 600000) END > epoch_us(now) // 1000, FALSE)
  AND NOT COALESCE((result_at IS NULL OR leased_at > result_at) AND epoch_us(leased_at) // 1000 + 300000 > epoch_us(now) // 1000, FALSE)"""))
def outbox_pending(spark, d):
    """Deliveries that are due when some were acknowledged, some failed up to three times and some were lost under a lease."""
    base = I.deals(spark, d).where("alerted_at is not null").select("deal_key", F.col("alerted_at").alias("emit_ts"), "item_id")
    outbox = base.select("deal_key", "emit_ts", "item_id", F.explode(F.array(F.lit("public"), F.lit("dm"))).alias("channel"))
    outbox = outbox.withColumn("n", F.expr("item_id + length(channel)")).withColumn("tries", F.col("n") % 4)
    steps = outbox.select("*", F.explode(F.expr("slice(array(0, 1, 2, 3, 4, 5, 6), 1, cast(2 * tries + if(n % 5 = 0, 1, 0) as int))")).alias("step"))
    log = steps.selectExpr(
        "deal_key", "emit_ts", "channel", "case when step % 2 = 0 then 'lease' when step = 2 * tries - 1 and n % 3 = 0 then 'ack' else 'fail' end as kind",
        "timestampadd(SECOND, 200 * step, emit_ts) as at",
    )
    now = outbox.agg(F.max("emit_ts").alias("last")).first().last + timedelta(minutes=5)
    return ntz(ledger.pending_deliveries(outbox.select("deal_key", "emit_ts", "channel"), log, now).drop("delivery_id"))
