"""Streaming twins: run a stream over a whole table to its end, return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse.operators import dedupe, gate
from wirepulse.plans import flow, inputs as I, oracle_views as V
from wirepulse.plans.health_queries import _WARN
from wirepulse.plans.inputs import ntz
from wirepulse.plans.registered import ORACLES, query
from wirepulse.session import scratch_folder, use_utc
from wirepulse.streaming import jobs


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _events(spark, d):
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _events_table(spark, d):
    return I.event_log(spark, d).select("event_id", "ts", "event_type")


def _finish(frame: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the input and read back what was written."""
    spark = frame.sparkSession
    out = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        frame.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{out}/rows")


@query("SELECT user_id % 40 AS update_id, event_type FROM events GROUP BY ALL")
def stream_once_per_id(spark, d):
    updates = _events(spark, d).selectExpr("ts", "user_id % 40 as update_id", "event_type")
    kept = jobs.once_per_key(updates, ["update_id", "event_type"], "ts", "60 days")
    return _finish(kept).select("update_id", "event_type")


@query(V.query(V.CYCLES, select="""
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(cycles) AS BIGINT) AS cycles, CAST(sum(wall_ms) AS BIGINT) AS wall_ms FROM cycles GROUP BY 1"""))
def stream_daily(spark, d):
    log = _events(spark, d).selectExpr("ts", "1 as cycles", "cast(value * 100 as bigint) as wall_ms")
    out = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.write_updates(jobs.daily_totals(log, "ts", ["cycles", "wall_ms"]), f"{out}/rows", f"{out}/state").awaitTermination()
    return jobs.latest_totals(spark, f"{out}/rows", "day string, cycles bigint, wall_ms bigint", "day")


class Arrivals:
    """A table that arrives in ``slices`` parts, one after the other; ``land`` adds some of them to the stream's folder.

    Every part comes in the same number of files, as many as one part of average size asks for, so that a micro-batch of
    that many files is one part, and no task writes or reads a part alone.
    """

    def __init__(self, rows: DataFrame, slice_of, slices: int = 12, file_rows: int = 20_000):
        self.spark, self.folder = rows.sparkSession, f"{scratch_folder(rows.sparkSession)}/arrivals-{uuid.uuid4().hex}"
        self.schema, self.rows = rows.schema, rows.withColumn("_slice", slice_of)
        self.files = max(1, rows.count() // (slices * file_rows))
        self.slices, self.landed = slices, 0

    def land(self, count: int) -> DataFrame:
        """The stream over the folder after ``count`` more parts, each a micro-batch of its own."""
        for k in range(self.landed, self.landed + count):
            rows = self.rows.where(F.col("_slice") == k).select(*self.schema.names)
            rows.repartition(self.files, *self.schema.names).write.mode("append").parquet(f"{self.folder}/in")
            missing = (k + 1) * self.files - len(self.spark.read.schema(self.schema).parquet(f"{self.folder}/in").inputFiles())
            for _ in range(missing):  # partitions without rows write no file
                rows.limit(0).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.landed += count
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(f"{self.folder}/in")


#: Files by time, twelve in a month; every tenth event comes one to three files later.
_SLICE = "least(floor((dayofmonth(ts) - 1) * 12 / 31) + case when event_id % 10 = 0 then {late} else 0 end, 11)"


@query(V.query(V.CYCLES, _WARN, select="""
SELECT k AS job, min(id) AS cycle_id FROM spans JOIN chain USING (k, t) GROUP BY k, t""").replace("WITH ", "WITH RECURSIVE ", 1))
def stream_cooldown(spark, d):
    """Twelve files, every tenth row one file late but within the delay, and a restart: equal to the batch rule."""
    files = Arrivals(_events_table(spark, d), F.expr(_SLICE.format(late="1")))
    out = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        rows = files.land(6)
        jobs.emit_with_cooldown(rows, "event_type", "ts", "event_id", 3_600_000, f"{out}/rows", f"{out}/state", "7 days").awaitTermination()
    emitted = jobs.all_emissions(spark, f"{out}/rows", f"{out}/state", 3_600_000)
    return emitted.select(F.col("key").alias("job"), F.col("tie").alias("cycle_id"))


@query("""WITH given AS (
  SELECT event_id, ts, least((date_part('day', ts) - 1) * 12 // 31 + CASE WHEN event_id % 10 = 0 THEN 1 + event_id // 10 % 3 ELSE 0 END, 11) AS s FROM events),
marks AS (SELECT s, max(max(epoch_us(ts) // 1000)) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 4 * 86400000 AS mark FROM given GROUP BY s)
SELECT event_id, ts, COALESCE(epoch_us(ts) // 1000 <= mark, FALSE) AS late FROM given JOIN marks USING (s)""")
def stream_late(spark, d):
    """Twelve files out of order, four days of patience and a restart: every row once, on time or late."""
    files = Arrivals(_events_table(spark, d), F.expr(_SLICE.format(late="1 + floor(event_id / 10) % 3")))
    out = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        jobs.write_timely(files.land(6), "ts", 4 * 86_400_000, out, f"{out}/state").awaitTermination()
    both = [spark.read.schema("event_id bigint, ts timestamp").parquet(f"{out}/{k}").select("event_id", "ts", F.lit(k == "late").alias("late")) for k in ("timely", "late")]
    return ntz(both[0].unionByName(both[1]))


@query(ORACLES["dedupe_two_key"])
def stream_two_key(spark, d):
    """Headlines in ten files by fetch time, and a restart: equal to the batch rule over all of them."""
    items = I.headlines(spark, d).select("item_id", "source_id", "title", "link", "fetched_at")
    span = items.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).first()
    width = (span.hi - span.lo).total_seconds() / 10 + 1
    files = Arrivals(items, F.floor((F.unix_seconds("fetched_at") - F.unix_seconds(F.lit(span.lo))) / width), 10)
    out = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        keyed = dedupe.with_keys(files.land(5))
        jobs.dedupe_two_key_stream(keyed, I.ORDER, "fetched_at", out, f"{out}/state", buckets=4, merge_after=3).awaitTermination()
    return spark.read.schema("item_id bigint").parquet(f"{out}/kept").select("item_id")


@query(ORACLES["unchanged_skip"])
def stream_unchanged(spark, d):
    """The fetch log in ten files by time, and a restart: equal to the batch rule."""
    docs = I.fetch_log(spark, d).drop("body_hash")
    files = Arrivals(docs, F.expr("least(floor((dayofmonth(ts) - 1) / 3), 9)"))
    out = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        jobs.unchanged_skip_stream(files.land(5), out, f"{out}/state", buckets=4).awaitTermination()
    return spark.read.parquet(f"{out}/changed").select("check_id", "source_id", "body_hash")


@query(V.query(V.CYCLES, select="""
SELECT job, count(*) AS n, min(ts) AS started_at FROM (
  SELECT *, count_if(opens) OVER (PARTITION BY job ORDER BY ts, cycle_id) AS s FROM (
    SELECT *, COALESCE(ts - lag(ts) OVER (PARTITION BY job ORDER BY ts, cycle_id) > INTERVAL 5 MINUTE, TRUE) AS opens FROM cycles))
GROUP BY job, s HAVING max(ts) + INTERVAL 5 MINUTE + INTERVAL 1 MICROSECOND <= (SELECT max(ts) - INTERVAL 1 HOUR FROM cycles)"""))
def stream_sessions(spark, d):
    """Only the sessions that the watermark has closed; ``stream_sessions_all`` has the open ones, too."""
    rows = _events(spark, d).selectExpr("event_type as job", "ts")
    return ntz(_finish(jobs.activity_sessions(rows, "job", "ts")))


@query(V.query(V.CYCLES, select="""
SELECT job, count(*) AS n, min(ts) AS started_at, max(ts) AS ended_at FROM (
  SELECT *, count_if(opens) OVER (PARTITION BY job ORDER BY ts, cycle_id) AS s FROM (
    SELECT *, COALESCE(ts - lag(ts) OVER (PARTITION BY job ORDER BY ts, cycle_id) > INTERVAL 5 MINUTE, TRUE) AS opens FROM cycles))
GROUP BY job, s"""))
def stream_sessions_all(spark, d):
    rows = _events(spark, d).selectExpr("event_type as job", "ts")
    out = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.write_sessions(rows, "job", "ts", 300_000_000, f"{out}/rows", f"{out}/state").awaitTermination()
    return ntz(jobs.latest_sessions(spark, f"{out}/rows", "job", 300_000_000))


@query()
def batch_alerts(spark, d):
    """Headlines through dedupe, keyword stage, default scorer, gate and cool-down."""
    items = dedupe.with_keys(I.headlines(spark, d)).withColumns({
        "check_id": F.lit(0), "position": F.col("item_id"), "id": F.col("item_id"), "categories": F.array().cast("array<string>"),
    })
    no_lists = items.select("source_id").distinct().withColumn("category_filter", F.lit(None).cast("array<string>"))
    result = flow.alerts_from(flow.candidates_from(items, no_lists), gate.event_table(spark))
    return ntz(result.outbox)
