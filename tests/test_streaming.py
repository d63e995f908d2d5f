"""The document stream: restarts, repeated batches, equality with the batch rule."""

import json
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirepulse import schemas
from wirepulse.operators import gate
from wirepulse.sources import feeds, registry, sinks
from wirepulse.streaming import jobs

START = datetime(2026, 3, 1, 12)
NAMES = ["Orchid", "Tulip", "Maple", "Cedar"]


def rss(items):
    body = "".join(
        f"<item><title>{t}</title><link>{link}</link><description>A payments company.</description><pubDate>{when:%a, %d %b %Y %H:%M:%S} GMT</pubDate></item>"
        for t, link, when in items
    )
    return f"<rss><channel>{body}</channel></rss>"


def document(source, check, minutes, items):
    ts = START + timedelta(minutes=minutes)
    return (source, check, ts, "ok", None, 200, 0, 0, None, None, None, rss([(t, u, ts) for t, u in items]))


def documents():
    first = [
        document("a", 1, 0, [("Old news raises $1M today", "https://x.com/old")]),
        document("b", 2, 0, [("Old news raises $1M today", "https://y.com/old")]),
        document("a", 3, 1, [(f"{n} Payments raises $20M Series A", f"https://x.com/{n}") for n in NAMES]),
        document("b", 4, 2, [(f"Exclusive: {n} Payments raises $20M Series A", f"https://y.com/{n}") for n in NAMES]),
    ]
    broken = ("a", 5, START + timedelta(minutes=3), "ok", None, 200, 0, 0, None, None, None, "<rss><channel><item>")
    second = [
        document("a", 6, 60, [(f"{n} Payments closes $20 million round", f"https://x.com/{n}-2") for n in NAMES[:2]]),
        document("b", 7, 61, [("Orchid Payments launches a card", "https://y.com/launch"), ("Nothing to see", "https://y.com/none")]),
        document("a", 8, 62, [("Orchid Payments launches a card", "https://x.com/launch?utm_source=rss")]),
    ]
    return [*first, broken], second


@pytest.fixture
def landing(spark):
    folder = tempfile.mkdtemp(prefix="spark-landing-")

    def land(rows):
        spark.createDataFrame(rows, schemas.FETCH_LOG).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    return folder, land


@pytest.fixture(scope="module")
def sources(spark):
    folder = tempfile.mkdtemp(prefix="spark-registry-")
    with open(f"{folder}/sources.json", "w") as f:
        for name in "ab":
            f.write(json.dumps({"source_id": name, "url": f"https://{name}.com/rss", "type": "rss", "enabled": True, "min_interval_seconds": 60}) + "\n")
    return registry.read_registry(spark, folder)


def run(spark, folder, sources):
    docs = feeds.read_fetch_log(spark, f"{folder}/in", streaming=True)
    jobs.run_stream(docs, f"{folder}/out", f"{folder}/state", sources, gate.event_table(spark)).awaitTermination()


def test_stream_to_outbox_with_restart(spark, landing, sources):
    folder, land = landing
    first, second = documents()
    land(first)
    run(spark, folder, sources)
    run(spark, folder, sources)  # nothing new: a restart adds nothing
    outbox = spark.read.parquet(f"{folder}/out/outbox")
    companies = [r.c for r in outbox.select(F.regexp_extract("alert_html", "<b>(\\w+) Payments</b>", 1).alias("c")).collect()]
    assert sorted(companies) == sorted(NAMES)
    assert spark.read.parquet(f"{folder}/out/errors").count() == 1
    # The bootstrap payloads were recorded but never alerted.
    accepted = spark.read.parquet(f"{folder}/out/accepted")
    assert accepted.where("title like 'Old news%'").count() == 1

    land(second)
    run(spark, folder, sources)
    outbox = spark.read.parquet(f"{folder}/out/outbox")
    # The second funding story is inside the cool-down; the launch is new, once.
    assert outbox.count() == len(NAMES) + 1
    launch = outbox.where("alert_html like '%LAUNCH%'").collect()
    assert len(launch) == 1
    assert outbox.groupBy("deal_key", "channel").count().where("count > 1").count() == 0


def test_repeated_batch_changes_nothing(spark, landing, sources):
    folder, _ = landing
    first, second = documents()
    events = gate.event_table(spark)
    for number, rows in enumerate([first, second, second]):
        docs = spark.createDataFrame(rows, schemas.FETCH_LOG)
        jobs.process_batch(docs, min(number, 1), f"{folder}/out", sources, events)
    assert spark.read.parquet(f"{folder}/out/outbox").count() == len(NAMES) + 1


def test_late_items_are_kept_aside(spark, landing, sources):
    folder, _ = landing
    first, second = documents()
    events = gate.event_table(spark)
    jobs.process_batch(spark.createDataFrame(first, schemas.FETCH_LOG), 0, f"{folder}/out", sources, events)
    jobs.process_batch(
        spark.createDataFrame(second, schemas.FETCH_LOG), 1, f"{folder}/out", sources, events, now=START + timedelta(hours=9)
    )
    assert spark.read.parquet(f"{folder}/out/late").where("batch = 1").count() == 3
    assert spark.read.parquet(f"{folder}/out/outbox").where("batch = 1").count() == 0


def test_sessions_keep_open_ends_and_late_rows(spark):
    folder = tempfile.mkdtemp(prefix="spark-sessions-")
    schema = "job string, ts timestamp"
    # Seconds after START by batch; 300 apart still hold together, the last batch bridges two sessions hours back.
    batches = [
        [("a", 0), ("a", 300), ("a", 601), (None, 5)],
        [("a", 20_000), ("b", 20_100), (None, 250), ("a", None)],
        [("a", 450), ("a", 20_299)],
    ]
    for rows in batches:
        given = [(k, None if s is None else START + timedelta(seconds=s)) for k, s in rows]
        spark.createDataFrame(given, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        log = spark.readStream.schema(schema).parquet(f"{folder}/in")
        jobs.write_sessions(log, "job", "ts", 300_000_000, f"{folder}/out", f"{folder}/state").awaitTermination()
    got = jobs.latest_sessions(spark, f"{folder}/out", "job", 300_000_000).collect()
    seconds = lambda t: int((t - START).total_seconds())
    assert {(x.job, x.n, seconds(x.started_at), seconds(x.ended_at)) for x in got} == {
        ("a", 4, 0, 601), ("a", 2, 20_000, 20_299), ("b", 1, 20_100, 20_100), (None, 2, 5, 250),
    }
    assert len(got) == 4


def test_delivery_isolates_channels(spark):
    rows = spark.createDataFrame([("d", START, "public", "x"), ("d", START, "dm", "x")], schemas.OUTBOX)
    got = []

    def broken(_):
        raise ValueError("down")

    sinks.deliver(rows, {"public": broken, "dm": lambda f: got.extend(f.collect())})
    assert len(got) == 1
    with pytest.raises(RuntimeError):
        sinks.deliver(rows, {"public": broken})
