"""Rules over whole histories: as-of joins, running totals, allocation, trailing percentiles, state machine, deliveries."""

import math
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirepulse.operators import ordered, queue, reports
from wirepulse.sources import ledger
from wirepulse.streaming import jobs

START = datetime(2026, 3, 1)


def order(row):
    return tuple((x is not None, x) for x in row)


# ---------------------------------------------------------------- as-of join and running totals


def test_asof_equals_search(spark):
    r = random.Random(3)
    moment = lambda: r.choice([START + timedelta(minutes=r.randint(0, 300))] * 12 + [None])
    name = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    right = [(name(), moment(), k, r.choice([None, k])) for k in range(150)]
    left = [(k, name(), moment(), "clash") for k in range(300)] + [(k, "none", moment(), "clash") for k in range(5)] * 2
    a = spark.createDataFrame(left, "n int, k string, ts timestamp, _at string").repartition(4)
    b = spark.createDataFrame(right, "k string, ts timestamp, seq int, v int").repartition(3)
    got = ordered.asof(a.withColumnRenamed("_at", "other"), b, ["k"], "ts", "seq", ["seq", "v"])
    want = []
    for n, k, ts, other in left:
        before = [x for x in right if x[0] == k and x[1] is not None and ts is not None and x[1] <= ts]
        best = max(before, key=lambda x: (x[1], x[2]), default=(None,) * 4)
        want.append((n, k, ts, other, best[2], best[3]))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert ordered.asof(a, b.limit(0), ["k"], "ts", "seq", ["seq"]).where("seq is not null").count() == 0
    assert ordered.asof(a.limit(0), b, ["k"], "ts", "seq", ["seq"]).count() == 0


def test_running_totals(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", None, "b"]), k, r.randint(-5, 5)) for k in range(200)]
    frame = spark.createDataFrame(rows, "k string, seq int, v int").repartition(5)
    got = ordered.running(frame, F.col("k"), ["seq"], {"total": F.col("v")}).collect()
    totals = {}
    for k, seq, v in rows:
        n, t = totals.get(k, (0, 0))
        totals[k] = n + 1, t + v
        assert [(x.rn, x.total) for x in got if x.seq == seq] == [totals[k]]


# ---------------------------------------------------------------- allocation


@pytest.mark.parametrize("primary,fallback,share", [(10, 6, 0.8), (3, None, 0.5), (0, 4, 0.8), (5, 0, 1.0), (7, 50, 0.0), (500, 5, 0.8)])
def test_allocation_equals_the_loop(spark, primary, fallback, share):
    r = random.Random(primary)
    rows = [(r.choice(["d1", "d1", "d2"]), START + timedelta(seconds=r.randint(0, 40)), k, r.random() < 0.8, r.choice([0, 1, 2, 3])) for k in range(120)]
    rows += [("d3", START, 1000, None, None)]
    frame = spark.createDataFrame(rows, "day string, ts timestamp, call_id int, counts boolean, parity int").repartition(3)
    got = {x.call_id: (x.grant, x.reason) for x in reports.quota_allocation(frame, primary, fallback, share).collect()}
    used = {}
    for day, ts, call, counts, parity in sorted(rows, key=lambda x: (x[1], x[2])):
        first, second = used.get(day, (0, 0))
        if first < primary:
            grant, reason = ("primary", None) if first < primary * share or (parity or 0) % 2 == 0 else (None, "throttled")
        else:
            grant, reason = ("fallback", None) if second < (fallback or 0) else (None, "exhausted")
        used[day] = (first + (grant == "primary" and bool(counts)), second + (grant == "fallback" and bool(counts)))
        assert got[call] == (grant, reason), (call, used)


# ---------------------------------------------------------------- trailing percentiles


def test_trailing_percentiles_equal_sorting(spark):
    r = random.Random(5)
    rows = [(START + timedelta(days=r.choice([0, 1, 2, 5, 6, 20, 45]), minutes=r.randint(0, 1400)), r.choice([r.randint(0, 9), r.randint(0, 1 << 50), 1 << 21, None, -4])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "ts timestamp, ms bigint")
    parts = [reports.day_histogram(frame.where(F.pmod(F.xxhash64("ts"), F.lit(3)) == k), "ts", "ms") for k in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = {(x.day, x.days): (x.n, x.p50, x.p99) for x in reports.trailing_percentiles(whole, (1, 7, 30), (50, 99)).collect()}
    known = sorted((ts.date(), v) for ts, v in rows if v is not None and v >= 0)
    want = {}
    for day in {d for d, _ in known}:
        for w in (1, 7, 30):
            values = sorted(v for d, v in known if day - timedelta(days=w) < d <= day)
            rank = lambda p: values[max(1, math.ceil(p * len(values) / 100)) - 1]
            want[(day, w)] = (len(values), rank(50), rank(99))
    assert got == want


def test_blocks_looked_for_keep_a_small_size_estimate(spark, monkeypatch):
    """Otherwise the planner broadcasts the counts they are joined with."""
    sizes, real = [], reports._blocks_at

    def noted(blocks):
        wanted = real(blocks)
        sizes.append(int(str(wanted._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return wanted

    monkeypatch.setattr(reports, "_blocks_at", noted)
    counts = spark.range(300).select(F.date_add(F.lit(START).cast("date"), (F.col("id") % 9).cast("int")).alias("day"), (F.col("id") * 70_000).alias("value"), F.lit(1).cast("long").alias("n"))
    assert reports.trailing_percentiles(counts).count() == 27
    assert len(sizes) == 3 and max(sizes) < 100_000


# ---------------------------------------------------------------- state machine


def test_transition_violations(spark):
    r = random.Random(6)
    names = ["pending", "pending", "classified", "alerted", "rejected", "unheard of", None]
    rows = [(r.choice([1, 1, 1, 2, 3]), START + timedelta(minutes=k // 2), k, r.choice(names), r.choice([None, r.randint(0, 6)])) for k in range(300)]
    frame = spark.createDataFrame(rows, "id int, ts timestamp, seq int, status string, attempts int").repartition(4)
    got = sorted(map(tuple, queue.transition_violations(frame).collect()))
    want, last, alerts = [], {}, {}
    for name, _, seq, status, attempts in rows:
        before, tried = last.get(name, (None, None))
        if (before, status) not in queue.TRANSITIONS:
            want.append((name, seq, "illegal"))
        if None not in (attempts, tried) and attempts < tried and not (status == "pending" and (attempts == tried - 1 or (attempts == 0 and tried >= 5))):
            want.append((name, seq, "lost attempt"))
        if status == "alerted":
            alerts[name] = alerts.get(name, 0) + 1
            if alerts[name] > 1:
                want.append((name, seq, "double alert"))
        last[name] = (status, attempts)
    assert got == sorted(want) and {k for _, _, k in got} == {"illegal", "lost attempt", "double alert"}


# ---------------------------------------------------------------- deliveries


def test_deliveries_survive_failures_and_a_crash(spark):
    place = tempfile.mkdtemp(prefix="spark-ledger-")
    rows = [(f"d{k}", START, c, f"text {k}") for k in range(6) for c in ("public", "dm")]
    outbox = spark.createDataFrame([*rows, rows[0]], "deal_key string, emit_ts timestamp, channel string, alert_html string")
    sent = {"public": [], "dm": []}

    def channel(name, refuse=(), down=False, crash=False):
        def send(frame):
            given = frame.collect()
            if down:
                raise ConnectionError
            bad = [x for x in given if x.deal_key in refuse]
            sent[name].extend((x.deal_key, x.delivery_id) for x in given if x not in bad)
            if crash:
                raise SystemExit
            return spark.createDataFrame([(x.delivery_id,) for x in bad], "delivery_id string") if bad else None

        return send

    at = lambda seconds: START + timedelta(seconds=seconds)
    ledger.deliver_due(outbox, place, {"public": channel("public", refuse=["d1"]), "dm": channel("dm", down=True)}, at(0), 0)
    assert sorted(k for k, _ in sent["public"]) == ["d0", "d2", "d3", "d4", "d5"] and not sent["dm"]
    # Nothing is due before the first failure's wait is over, then just what failed.
    ledger.deliver_due(outbox, place, {"public": channel("public"), "dm": channel("dm")}, at(30), 1)
    assert len(sent["public"]) == 5 and not sent["dm"]
    with pytest.raises(SystemExit):  # the driver dies after the channel took the rows
        ledger.deliver_due(outbox, place, {"public": channel("public"), "dm": channel("dm", crash=True)}, at(61), 2)
    assert len(sent["public"]) == 6 and len(sent["dm"]) == 6
    # The lease holds for five minutes; afterwards the lost ones come again, under the same delivery_id.
    ledger.deliver_due(outbox, place, {"public": channel("public"), "dm": channel("dm")}, at(300), 3)
    assert len(sent["dm"]) == 6
    ledger.deliver_due(outbox, place, {"public": channel("public"), "dm": channel("dm", refuse=["d5"])}, at(400), 4)
    assert len(sent["public"]) == 6 and len(sent["dm"]) == 11 and len(set(sent["dm"])) == 6
    state = {x.deal_key: x for x in ledger.delivery_state(ledger.read_ledger(spark, place, ["public", "dm"])).where("channel = 'dm'").collect()}
    assert state["d0"].acked and not state["d5"].acked and state["d5"].failures == 2
    # The second failure in a row waits twice as long.
    due = lambda s: ledger.pending_deliveries(outbox, ledger.read_ledger(spark, place, ["public", "dm"]), at(s)).collect()
    assert due(519) == [] and [(x.deal_key, x.channel, x.failures) for x in due(520)] == [("d5", "dm", 2)]


# ---------------------------------------------------------------- unchanged documents on a stream


def test_unchanged_stream_compares_with_the_stored_hash(spark):
    place, schema = tempfile.mkdtemp(prefix="spark-unchanged-"), "source_id string, ts timestamp, check_id bigint, status string, body string"
    batches = [
        [("a", 0, 1, "ok", "x"), ("a", 1, 2, "ok", "x"), ("b", 0, 3, "ok", "x"), ("a", 2, 4, "error", None)],
        [("a", 5, 5, "ok", "x"), ("b", 6, 6, "ok", "y"), ("b", 7, 7, "ok", "x"), ("c", 5, 8, "not-modified", None)],
        [("a", 9, 9, "ok", "z"), ("b", 8, 10, "ok", "x"), ("c", 9, 11, "ok", "x")],
    ]
    for rows in batches:
        spark.createDataFrame([(s, START + timedelta(minutes=m), *rest) for s, m, *rest in rows], schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
        docs = spark.readStream.schema(schema).parquet(f"{place}/in")
        jobs.unchanged_skip_stream(docs, f"{place}/out", f"{place}/state", buckets=2).awaitTermination()
    got = {x.check_id for x in spark.read.parquet(f"{place}/out/changed").collect()}
    assert got == {1, 3, 6, 7, 9, 11}
