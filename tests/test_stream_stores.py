"""Streams whose state is a store: seen keys, cool-down by timers, late rows; over many batches, with restarts."""

import random
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wirepulse.operators import dedupe
from wirepulse.streaming import cooling, jobs, seen

START = datetime(2026, 3, 1)


def folder():
    return tempfile.mkdtemp(prefix="spark-stores-")


def stream(spark, place, rows, schema):
    """The stream over ``place`` after one more file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(schema).parquet(f"{place}/in")


# ---------------------------------------------------------------- seen keys


def test_seen_store_forgets_merges_and_opens_few_parts(spark):
    r, place, memory = random.Random(1), folder(), {}
    store = seen.SeenStore(spark, place, buckets=2, merge_after=3)
    keys = lambda names: spark.createDataFrame([(k, n) for k, n in names], "kind string, key string")
    opened = []
    for batch in range(9):
        now = START + timedelta(days=batch)
        after = now - timedelta(days=5)
        asked = {(r.choice(["url", "title"]), f"k{r.randint(0, 60)}") for _ in range(25)}
        want = {k for k in asked if k in memory and memory[k] > after}
        for _ in range(2):  # a repeated batch sees what the first attempt saw
            assert {tuple(x) for x in store.known(keys(asked), batch, after).collect()} == want
            fresh = [(k, n, now) for k, n in asked - want]
            store.add(spark.createDataFrame(fresh, seen.KEYS), batch, after)
        memory |= {(k, n): at for k, n, at in fresh}
        parts = store.alive(batch + 1)
        assert max(sum(p.bucket == b for p in parts) for b in (0, 1)) <= 3
        assert all(p.newest > after for p in parts)
        opened.append(len(store.may_hold(keys([("url", "never seen")]), batch + 1)))
    assert sum(opened) <= 2  # of some forty parts
    some = next(iter(asked - want))
    assert 1 <= len(store.may_hold(keys([some]), 9)) <= 2
    assert store.known(keys([some]).limit(0), 9).count() == 0


def test_a_large_batch_is_not_probed_and_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(seen, "PROBED", 3)
    store, place = seen.SeenStore(spark, folder(), buckets=1), "spark.sql.adaptive.coalescePartitions.enabled"
    given = [("url", f"k{i}", START) for i in range(400)]
    before = spark.conf.get(place)
    spark.conf.set(place, "false")
    try:
        store.add(spark.createDataFrame(given, seen.KEYS), 0)
    finally:
        spark.conf.set(place, before)
    part = spark.read.schema(seen.KEYS).parquet(f"{store.path}/keys/batch=0/bucket=0")
    assert len(part.inputFiles()) > 1 and part.distinct().count() == part.count() == 400
    asked = lambda names: spark.createDataFrame([("url", n) for n in names], "kind string, key string")
    assert store.may_hold(asked(["other"]), 1) == []  # few keys: the filter rules the part out
    many = [f"k{i}" for i in range(0, 800, 2)]
    assert len(store.may_hold(asked([f"x{i}" for i in range(4)]), 1)) == 1  # beyond PROBED a bucket nothing is probed
    assert {r.key for r in store.known(asked(many + many), 1).collect()} == {n for n in many if int(n[1:]) < 400}


def test_arrivals_are_batches_of_several_files(spark):
    from wirepulse.plans import catalog, stream_queries  # noqa: F401

    files = stream_queries.Arrivals(spark.range(40), F.expr("case when id < 30 then 0 when id = 30 then 1 else 3 end"), 4, file_rows=5)
    assert files.files == 2
    got, place = {}, folder()

    def run(batch, number):
        got[number] = sorted(r.id for r in batch.collect())

    for _ in range(2):
        rows = files.land(2)
        assert len(spark.read.schema("id long").parquet(f"{files.folder}/in").inputFiles()) == 2 * files.landed
        rows.writeStream.foreachBatch(run).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    assert got == {0: list(range(30)), 1: [30], 2: [], 3: list(range(31, 40))}


ITEM = "id int, url_key string, title_key string, at timestamp"


def greedy(rows):
    urls, titles, kept = set(), set(), []
    for number, url, title, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        if url not in urls and title not in titles:
            urls.add(url), titles.add(title)
            kept.append(number)
    return kept


def test_two_key_stream_equals_one_greedy_pass(spark):
    r, place, rows = random.Random(6), folder(), []
    for batch in range(5):
        given = [(100 * batch + k, f"u{r.randint(0, 25)}", f"t{r.choice([0, 0, r.randint(1, 25)])}", START + timedelta(minutes=60 * batch + r.randint(0, 59))) for k in range(30)]
        rows += given
        items = stream(spark, place, given, ITEM)
        jobs.dedupe_two_key_stream(items, ["at", "id"], "at", f"{place}/out", f"{place}/state", buckets=2, merge_after=2).awaitTermination()
    got = [x.id for x in spark.read.schema(ITEM).parquet(f"{place}/out/kept").collect()]
    assert sorted(got) == sorted(greedy(rows))


# ---------------------------------------------------------------- cool-down


EVENT = "job string, ts timestamp, id long"


def cooled(rows, window):
    """By a loop, in time order; the least id of equal times."""
    last, out = {}, []
    for job, ts, number in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: (x[1], x[2])):
        if job not in last or ts - last[job] >= window:
            last[job] = ts
            out.append((job, number))
    return sorted(out)


@pytest.mark.parametrize("minutes", [7, 90])
def test_cooldown_over_batches_equals_the_loop(spark, minutes):
    """Out of order within the delay, late beyond it; a window shorter and one longer than the delay."""
    r, place, window = random.Random(minutes), folder(), timedelta(minutes=minutes)
    timely, late, newest = [], [], None
    for batch in range(5):
        given = []
        for k in range(60):
            ts = START + timedelta(minutes=40 * batch + r.randint(-25, 39), milliseconds=r.choice([0, 0, 1]))
            given.append((r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([ts] * 9 + [None]), 100 * batch + k))
        given.append(("hot", START + timedelta(minutes=40 * batch - 90), 100 * batch + 99))
        mark = None if newest is None else newest - timedelta(minutes=30)
        for row in given:
            (late if mark is not None and row[1] is not None and row[1] <= mark else timely).append(row)
        newest = max(x[1] for x in given if x[1] is not None) if newest is None else max([newest, *(x[1] for x in given if x[1] is not None)])
        rows = stream(spark, place, given, EVENT)
        cooling.emit_with_cooldown(rows, "job", "ts", "id", minutes * 60_000, f"{place}/out", f"{place}/state", "30 minutes").awaitTermination()
    got = cooling.all_emissions(spark, f"{place}/out", f"{place}/state", minutes * 60_000).collect()
    assert sorted((x.key, x.tie) for x in got) == cooled(timely, window)
    kept = {x.tie for x in cooling.written(spark, f"{place}/out", late=True).collect()}
    assert kept == {x[2] for x in late if x[0] is not None} and len(kept) >= 4
    # A timer fires for what the watermark has passed: most emissions are written before the stream ends.
    assert cooling.written(spark, f"{place}/out", late=False).count() >= len(got) / 2


def test_waiting_rows_are_pruned():
    need = cooling.CoolDown(100)._needed
    many = {1000 + k: k for k in range(500)}
    assert list(need(dict(many), 950, None)) == [1000, *range(1051, 1500)]
    assert list(need(dict(many), 950, 1000)) == [1000, *range(1100, 1500)]
    assert list(need(dict(many), 1200, None)) == [1000, *range(1100, 1500)]
    assert need({5: 1}, 0, None) == {5: 1}


class Cell:
    """A state variable of one key; ``sent`` counts the bytes written, ``asked`` the values read."""

    def __init__(self):
        self.map, self.sent, self.asked = {}, 0, 0

    def exists(self):
        return bool(self.map)

    def get(self):
        return self.map[()]

    def update(self, value):
        self.map[()] = value

    def clear(self):
        self.map = {}

    def keys(self):
        return iter(list(self.map))

    def getValue(self, key):
        self.asked += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.sent += len(value[0])
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


class Handle:
    def __init__(self):
        self.cells, self.timers = {}, set()

    def getValueState(self, name, *schema):
        return self.cells.setdefault(name, Cell())

    getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("window, gathered", [(7_000, 64), (3_600_000, 1 << 18), (90_000_000, 100)])
def test_waiting_rows_of_a_hot_key_are_neither_read_nor_written_again(monkeypatch, window, gathered):
    """Batches of a key with equal times and null ties; what waits is left alone until the watermark reaches it."""
    monkeypatch.setattr(cooling, "GATHERED", gathered)
    r, hour = np.random.default_rng(window), 3_600_000
    handle, work = Handle(), cooling.CoolDown(window)
    work.init(handle)
    base, newest, mark, rows, late, got = 1_700_000_000_000, 0, 0, {}, [], []
    for batch in range(7):
        n = 30 if batch == 2 else 3000
        ms = base + 20 * hour * batch + r.integers(-40 * hour, 20 * hour, n) // 1000 * 1000
        tie, untied = np.arange(n) + 10_000 * batch, r.random(n) < 0.1
        sent, asked = handle.cells["waiting"].sent, handle.cells["waiting"].asked
        frame = pd.DataFrame({"ms": ms, "tie": np.where(untied, 0, tie), "untied": untied})
        for out in work.handleInputRows(("k",), iter([frame[: n // 3], frame[n // 3 :]]), Mark(mark)):
            late += list(out.itertuples(index=False))
        assert handle.cells["waiting"].asked == asked
        assert handle.cells["waiting"].sent - sent <= n * cooling.ROW.itemsize
        for at, t, null in zip(ms.tolist(), tie.tolist(), untied.tolist()):
            if not mark or at > mark:
                known = rows.get(at, (True, 0))
                rows[at] = min(known, (null, 0 if null else t)) if at in rows else (null, 0 if null else t)
        for due in sorted(t for t in handle.timers if t <= mark):
            handle.timers.remove(due)
            for out in work.handleExpiredTimer(("k",), Mark(mark), None):
                got += list(out.itertuples(index=False))
        newest = max(newest, int(ms.max()))
        mark = newest - 30 * hour
    while handle.timers:
        due = min(handle.timers)
        handle.timers.remove(due)
        for out in work.handleExpiredTimer(("k",), Mark(base + 1000 * hour), None):
            got += list(out.itertuples(index=False))
    want, free = [], None
    for at in sorted(rows):
        if free is None or at >= free:
            want.append((at, rows[at][1], rows[at][0]))
            free = at + window
    assert [(x.ms, x.tie, x.untied) for x in got] == want and not any(x.late for x in got)
    assert late and all(x.late for x in late)
    assert not handle.cells["waiting"].map and not handle.cells["last"].map and not handle.cells["first"].map


# ---------------------------------------------------------------- late rows


def test_timely_and_late_rows_are_the_input(spark):
    r, place, rows = random.Random(2), folder(), []
    timely, late, newest = [], [], None
    for batch in range(5):
        given = [(r.choice(["a", "b", None]), r.choice([START + timedelta(hours=5 * batch + r.randint(-9, 4))] * 9 + [None]), 100 * batch + k) for k in range(40)]
        for row in given:
            (late if newest is not None and row[1] is not None and row[1] <= newest - timedelta(hours=6) else timely).append(row)
        newest = max([x[1] for x in given if x[1] is not None] + ([newest] if newest else []))
        source = stream(spark, place, given, EVENT).withColumn("one", F.lit(1))
        jobs.write_timely(
            source, "ts", 6 * 3_600_000, f"{place}/out", f"{place}/state",
            jobs.add_totals("ts", ["one"]), jobs.add_sessions("job", "ts", 300_000_000), jobs.add_firsts(["job", "ts"], ["ts", "id"], "ts", buckets=2),
        ).awaitTermination()
    read = lambda name: spark.read.schema(EVENT).parquet(f"{place}/out/{name}")
    assert sorted(x.id for x in read("timely").collect()) == sorted(x[2] for x in timely)
    assert sorted(x.id for x in read("late").collect()) == sorted(x[2] for x in late) and len(late) > 10
    days = {}
    for _, ts, _ in timely:
        days[ts and f"{ts:%Y-%m-%d}"] = days.get(ts and f"{ts:%Y-%m-%d}", 0) + 1
    assert {x.day: x.one for x in jobs.timely_totals(spark, f"{place}/out", ["one"]).collect()} == days
    sessions = jobs.latest_sessions(spark, f"{place}/out/sessions", "job", 300_000_000)
    assert sessions.agg(F.sum("n")).first()[0] == sum(x[1] is not None for x in timely)
    firsts = {}
    for job, ts, number in timely:
        firsts.setdefault((job, ts), number)
    assert sorted(x.id for x in read("firsts").collect()) == sorted(firsts.values())


def test_both_keys(spark):
    items = spark.createDataFrame([(1, "u", "t", START), (2, None, "t", None)], ITEM)
    got = dedupe.both_keys(items, F.col("at").alias("when")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("url", "u", START), ("title", "t", START), ("title", "t", None)], key=repr)
