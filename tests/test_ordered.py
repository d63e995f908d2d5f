import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirepulse.operators import deals as dl, ordered

START = datetime(2024, 1, 1)


def log(seed, n=600):
    """A log in which one key holds most rows and many times repeat."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(8)}"
        rows.append((key, START + timedelta(seconds=rnd.randrange(20_000)), i, rnd.random() < 0.5))
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def data(spark, request):
    rows = log(request.param)
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, id int, bad boolean")


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_previous(data):
    rows, frame = data
    want = {}
    for group in by_key(rows).values():
        for before, row in zip([None, *group], group):
            want[row[2]] = before and before[2]
    got = ordered.previous(frame, ["k"], "ts", "id", {"before": "id"})
    assert {r.id: r.before for r in got.collect()} == want


def test_failure_streaks(data):
    rows, frame = data
    want = {}
    for group in by_key(rows).values():
        streak, since = 0, None
        for _, ts, i, bad in group:
            streak = streak + 1 if bad else 0
            since = (since if streak > 1 else ts) if bad else None
            want[i] = (streak, since)
    got = ordered.failure_streaks(frame, ["k"], "ts", "id", F.col("bad"))
    assert {r.id: (r.streak, r.streak_since) for r in got.collect()} == want


def test_long_streak_crosses_slices(spark):
    rows = [("k", START + timedelta(seconds=i), i, i != 5) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp, id int, bad boolean")
    got = {r.id: r.streak for r in ordered.failure_streaks(frame, ["k"], "ts", "id", F.col("bad")).collect()}
    assert got[4] == 5 and got[5] == 0 and got[299] == 294


def test_sessions(data):
    rows, frame = data
    want = set()
    for key, group in by_key(rows).items():
        run = [group[0]]
        for row in group[1:]:
            if (row[1] - run[-1][1]).total_seconds() > 60:
                want.add((key, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(row)
        want.add((key, run[0][1], run[-1][1], len(run)))
    got = ordered.sessions(frame, ["k"], "ts", "id", 60_000)
    assert {(r.k, r.started_at, r.ended_at, r.n) for r in got.collect()} == want


def test_numbered(data):
    rows, frame = data
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    assert {r.id: r.rn for r in ordered.numbered(frame, "ts", "id").collect()} == want


@pytest.mark.parametrize("n", [1, 4, 10, 999])
def test_nearest_rank(spark, n):
    rnd = random.Random(n)
    values = [rnd.choice([rnd.randrange(50), rnd.randrange(10**7), rnd.randrange(2**45)]) for _ in range(n)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (-5,)], "v bigint")
    row = ordered.nearest_rank(frame, "v", (50, 95, 0, 100)).first()
    ordered_values = sorted(values)
    rank = lambda p: ordered_values[max(-(-p * n // 100) - 1, 0)]
    assert (row["count"], row["min"], row["max"]) == (n, ordered_values[0], ordered_values[-1])
    assert [row[f"p{p}"] for p in (50, 95, 0, 100)] == [rank(p) for p in (50, 95, 0, 100)]


def test_nearest_rank_of_nothing(spark):
    row = ordered.nearest_rank(spark.createDataFrame([], "v bigint"), "v", (50,)).first()
    assert row.asDict() == {"count": 0, "min": None, "max": None, "p50": None}


def fold(group, window):
    last, out = None, []
    for _, ts, i, _ in group:
        emit = last is None or (ts - last).total_seconds() >= window
        last = ts if emit else last
        out.append((i, emit, last))
    return out


@pytest.mark.parametrize("window", [1, 97, 1800, 86_400])
def test_cooldown(data, window):
    rows, frame = data
    want = {i: (emit, last) for group in by_key(rows).values() for i, emit, last in fold(group, window)}
    got = dl.cooldown(frame, "k", "ts", "id", F.lit(window * 1000))
    assert {r.id: (r.emitted, r.emit_ts) for r in got.collect()} == want


def test_cooldown_is_not_a_lag(spark):
    rows = [("k", START + timedelta(seconds=s), s) for s in (0, 5, 9, 10, 19, 20, 25)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp, id int")
    got = dl.cooldown(frame, "k", "ts", "id", F.lit(10_000)).where("emitted")
    assert sorted(r.id for r in got.collect()) == [0, 10, 20]


def test_row_numbers_of_a_hot_key_span_slices(spark):
    """One key with all but a few rows, and rows without a key."""
    given = [("hot" if k % 50 else None, k * 7919 % 1000) for k in range(1000)]
    rows = spark.createDataFrame(given, "k string, t long")
    placed = ordered.sliced_by(rows, "k", "t")
    assert placed.where("k = 'hot'").select("_slice").distinct().count() > 1
    got = ordered.numbered_within(rows, F.col("k"), "t").collect()
    want = {(k, t): n for key in ("hot", None) for n, (k, t) in enumerate(sorted((g for g in given if g[0] == key), key=lambda g: g[1]), 1)}
    assert {(x.k, x.t): x.rn for x in got} == want and len(got) == 1000


def test_emissions_keep_a_small_size_estimate(spark):
    from wirepulse.operators import deals

    times = sorted({(k, (i * i * 37 + i * 11) % 9000) for k in ("a", "b") for i in range(300)})
    got = deals.emissions(spark.createDataFrame([(k, 50, t) for k, t in times], "k string, w long, t long"))
    want, last = [], {}
    for k, t in times:
        if k not in last or t >= last[k] + 50:
            last[k] = t
            want.append((k, 50, t))
    assert sorted(map(tuple, got.collect())) == want
    assert int(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10_000_000
