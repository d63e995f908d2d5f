"""Versioned tables: upserts against a dictionary, lost and repeated commits, expiry that leaves files alone."""

import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirepulse.sources import versioned

SCHEMA = "name string, part int, note string, n bigint"
GIVEN = "n bigint, note string, name string, part int, at int, tie int, other string"
START = datetime(2026, 3, 1)


def folder():
    return tempfile.mkdtemp(prefix="spark-versioned-")


def rows_of(spark, path, version=None):
    return sorted((tuple(r) for r in versioned.read_version(spark, path, SCHEMA, version).collect()), key=repr)


def apply(stored, updates, how):
    """The same by a dictionary, one update after the other."""
    for n, note, name, part, *_ in sorted(updates, key=lambda r: (r[4], r[5])):
        key = (name, part)
        if how == "replace" or key not in stored:
            stored[key] = (note, n)
        elif how == "fill":
            old = stored[key]
            stored[key] = (old[0] if note is None else note, old[1] if n is None else n)


def brute_rows(stored):
    return sorted(((*k, *v) for k, v in stored.items()), key=repr)


@pytest.mark.parametrize("how", ["insert", "replace", "fill"])
def test_upserts_equal_a_dictionary(spark, how):
    r, path, stored, history = random.Random(how), folder(), {}, []
    for batch in range(5):
        updates = []
        for tie in range(r.choice([0, 1, 40])):
            name = r.choice(["a", "b", "hot", "hot", "hot", None, f"x{r.randint(0, 30)}"])
            updates.append((r.choice([None, r.randint(0, 99)]), r.choice([None, "", f"t{tie}"]), name, r.choice([None, 1, 2]), r.randint(0, 3), tie, "clash"))
        frame = spark.createDataFrame(updates, GIVEN).repartition(3)
        before = versioned.version_at(spark, path).number
        number = versioned.upsert_table(frame, path, SCHEMA, ["name", "part"], ["at", "tie"], how=how, buckets=4, writer="w", batch=batch)
        assert number == before + bool(updates)
        # The same batch again changes nothing, whatever it holds now.
        assert versioned.upsert_table(frame.limit(1), path, SCHEMA, ["name", "part"], ["at", "tie"], how=how, writer="w", batch=batch) in (number, number + (not updates))
        apply(stored, updates, how)
        if updates:
            history.append((number, brute_rows(stored)))
    for number, want in history:
        assert rows_of(spark, path, number) == want
    assert rows_of(spark, path) == brute_rows(stored)
    assert rows_of(spark, path, 0) == []


def test_lost_commits_and_untouched_parts(spark, monkeypatch):
    path = folder()
    first = spark.createDataFrame([(k, "one", f"k{k}", 1, 0, k, "") for k in range(200)], GIVEN)
    versioned.upsert_table(first, path, SCHEMA, ["name", "part"], ["at"], buckets=16)
    before = versioned.version_at(spark, path)
    assert len(before.parts) == 16
    reader = versioned.read_version(spark, path, SCHEMA)
    few = spark.createDataFrame([(-1, "two", "k5", 1, 0, 0, ""), (-1, "two", "k5", 1, 1, 0, ""), (7, "new", "z", 2, 0, 0, "")], GIVEN)

    def die(*_):
        raise ConnectionError

    with monkeypatch.context() as patch:
        patch.setattr(versioned, "_publish", die)
        with pytest.raises(ConnectionError):
            versioned.upsert_table(few, path, SCHEMA, ["name", "part"], ["at"])
    assert versioned.version_at(spark, path) == before
    versioned.upsert_table(few, path, SCHEMA, ["name", "part"], ["at"])
    after = versioned.version_at(spark, path)
    assert after.buckets == 16 and sum(after.parts[p] != f for p, f in before.parts.items()) <= 2
    assert reader.where("note = 'two'").count() == 0 and reader.count() == 200
    assert versioned.read_version(spark, path, SCHEMA).where("note <> 'one'").count() == 2
    # Upkeep: what only old versions and lost commits have goes, the newest version stays whole.
    want = rows_of(spark, path)
    assert versioned.forget_versions(spark, path, keep=1) == 1
    assert rows_of(spark, path) == want and len(os.listdir(f"{path}/parts")) == 2
    assert rows_of(spark, path, 1) == []


def test_merge_takes_one_shuffle(spark):
    """Rows meet by bucket once; the fold after it needs no other exchange."""
    frame = spark.range(100).selectExpr("id", "cast(id % 4 as string) as _part").repartition("_part").groupBy("_part", "id").agg(F.max("id"))
    assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


LOG = "id int, ts timestamp, text string"


def test_expiry_leaves_other_files_alone(spark):
    path = folder()
    rows = [(k, None if k % 10 == 0 else START + timedelta(hours=k), "x") for k in range(120)]
    for batch in (0, 1, 1):
        part = spark.createDataFrame(rows[batch::2], LOG)
        versioned.append_days(part, path, LOG, "ts", writer="w", batch=batch)

    def files(version):
        out = {}
        for name, place in versioned.version_at(spark, path, version).parts.items():
            where = f"{path}/{place}"
            out[name] = {f: (os.stat(f"{where}/{f}").st_mtime_ns, open(f"{where}/{f}", "rb").read()) for f in os.listdir(where) if f.endswith(".parquet")}
        return out

    old = files(2)
    assert len(old) == 11
    now = START + timedelta(days=3, hours=5)
    number = versioned.retain(spark, path, LOG, "ts", 1, now)
    assert number == 3
    got = {r.id for r in versioned.read_version(spark, path, LOG).collect()}
    assert got == {k for k, ts, _ in rows if ts is None or ts > now - timedelta(days=1)}
    new = files(3)
    same = {n for n in new if n in old}
    assert same == {n for n in old if n.startswith("undated") or n[:10] > "2026-03-03"} and all(new[n] == old[n] for n in same)
    assert len(new) == len(same) + 1
    assert versioned.read_version(spark, path, LOG, 2).count() == 120
    # Nothing to expire, nothing at all, and everything.
    assert versioned.retain(spark, path, LOG, "ts", 30, now) == 3
    assert versioned.retain(spark, folder(), LOG, "ts", 30, now) == 0
    assert versioned.retain(spark, path, LOG, "ts", 0, now + timedelta(days=30)) == 4
    assert {r.ts for r in versioned.read_version(spark, path, LOG).collect()} == {None}
    assert versioned.append_days(spark.createDataFrame([], LOG), folder(), LOG, "ts") == 0
