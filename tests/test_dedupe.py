import random

import pytest

from wirepulse.operators import dedupe


def sequential(rows, urls=(), titles=()):
    urls, titles, kept = set(urls), set(titles), []
    for seq, url, title in sorted(rows):
        if url not in urls and title not in titles:
            kept.append(seq)
            urls.add(url)
            titles.add(title)
    return kept


def case(seed, n=400):
    rnd = random.Random(seed)
    keys = rnd.choice([5, 40, 150])
    return [(i, f"u{rnd.randrange(keys)}", f"t{rnd.randrange(keys)}") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_two_key_rule(spark, seed):
    rows = case(seed)
    frame = spark.createDataFrame(rows, "seq int, url_key string, title_key string")
    got = dedupe.dedupe_two_key(frame, ["seq"])
    assert sorted(r.seq for r in got.collect()) == sequential(rows)


def test_two_key_hot_groups_and_chains(spark):
    # A third of the rows are copies, a third share a URL, the rest alternate.
    rows = [(i, "hot", "hot") for i in range(200)] + [(200 + i, "same", f"t{i}") for i in range(200)]
    rows += [(400 + i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(200)]
    frame = spark.createDataFrame(rows, "seq int, url_key string, title_key string")
    got = dedupe.dedupe_two_key(frame, ["seq"])
    assert sorted(r.seq for r in got.collect()) == sequential(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rows = [(i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(5000)]
    rounds, plain, settled = [], dedupe._earliest, dedupe._settled
    monkeypatch.setattr(dedupe, "_earliest", lambda undecided: rounds.append(1) or plain(undecided))
    monkeypatch.setattr(dedupe, "_settled", lambda undecided: rounds.append(1) or settled(undecided))
    frame = spark.createDataFrame(rows, "seq int, url_key string, title_key string")
    assert sorted(r.seq for r in dedupe.dedupe_two_key(frame, ["seq"]).collect()) == sequential(rows)
    assert len(rounds) == 2


def test_two_key_with_history(spark):
    rows = case(7)
    frame = spark.createDataFrame(rows, "seq int, url_key string, title_key string")
    seen = spark.createDataFrame([("u1", "t2"), ("u3", "t3")], "url_key string, title_key string")
    got = dedupe.dedupe_two_key(frame, ["seq"], seen=seen)
    assert sorted(r.seq for r in got.collect()) == sequential(rows, ["u1", "u3"], ["t2", "t3"])


def test_rejected_rows_reserve_nothing(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y")]
    frame = spark.createDataFrame(rows, "seq int, url_key string, title_key string")
    assert sorted(r.seq for r in dedupe.dedupe_two_key(frame, ["seq"]).collect()) == [1, 3]


def test_bootstrap_gate_still_blocks_later_copies(spark):
    rows = [("s1", 1, "u1", "t1"), ("s1", 2, "u2", "t2"), ("s2", 2, "u3", "t3"), ("s2", 3, "u1", "t9"), ("s2", 4, "u4", "t4")]
    frame = spark.createDataFrame(rows, "source_id string, fetched_at int, url_key string, title_key string")
    kept = dedupe.dedupe_two_key(frame, ["fetched_at", "source_id"])
    got = dedupe.bootstrap_gate(frame, kept)
    assert sorted((r.source_id, r.fetched_at) for r in got.collect()) == [("s1", 2), ("s2", 4)]


def test_duplicate_counts_ignore_repeats_inside_a_payload(spark):
    rows = [("s", 1, "u1"), ("s", 1, "u1"), ("s", 2, "u1"), ("s", 2, "u2")]
    frame = spark.createDataFrame(rows, "source_id string, payload int, url_key string")
    kept = spark.createDataFrame([("s", 1, "u1"), ("s", 2, "u2")], frame.schema)
    got = dedupe.duplicate_counts(frame, kept, ["source_id", "payload"])
    assert sorted((r.payload, r.n_items, r.duplicates) for r in got.collect()) == [(1, 1, 0), (2, 2, 1)]


def test_a_chain_keeps_a_small_size_estimate(spark, monkeypatch):
    """Estimates that multiply from join to join fill the driver before the chain ends."""
    rows = [(i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(600)]
    sizes, settled = [], dedupe._settled

    def noted(undecided):
        winners = settled(undecided)
        sizes.append(int(str(winners._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return winners

    monkeypatch.setattr(dedupe, "_settled", noted)
    frame = spark.createDataFrame(rows, "seq int, url_key string, title_key string")
    assert sorted(r.seq for r in dedupe.dedupe_two_key(frame, ["seq"]).collect()) == sequential(rows)
    assert sizes and max(sizes) < 10_000_000


def test_chain_ends_of_trees(spark):
    rnd = random.Random(3)
    to = {i: i - 1 if i % 90 else rnd.randrange(i) for i in range(1, 500) if i % 200}
    got = dedupe.chain_ends(spark.createDataFrame([(n, t, n % 3 != 0) for n, t in to.items()], "node long, to long, opposite boolean"))
    want = {}
    for node in to:
        at, opposite = node, False
        while at in to:
            opposite, at = opposite != (at % 3 != 0), to[at]
        want[node] = (at, opposite)
    assert {r.node: (r.to, r.opposite) for r in got.collect()} == want and got.count() == len(want)


def test_rounds_run_over_numbers(spark, monkeypatch):
    """The rounds shuffle no strings; a null key is shared with no other row."""
    types, earliest = [], dedupe._earliest
    monkeypatch.setattr(dedupe, "_earliest", lambda undecided: types.append(dict(undecided.dtypes)) or earliest(undecided))
    rows = [(1, None, "x"), (2, None, "y"), (3, "a", None), (4, "b", "y"), (5, "b", "z"), (6, None, None), (7, "a", "w")]
    frame = spark.createDataFrame(rows, "seq int, url_key string, title_key string")
    assert sorted(r.seq for r in dedupe.dedupe_two_key(frame, ["seq"]).collect()) == [1, 2, 3, 5, 6]
    assert types and all(t == {"url_key": "bigint", "title_key": "bigint", "node": "bigint"} for t in types)
