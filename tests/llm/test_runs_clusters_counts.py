"""Periodic runs, centroid clusters and token counts: against brute force and on awkward rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row

from wirepulse.llm import centroids, periodic, token_counts

DOCS = "doc_id long, text string, id string, runs string, point int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "clash", "clash", 5) for k, t in rows], DOCS).repartition(3)


# ---------------------------------------------------------------- op11


def brute_runs(words, least=24, times=3):
    """Every maximal stretch of every period, minus those with a smaller one."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            piece = words[start:j]
            smaller = any(all(piece[x] == piece[x - p] for x in range(p, length)) for p in range(1, q))
            if length >= max(least, times * q) and not smaller:
                found.append((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_text(r, n):
    letters = [b"a", b"b", b"c", b"dd", b"e%d" % r.randint(0, 3)][: r.randint(1, 5)]
    words = []
    while len(words) < n:
        kind = r.random()
        if kind < 0.55:
            piece = [r.choice(letters) for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 20, 31, 33, 40]))]
            if r.random() < 0.3:
                piece = piece * r.randint(2, 3) + [r.choice(letters)]
            words += (piece * r.randint(2, 6))[: r.randint(1, 150)]
        else:
            words += [r.choice(letters) for _ in range(r.randint(0, 20))]
        if words and r.random() < 0.3:
            words[r.randrange(len(words))] = r.choice(letters)
    return words[:n]


def test_runs_equal_brute_force():
    r, seen, scales = random.Random(3), 0, set()
    for _ in range(500):
        words = periodic_text(r, r.choice([0, 5, 23, 24, 40, 90, 200, 260]))
        want = brute_runs(words)
        assert periodic.find_runs(words) == want
        seen += len(want)
        scales |= {(q > 8) + (q > 16) + (q > 32) for _, _, q in want}
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert periodic.collapse(words, want) == [w for i, w in enumerate(words) if i not in dropped]
    assert seen > 200 and scales == {0, 1, 2, 3}
    # Other thresholds, the longest possible repeats, and frequent words without runs.
    words = periodic_text(r, 300)
    assert periodic.find_runs(words, 30, 4) == brute_runs(words, 30, 4)
    assert periodic.find_runs([b"x"] * 5000) == [(0, 5000, 1)]
    assert periodic.find_runs([b"the", *(b"%d" % k for k in range(9))] * 3 + [b"end"]) == [(0, 30, 10)]
    long = [b"w" if k % 2 else b"%d" % k for k in range(40_000)]
    assert periodic.find_runs(long) == []
    with pytest.raises(ValueError):
        periodic.find_runs(words, 10, 3)


def test_template_lines_stay_cheap():
    """Five thousand lines that differ in one word have quadratically many equal windows, but no run."""
    line = [b"every", b"line", b"says", b"the", b"same", b"words", b"in", b"the", b"same", b"order", b"again", b"but", b"for", b"its", b"number", b"here", b"and", b"ends"]
    words = [w for k in range(5000) for w in [*line, b"%d" % k]]
    assert periodic.find_runs(words) == []


def brute_digest(name, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(name).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha(b"".join(b"%d,%d,%d\n" % x for x in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_run_query_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(k, b" \n".join(periodic_text(r, r.randint(0, 120))).decode()) for k in range(150)]
    rows += [(-7, "a b " * 30), (10, "a\x1cb c x " * 40), (10, "a\x1cb c x " * 40), (500, None), (501, ""), (502, " \t\x0b"), (503, "é " * 80)]
    result = periodic.run_digest(periodic.periodic_runs(frame(spark, rows), rewrite=periodic.planted_period))
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted((x.doc_id, tuple(x[n] for n in names)) for x in result.collect())
    assert got == sorted((k, brute_digest(k, t)) for k, t in rows)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 5
    nameless = periodic.periodic_runs(frame(spark, [(None, "a b " * 30)]), rewrite=periodic.planted_period).collect()
    assert nameless == [Row(id=None, n_words=60, runs=[Row(start=0, length=60, period=2)], collapsed="a b")]
    assert periodic.run_digest(periodic.periodic_runs(frame(spark, rows).limit(0))).count() == 0


# ---------------------------------------------------------------- op12


def brute_clusters(rows, k, rounds, size, scale=64):
    kept = [(v, [int(np.floor(scale * float(x))) for x in e]) for v, e in rows if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e)]
    starts = sorted(((hashlib.sha256(f"1:{v}".encode()).hexdigest(), v, p) for v, p in kept if v is not None))[:k]
    middle = [list(p) for _, _, p in starts]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda p: min((square(p, c), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(place(p)[1], []).append(p)
        for n, members in groups.items():
            middle[n] = [sum(x) // len(members) for x in zip(*members)]
    out = [(v, place(p)[1], place(p)[0]) for v, p in kept]
    sums = {}
    for _, n, d in out:
        sums[n] = sums.get(n, 0) + d
    return [(v, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, middle[n])).encode()).hexdigest()) for v, n, d in out]


VECTORS = "vec_id long, embedding array<float>, label int, point string, id int"


def vectors(spark, rows):
    return spark.createDataFrame([(v, e, 1, "clash", 2) for v, e in rows], VECTORS).repartition(3)


def order(row):
    return tuple((x is not None, x) for x in row)


def test_clusters_equal_brute_force(spark):
    r = np.random.default_rng(2)
    middles = r.normal(size=(5, 8)) * 3
    rows = [(k, [float(x) for x in np.float32(middles[k % 5] + r.normal(size=8))]) for k in range(300)]
    rows += [(1000 + k, rows[7][1]) for k in range(60)]  # one vector many times: equal distances, perhaps equal centroids
    rows += [(7, rows[7][1]), (None, rows[3][1]), (2000, None), (2001, []), (2002, [0.0] * 7), (2003, [float("nan")] * 8)]
    rows += [(2004, [None] * 8), (2005, [float("inf")] + [0.0] * 7), (2006, [-0.001] * 8), (2007, [1e6] * 8)]
    got = [tuple(x) for x in centroids.cluster_report(vectors(spark, rows), k=6, rounds=3, size=8).collect()]
    want = brute_clusters(rows, 6, 3, 8)
    assert sorted(got, key=order) == sorted(want, key=order)
    # Fewer vectors than centroids, copies only, and none at all.
    for few in (rows[:3], rows[300:340], [(None, rows[0][1])] * 2):
        got = [tuple(x) for x in centroids.cluster_report(vectors(spark, few), k=6, size=8).collect()]
        if few[0][0] is not None:
            assert sorted(got) == sorted(brute_clusters(few, 6, 3, 8))
        assert len(got) == len(few)
    assert centroids.cluster_report(vectors(spark, rows).limit(0)).count() == 0


def test_bounds_never_exceed_distances():
    r = np.random.default_rng(5)
    for scale in (1, 30, 10_000, 1 << 26):
        points, middle = (r.integers(-scale, scale + 1, (n, 16)) for n in (400, 9))
        points[:20], points[20:40] = middle[0], middle[1] + 1
        pivots = np.concatenate([middle[:3], points[50:52], middle[:1]])
        near = np.sqrt(centroids.squares(points[:, None], pivots[None]).astype(float))
        low = centroids.lower_bounds(near, middle, pivots)
        true = centroids.squares(points[:, None], middle[None])
        assert (low * low <= true).all()
        numbers, best, measured = centroids.nearest(points, near, middle, pivots)
        assert (numbers == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()
    # On vectors in groups most distances are never measured.
    middle = r.integers(-1000, 1000, (16, 16))
    points = middle[r.integers(0, 16, 3000)] + r.integers(-20, 20, (3000, 16))
    near = np.sqrt(centroids.squares(points[:, None], middle[None, :4]).astype(float))
    assert centroids.nearest(points, near, middle, middle[:4])[2] < 3000 * 16 / 3


# ---------------------------------------------------------------- op13


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(token_counts.default_model())


def mixed_text(r, n):
    parts = ["the ", "Übergrößen ", "  ", "\n\n", "\t", "文字列", "aaaaaaaa", "=" * 9, "▁", " ▁▁ ", "😀", "𝒳", "0123456789abcdef", "http://x.y/z?q=1", "\0", "é", "—", "　", "<s>", "<unk>", "<0x41>"]
    text = ""
    while len(text) < n:
        text += r.choice(parts) * r.choice([1, 1, 1, 2, 7]) + r.choice(["", " ", "x", "ing "])
    return text[:n]


def test_spliced_counts_equal_the_library(counter):
    assert counter.splices
    r = random.Random(4)
    for n in range(400):
        text = mixed_text(r, r.randint(0, 900))
        chunk = r.choice([8, 30, 64, 200])
        got, chunks = counter.count(text, chunk, r.choice([2, 5, 16, 60]))
        assert got == len(counter.library.encode(text)), repr(text)
        assert (chunks > 1) == (len(text) > chunk)
    # No two chunks agree anywhere in these, or only at odd places; the number of chunks shows the widening.
    for text in ("a" * 3000, "=" * 3001, "ab" * 2000, " " * 2999, "😀" * 1500, "▁" * 2000, "x" + "1" * 2500 + " y" * 40):
        got, chunks = counter.count(text, 100, 10)
        assert got == len(counter.library.encode(text))
        assert chunks < 200


def test_token_counts_of_awkward_rows(spark, counter):
    r = random.Random(9)
    big = mixed_text(r, 3 * token_counts.CHUNK + 17)
    rows = [(1, None), (2, ""), (3, " "), (3, "repeat"), (3, "repeat"), (None, "nameless"), (4, big), (5, "word " * 4096), (6, "<s> </s> <|endoftext|>")]
    got = token_counts.token_counts(frame(spark, rows)).collect()
    size = lambda t: len(counter.library.encode(t or ""))
    want = [(k, len((t or "").encode()), size(t), size(t) > 4096) for k, t in rows]
    assert sorted(((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in got), key=order) == sorted(want, key=order)
    assert {x.doc_id for x in got if x.n_chunks > 1} == {4}
    assert token_counts.token_counts(frame(spark, rows).limit(0)).count() == 0
    import public_tokenizers

    whole = token_counts.token_counts(frame(spark, rows[4:6]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {x.n_tokens for x in whole} == {len(token_counts.counter(public_tokenizers.path("byte_bpe_50k.json")).library.encode(t).ids) for t in ("repeat", "nameless")}
