"""URL filter, secrets, quality, licenses, toxicity: against brute force and on awkward rows."""

import base64
import hashlib
import json
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from wirepulse.llm import bloom, licenses, quality, secrets, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_id string, row_text int"
AWKWARD = [None, "", " \n\t ", "word", "Ünïcödé ñ 文字", "a b " * 3000, "x" * 200_000, "MIT License", "MIT License"]


def frame(spark, texts):
    rows = [(None if k == 3 else k, t, "en", None, 1, "clash", 5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# ---------------------------------------------------------------- op1


def plain_verdict(url, listed):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(brute.LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[1:] if fits else (None, None)
    return host, path, rule, verdict or ("block" if listed else "allow")


def test_urls(spark):
    given = [
        "http://A.Example.net/en/x?utm_source=q", "https://example.net", "https://example.net/", "http://notnet/en/", "http://www.a.org/fr/1/?b=2&a=1#z",
        "ftp://a.org/fr?x", "http://example.com/de/", "http://x.example.com/de", "no scheme", "", None, "http://", "http://www.spam.com/p/",
        "https://spam.com/p?ref=1", "https://spam.com/p?id=2", "http://a://b/c", "http://www.spam.com/p/",
    ]
    pages = spark.createDataFrame([(k, u, "x", u) for k, u in enumerate(given)], "page_id long, url string, html string, host string").repartition(3)
    listed = spark.createDataFrame([("spam.com/p",), ("spam.com/p",), (None,)], "canonical string")
    for blocks in (1, None, 1 << 19):  # one that lets everything through, one by length, one too wide to be sent
        got = {r.page_id: r for r in urls.filter_urls(pages, listed, blocks=blocks).collect()}
        assert len(got) == len(given)
        for k, url in enumerate(given):
            row = got[k]
            is_listed = url in ("http://www.spam.com/p/", "https://spam.com/p?ref=1")
            assert row.listed == is_listed
            assert (row.host, row.path, row.rule, row.verdict) == plain_verdict(url, is_listed), url
    assert got[4].canonical == "a.org/fr/1?a=1&b=2" and got[10].canonical is None
    assert urls.filter_urls(pages.limit(0), listed.limit(0)).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    built = bloom.build(keys, F.col("k"), 64)
    assert built.count() <= 64
    found = bloom.probe(spark.range(1000).select(F.col("id").cast("string").alias("k")), F.col("k"), built, "hit", 64)
    assert found.where("hit and int(k) < 500").count() == 500


def test_bloom_follows_the_number_of_keys(spark):
    assert [bloom.sized(n) for n in (0, 1, 1024, 1025, 1 << 20, (1 << 20) + 1)] == [64, 64, 64, 128, 1 << 16, 1 << 17]
    keys, blocks = spark.range(20_000).select(F.col("id").cast("string").alias("k")), bloom.sized(20_000)
    others = spark.range(20_000, 60_000).select(F.col("id").cast("string").alias("k"))
    assert bloom.probe(others, F.col("k"), bloom.build(keys, F.col("k"), blocks), "hit", blocks).where("hit").count() < 400


def test_url_filter_stays_native(spark):
    pages = spark.createDataFrame([(1, "http://a", "b")], "page_id long, url string, html string")
    plan = urls.filter_urls(pages, urls.listed_urls(pages))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# ---------------------------------------------------------------- op5


def der(tag, body):
    size = len(body).to_bytes(1 if len(body) < 256 else 2, "big")
    head = size if len(body) < 128 else bytes([0x80 + len(size)]) + size
    return bytes([tag]) + head + body


def rsa_key():
    return der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1]) * n) for n in (129, 3, 128, 64, 64, 64, 64, 64)))


def b64url(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def plain_base(text):
    spans = [("assign", *m.span()) for m in re.finditer(
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_structures():
    key = base64.b64encode(rsa_key()).decode()
    armored = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(key[k : k + 64] for k in range(0, len(key), 64)) + "\n-----END RSA PRIVATE KEY-----"
    token = ".".join((b64url(b'{"alg":"HS256","typ":"JWT"}'), b64url(b'{"sub":"1"}'), b64url(b"s" * 32)))
    ssh = base64.b64encode(b"".join(len(p).to_bytes(4, "big") + p for p in (b"ssh-ed25519", b"k" * 32))).decode()
    kinds = lambda text: [k for k, _, _ in secrets.find_secrets(text) if k not in ("assign", "access", "hex")]
    assert kinds(f"see {key} end") == ["key"]
    assert "pem" in kinds(f"x\n{armored}\ny")
    assert kinds(f"bearer {token}.") == ["jwt"]
    assert kinds(f"ssh-ed25519 {ssh} me@x") == ["key"]
    assert kinds(f"k {rsa_key().hex()} z") == ["hexkey"]
    broken = bytearray(rsa_key())
    broken[5] ^= 3
    assert kinds(base64.b64encode(bytes(broken)).decode()) == []
    assert kinds(".".join((b64url(b'{"typ":"JWT"}'), b64url(b"{}"), b64url(b"s" * 32)))) == []
    assert kinds("A" * 400) == [] and kinds("-----BEGIN X-----" * 2000) == []
    # Glued to other characters of the alphabet, on either side; wrapped without armor; other white space after the brace.
    for glued in (f"path/{key.rstrip('=')}", f"name_{key.rstrip('=')}", f"key-{ssh.rstrip('=')}", f"x/{key.rstrip('=')}/tail"):
        text = f"see {glued} end"
        (span,) = [(a, b) for k, a, b in secrets.find_secrets(text) if k == "key"]
        assert text[span[0] : span[1]].rstrip("=") in (key.rstrip("="), ssh.rstrip("="))
    for width, gap in ((64, "\n"), (76, "\r\n"), (64, "\n  ")):
        wrapped = gap.join(key[k : k + width] for k in range(0, len(key), width))
        text = f"begins here:\n{wrapped}\nnext line of prose"
        assert [text[a:b] for k, a, b in secrets.find_secrets(text) if k == "key"] == [wrapped]
        assert kinds(text.replace(wrapped, wrapped.replace("M", "N", 1))) == []
    for space in (b"{\t", b"{\r\n", b"{ ", b"{\n"):
        other = ".".join((b64url(space + b'"alg":"HS256"}'), b64url(b'{"sub":"1"}'), b64url(b"s" * 32)))
        assert kinds(f"bearer {other}.") == ["jwt"]
    assert kinds("every.day.counts eyes.are.open " * 50) == []
    assert kinds("MI" * 50_000) == [] and kinds("AAAA" * 50_000) == [] and kinds(("q" * 64 + "\n") * 2000) == []


def test_secrets(spark):
    given = AWKWARD + [
        'PassWord = "abc123" token:xy api-key=zzzzzzz API_KEY=zzzzzzz', "AKIA" + "A" * 16 + " AKIAB", "0" * 23 + " " + "f" * 24 + "A" + "0" * 30,
        "secret=secret=secret=abcdef to\u212aen=abcdefgh pa\u017fsword=abcdefgh", "ñ" * 9 + "passwd:'p4ssw0rd'",
    ]
    got = {r.spans: r for r in secrets.scan_secrets(frame(spark, given)).collect()}
    rows = secrets.scan_secrets(frame(spark, given)).collect()
    assert len(rows) == len(given)
    for k, text in enumerate(given):
        if k == 3:
            continue
        row = next(r for r in rows if r.doc_id == k)
        base = plain_base(text or "")
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in base)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[0] == n for s in base) for n in ("assign", "access", "hex"))
    assert len(got) > 3
    assert secrets.scan_secrets(frame(spark, given).limit(0)).count() == 0


# ---------------------------------------------------------------- op6


def test_quality_counts(spark):
    r = random.Random(3)
    given = AWKWARD + [" ".join(r.choice("ab cd\n ef| g# the".split(" ")) for _ in range(r.randint(0, 300))) for _ in range(40)]
    ratios = json.dumps([0.0] * 16)
    rows = quality.judge(frame(spark, given), ratios, buckets=16).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == len(given)
    for row in rows:
        counts = brute.quality_counts(given[3 if row.doc_id is None else row.doc_id])
        assert tuple(row)[1:6] == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert row.base_failed == failed and row.kept == (not failed)


def test_quality_ratio(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(("aa", "bb", "cc") if k % 2 else ("xx", "yy", "zz")) for _ in range(60)) for k in range(20)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1, 9, 2)] + [(1, 1, 0), (None, 1, 0), (2, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    size = 64
    ratios = quality.fit(docs, labels, buckets=size)
    grams = [[brute.spark_hash(w) for w in (t or "").split()] for t in texts]
    buckets = [[h % size for h in g] + [brute.spark_hash(a, b) % size for a, b in zip(g, g[1:])] for g in grams]
    import math

    corpus, target = [0] * size, [0] * size
    for k, each in enumerate(buckets):
        for b in each:
            corpus[b] += 1
            target[b] += k in (1, 3, 5, 7)
    n, m, s = sum(corpus), sum(target), quality.SMOOTHING
    want = [
        math.log((target[b] + s * m / n) / (m + s * size * m / n)) - math.log((max(corpus[b] - 1, 0) + s) / (n + s * size)) for b in range(size)
    ]
    assert json.loads(ratios) == pytest.approx(want, abs=1e-9)
    rows = {r.doc_id: r for r in quality.judge(docs, ratios, buckets=size).select("row.doc_id", "log_ratio", "kept").collect()}
    for k, each in enumerate(buckets):
        if each:
            assert rows[k].log_ratio == pytest.approx(sum(want[b] for b in each) / len(each), abs=1e-9)
        else:
            assert rows[k].log_ratio is None and not rows[k].kept
    assert all(rows[k].kept == bool(k % 2) or brute.quality_counts(texts[k])[4] * 2 > 60 for k in range(20))
    assert set(json.loads(quality.fit(docs, labels.limit(0), buckets=size))) == {0.0}
    assert quality.judge(docs.limit(0), ratios, buckets=size).count() == 0


def test_quality_stays_native(spark):
    docs = frame(spark, ["a b c"])
    plan = quality.judge(docs, json.dumps([0.0] * 16), buckets=16).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|Pandas", plan)


def test_quality_model_is_not_in_the_plan(spark):
    """Every rendering of a plan copies its literals; with 65,536 numbers that fills the driver."""
    docs = frame(spark, ["a b c"])
    plans = [quality.judge(docs, json.dumps([0.5] * size), buckets=size)._jdf.queryExecution().toString() for size in (16, 1 << 12)]
    assert len(plans[1]) < len(plans[0]) + 500


# ---------------------------------------------------------------- op8


def test_license_rules():
    rules = licenses.default_rules()
    assert len(rules) >= 200 and len({r.name for r in rules}) > 0.95 * len(rules)
    assert all(r.keyword.strip() for r in rules)
    scan = licenses.scanner(rules)
    labels = lambda text: {d["label"] for d in scan(text)[2]}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels("under the terms of the GNU General Public License, version 3 or (at your option) any later version") == {"gpl-3-or-later"}
    assert labels("SPDX-License-Identifier: MIT") == {"mit"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"}
    assert labels("the committee met on an apache helicopter") == set()
    assert labels("run apache2 and version 2 or later of it") == set()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2-or-later"),
        ("// SPDX-License-Identifier: GPL-3.0-or-later OR MIT", "gpl-3-or-later mit"),
        ("SPDX-License-Identifier: GPL-2.0+", "gpl-2-or-later"),
        ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1"),
        ("SPDX-License-Identifier: (Apache-2.0 WITH LLVM-exception) AND BSD-3-Clause", "apache-2.0 llvm-exception bsd-3-clause"),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "gpl-2 classpath-exception-2.0"),
        ("SPDX-License-Identifier: ISC", "isc"),
        ("SPDX-License-Identifier: ISC OR 0BSD OR CC-BY-SA-4.0 OR CC0-1.0", "isc bsd-0-clause cc-by-sa-4.0 cc0-1.0"),
        ("SPDX-License-Identifier: LicenseRef-Own-Terms OR MIT", "mit"),
        ("SPDX-License-Identifier: MIT this and apache met", "mit"),
        ("Licensed under the GNU General Public License version 3 or later.", "gpl-3-or-later"),
        ("GNU Lesser General Public License v2.1+", "lgpl-2.1-or-later"),
        ("This is GPLv3 software", "gpl-3"),
        ("GPLv2+", "gpl-2-or-later"),
        ("LGPLv2.1 or any later version", "lgpl-2.1-or-later"),
        ("under GPL-3.0 only", "gpl-3"),
        ("GPL3", "gpl-3"),
        ("released under the ISC terms", "isc"),
        ("Mozilla Public License 2", "mpl-2.0"),
        ("gpl 30 and gplx3", ""),
    ],
)
def test_license_forms(text, expected):
    scan = licenses.scanner(licenses.default_rules())
    for around in ("{}", "some words before {} \n and more after"):
        assert {d["label"] for d in scan(around.format(text))[2]} == set(expected.split())


def test_suppression():
    r = random.Random(9)
    for _ in range(300):
        found = [(a := r.randint(0, 12), a + r.randint(1, 6), r.choice((10, 20, 30)), r.choice("xy"), str(k)) for k in range(r.randint(0, 8))]
        kept = licenses.suppress(found)
        for one in found:
            inside = any(
                o is not one and o[0] <= one[0] and o[1] >= one[1] and o[2] >= one[2] and ((o[0], -o[1], -o[2], o[3], o[4]) < (one[0], -one[1], -one[2], one[3], one[4]))
                for o in found
            )
            assert (one in kept) == (not inside)


def test_licenses(spark):
    given = AWKWARD + ["The MIT-License and cc.by cc by; GNU General Public\nLicense", "mit license mit license", "ApAcHe LiCeNsE é", "commit license summit", "1+ 2+ x 3+y 4+ cc by 5+", "6+"]
    rows = licenses.license_report(frame(spark, given)).collect()
    assert len(rows) == len(given)
    for row in rows:
        text = given[3 if row.doc_id is None else row.doc_id] or ""
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(brute.LOWER)) if w]
        places = []
        for phrase, label in licenses.BASE:
            parts = phrase.split()
            places += [(k, label) for k in range(len(words)) if words[k : k + len(parts)] == parts]
        assert row.n_words == len(words) and row.n_base == len(places)
        assert (row.first_word, row.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1
    assert licenses.license_report(frame(spark, given).limit(0)).count() == 0


# ---------------------------------------------------------------- op10


def test_segments():
    import numpy as np

    r = random.Random(11)
    for _ in range(400):
        scores = [r.choice((-3, -2, -1, 1, 2, 4)) + r.random() / 7 for _ in range(r.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(scores))] == brute.best_segments(scores)
    many = np.tile([1.0, -0.5], 100_000)
    assert len(toxicity.segments(many)) == 1


def test_toxicity(spark):
    r = random.Random(2)
    words, bad = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}".replace("w", "or") for k in range(200)], ["vilest", "foulmouth", "scumbag"]
    texts = []
    for k in range(400):
        text = [r.choice(words) for _ in range(r.randint(30, 120))]
        if k % 4 == 0:
            for _ in range(3):
                text.insert(r.randint(0, len(text)), r.choice(bad))
        texts.append(" ".join(text))
    docs = frame(spark, texts + AWKWARD)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400) if k != 3] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = [x for x in toxicity.toxicity_report(docs, labels).collect()]
    assert len(rows) == len(texts) + len(AWKWARD)
    judged = {x.doc_id: x for x in rows if x.doc_id is not None and x.doc_id < 400}
    import zlib

    for k, row in judged.items():
        assert row.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert row.predicted == int(row.score >= 0.7)
    held = [row for row in judged.values() if row.held_out]
    assert sum(row.predicted == (row.doc_id % 4 == 0) for row in held) / len(held) > 0.95
    other = {x.doc_id: x for x in toxicity.toxicity_report(docs, labels.where(~toxicity.held_out(F.col("doc_id")))).collect()}
    assert all(other[k].score == row.score for k, row in judged.items())
    assert toxicity.toxicity_report(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
