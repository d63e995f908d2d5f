"""Mixing, tiling, archives, token files, near duplicates, pipeline: against brute force and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wirepulse.llm import mixing, neardup, rows, shingles, tiling, tokens, warc
from wirepulse.llm.files import output_folder, resolve

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, key int"


def frame(spark, texts, sources=None):
    given = [(k, t, "en", sources[k] if sources else "s", 1, "clash", "clash", 5) for k, t in enumerate(texts)]
    return spark.createDataFrame(given, DOCS).repartition(3)


# ---------------------------------------------------------------- shingles


def test_word_hashes():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("ab cA\n\t é文. ") for _ in range(r.randint(0, 60)))
        hashes, starts, ends, data = shingles.words(text, shingles.BLANKS)
        want = brute.BLANK_WORD.findall(text.translate(brute.LOWER))
        assert [data[s:e].decode() for s, e in zip(starts, ends)] == want
        assert len(set(zip(hashes.tolist(), want))) == len(set(want)) == len(set(hashes.tolist()))
    piece, shingles.PIECE = shingles.PIECE, 64
    try:
        text = " ".join("w" * r.randint(1, 200) + str(k) for k in range(100))
        small = shingles.words(text, shingles.BLANKS)
    finally:
        shingles.PIECE = piece
    whole = shingles.words(text, shingles.BLANKS)
    assert all((a == b).all() for a, b in zip(small[:3], whole[:3]))


# ---------------------------------------------------------------- op2


def test_mixing(spark):
    r = random.Random(5)
    texts = [" ".join("w" for _ in range(r.randint(0, 30))) for _ in range(600)] + [None, "", " "]
    sources = ["big" if k % 3 else ("small" if k % 9 else None) for k in range(len(texts))]
    docs = frame(spark, texts, sources)
    sizes = [len((t or "").split()) for t in texts]
    for evenness, repeats, budget in ((0.5, None, None), (1.0, 2.0, None), (None, None, 3000), (0.8, 4.0, 20_000)):
        used = mixing.mix(docs, evenness=evenness, repeats=repeats, budget=budget).select("row.doc_id", "source", "block", "place", "n_tokens", "weight", "mix_key").collect()
        totals = Counter()
        for s, n in zip(sources, sizes):
            totals[s] += n
        whole = sum(totals.values())
        spend = budget or whole
        natural = -sum(t / whole * math.log(t / whole) for t in totals.values())
        target = None if evenness is None else natural + evenness * (math.log(len(totals)) - natural)

        def weights_at(e):
            raw = {s: (t / whole) ** e for s, t in totals.items()}
            return {s: v / sum(raw.values()) for s, v in raw.items()}

        def fits(e):
            w = weights_at(e)
            entropy = -sum(v * math.log(v) for v in w.values())
            return (target is None or entropy <= target + 1e-12) and (repeats is None or max(w[s] * spend / totals[s] for s in w) <= repeats * (1 + 1e-12))

        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
        want = weights_at(high if not fits(0.0) else 0.0)
        assert {x.source: x.weight for x in used} == pytest.approx(want, abs=1e-6)
        by_source = defaultdict(list)
        for x in used:
            by_source[x.source].append(x)
        for source, uses in by_source.items():
            quota, total = want[source] * spend, totals[source]
            full = int(quota / total + 1e-9)
            members = {k for k, s in enumerate(sources) if s == source}
            for block in range(full):
                assert Counter(x.doc_id for x in uses if x.block == block) == Counter(members)
            last = sorted((x for x in uses if x.block == full), key=lambda x: x.place)
            assert {x.block for x in uses} <= set(range(full + 1))
            places = {k: brute.spark_hash_int(0, full, str(k)) for k in members}
            taken, spent = set(), 0
            for k in sorted(members, key=lambda k: places[k]):
                if spent >= quota - full * total - 1e-6:
                    break
                taken.add(k)
                spent += sizes[k]
            assert abs(len(taken ^ {x.doc_id for x in last})) <= 1
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = frame(spark, [None, "", " "])
    assert mixing.mix(nothing).count() == 0


def test_mixing_stays_native(spark):
    plan = mixing.mix(frame(spark, ["a b", "c d e"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|Pandas|Cartesian|NestedLoop", plan)


# ---------------------------------------------------------------- op3


def test_tiles_against_brute_force():
    r = random.Random(7)
    for _ in range(300):
        a = [r.choice("abcdef") for _ in range(r.randint(1, 25))]
        b = [r.choice("abcdef") for _ in range(r.randint(0, 40))]
        if r.random() < 0.7:
            cut = r.randint(0, len(a))
            b = b[:5] + a[cut:] + b[5:9] + a[:cut] + b[9:]
        tiles = tiling.tile_cover(a, b, min(4, len(a)))
        assert all(a[i : i + n] == b[j : j + n] and n >= min(4, len(a)) for i, j, n in tiles)
        for side in (0, 1):
            places = [p for t in tiles for p in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))
        covered = sum(t[2] for t in tiles)
        assert covered >= 0.75 * brute.longest_first_tiles(a, b, min(4, len(a)))
    whole = [str(k) for k in range(50)]
    assert sum(t[2] for t in tiling.tile_cover(whole, whole[25:] + ["x"] + whole[:25], 5)) == 50


def test_contaminated(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (40, 25, 60, 5, 3, 1)]
    filler = lambda n: [word() for _ in range(n)]
    docs = [filler(50) for _ in range(60)]
    docs[0] = filler(30) + items[0] + filler(10)
    docs[1] = items[1][12:] + filler(5) + items[1][:12]
    docs[2] = filler(20) + items[2][:20]
    docs[3] = filler(9) + items[2][:16] + ["zzz"] + items[2][17:33] + filler(3)
    docs[4] = filler(3) + items[4] + filler(3)
    docs[5] = items[3]
    docs[6] = [w.upper() + "," for w in items[0]]
    docs[7] = filler(3) + items[0] + items[1]
    docs[8] = docs[0]
    texts = [" ".join(d) for d in docs] + [None, "", "!!!", "word " * 20_000]
    bench = spark.createDataFrame([(k, " ".join(i), "x") for k, i in enumerate(items[:5])] + [(9, None, "x"), (10, "", "x"), (0, " ".join(items[0]), "x")], "item_id long, text string, item string")
    for bits in (1 << 24, 64):  # a filter that lets everything through changes nothing
        found = tiling.contaminated(frame(spark, texts), bench, filter_bits=bits).collect()
        pairs = Counter((x.doc_id, x.item_id) for x in found)
        want = {(0, 0): 2, (6, 0): 2, (7, 0): 2, (8, 0): 2, (1, 1): 1, (7, 1): 1, (3, 2): 1, (4, 4): 1, (5, 3): 1}
        assert pairs == want
    assert all(x.covered <= x.n_words for x in found)
    assert tiling.contaminated(frame(spark, texts).limit(0), bench).count() == 0
    assert tiling.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def test_without(spark):
    docs = frame(spark, ["a", "b", None, "a"]).unionAll(frame(spark, ["a"]).withColumn("doc_id", F.lit(None).cast("long")))
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text", "doc_id").alias("key"))
    left = rows.without(docs, keyed.where("id is null or id = 1 or id = 2"))
    assert sorted(x.doc_id for x in left.collect()) == [0, 3] and left.columns == docs.columns


# ---------------------------------------------------------------- op4


def test_archives(spark):
    big, other = "é" * 600, "z" * 5000
    html = [big, "small", None, other, big, "small", "", "q" * 300_000, big, other] + [f"<p>{k}</p>" * 40 for k in range(50)]
    ids = list(range(10)) + list(range(20, 70))
    ids[8] = None
    pages = [(i, None if k == 2 else f"http://h/{k}\r\nX: y é", h, "c") for k, (i, h) in enumerate(zip(ids, html))] + [(9, "http://again", other, "c")]
    given = spark.createDataFrame(pages, "page_id long, url string, html string, winner string").repartition(3)
    written = warc.write_archives(given, output_folder(spark, "warc-test"))
    got = warc.read_archives(spark, written).collect()
    assert len(got) == len(pages) == sum(x.records for x in written.collect())
    want = Counter()
    for page, _, body, _ in pages:
        data = (body or "").encode()
        same = [p for p, _, b, _ in pages if (b or "").encode() == data and p is not None]
        winner = max(same) if len(data) >= 1000 and same else None
        revisit = winner is not None and winner != page
        want[(page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", winner if revisit else None)] += 1
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == want
    for path in (x.path for x in written.collect()):
        system, name = resolve(path)
        with system.open_input_file(name) as file:
            assert file.read(4) == b"\x5d\x2a\x4d\x18"
    assert warc.archive_report(given.limit(0)).count() == 0


# ---------------------------------------------------------------- op7


def test_encoder_is_exact():
    codec = tokens.Encoder(tokens.default_tokenizer())
    assert codec.pieces
    r = random.Random(6)
    parts = list("ab 's \n\t  .,#1é²中᠎\x1c\x85'tre !\0½Ⅷ") + ["the", " and", "\n\n", "'ll", "<|endoftext|>", "."]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(codec.encode(text), codec.dtype).tolist() == codec.library.encode(text, add_special_tokens=False).ids


def test_boundaries():
    r = np.random.default_rng(1)
    for count in (1, 2, 511, 512, 513, 5000):
        for most in (1, 3, 1000):
            ends = np.cumsum(r.integers(0, most + 1, count))
            width, lower, upper, samples = tokens.elias_fano(ends)
            found = tokens.Boundaries(count, width, lower, upper, samples)
            assert (found.ends(0, count) == ends).all()
            for k in r.integers(0, count, 20).tolist():
                assert found.span(k) == ((int(ends[k - 1]) if k else 0), int(ends[k]))
            assert len(lower) + len(upper) + samples.nbytes <= count * (2 + width + 1) / 8 + 16 + count // 100


def test_tokens(spark):
    r = random.Random(3)
    texts = [None, "", "hello world\nagain  twice"] + [" ".join(r.choice(("alpha", "beta.", "ñandú,", "x1")) for _ in range(r.randint(0, 90))) for _ in range(200)] + ["long " * 30_000]
    given = [(k * 7 - 300, t) for k, t in enumerate(texts)] + [(None, "null id"), (7, "same id"), (7, "same id")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    got = tokens.token_report(docs).collect()
    codec = tokens.Encoder(tokens.default_tokenizer()).library
    ids = {k: codec.encode(t or "", add_special_tokens=False).ids + [2] for k, (_, t) in enumerate(given)}
    want = Counter((d, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) for k, (d, _) in enumerate(given))
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == want
    ordered = sorted(got, key=lambda x: x.start)
    assert [x.start for x in ordered] == [sum(y.n_tokens for y in ordered[:k]) for k in range(len(ordered))]
    names = [x.doc_id for x in ordered]
    assert names[0] is None and names[1:] == sorted(names[1:])
    assert tokens.token_report(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- op9


def edited(r, words, share):
    return [w if r.random() > share else f"e{r.randint(0, 10**6)}" for w in words]


def test_near_duplicates(spark):
    r = random.Random(12)
    vocabulary = [f"v{k}" for k in range(3000)]
    common = [f"c{k}" for k in range(60)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice((3, 6, 30, 150, 400)))]
        for share in (0, 0, 0.004, 0.01, 0.02, 0.03):
            texts.append(" ".join(edited(r, base, share)))
    chain = [r.choice(vocabulary) for _ in range(200)]
    for k in range(12):  # neighbours are alike, the ends are not
        chain = chain[3:] + [f"n{k}{j}" for j in range(3)]
        texts.append(" ".join(chain))
    texts += [" ".join([r.choice(vocabulary) for _ in range(40)] + common + [r.choice(vocabulary) for _ in range(40)]) for _ in range(40)]
    texts += [None, "", " \t\n", "One Two", "one  two", "one two three four five", "y " * 5000, "y " * 6000]
    r.shuffle(texts)
    given = [(k, t) for k, t in enumerate(texts)]
    for retained in (64, 16):
        got = neardup.near_duplicates(frame(spark, texts), retained=retained).collect()
        assert sorted(tuple(x) for x in got) == sorted(brute.near_duplicates(given))
    assert neardup.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_union_sketch_of_middling_sets(spark):
    describe, given, want = neardup._describe(5, 64), [], {}
    for n in range(65, 151):
        words = [f"n{n}w{k}" for k in range(n + 4)]
        a, b = " ".join(words), " ".join(words[n // 20 : n - n // 20 + 4])
        given.append((n, describe(a)[2].tolist(), describe(b)[2].tolist()))
        one, other = (set(shingles.shingles(t, 5).tolist()) for t in (a, b))
        least = set(sorted(one | other)[:64])
        want[n] = (len(least & one & other), len(least))
    sketches = spark.createDataFrame(given, "n long, s_a array<long>, s_b array<long>")
    got = sketches.select("n", *neardup._union_sketch(64)).collect()
    assert {x[0]: (x[1], x[2]) for x in got} == want


def test_links_of_middling_sets(spark):
    """Similarity 0.85 or a little more; hashes from 2^63 up once pushed shared ones out of the estimate."""
    texts = []
    for n, part, seed in ((100, 85, 1178), (109, 93, 882), (118, 101, 468), (128, 109, 345)):
        words = [f"s{seed}w{k}" for k in range(n + 4)]
        texts += [" ".join(words), " ".join(words[: part + 4])]
    got = sorted((x.doc_id, x.component_id) for x in neardup.near_duplicates(frame(spark, texts)).collect())
    assert got == [(k, k - k % 2) for k in range(8)]


def test_a_group_of_strongly_edited_copies(spark, monkeypatch):
    r = random.Random(31)
    vocabulary = [f"v{k}" for k in range(4000)]
    base = [r.choice(vocabulary) for _ in range(120)]
    edit = lambda words, share, pool: " ".join(w if r.random() > share else r.choice(pool) for w in words)
    texts = [edit(base, r.choice((0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08)), vocabulary[:400]) for _ in range(260)]
    texts += [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(100)]
    branch = edit(base, 0.04, vocabulary).split()
    texts += [edit(branch, 0.01, vocabulary) for _ in range(12)]
    want = sorted(brute.near_duplicates(list(enumerate(texts))))
    for length, rare in ((8, 4), (64, 16)):
        monkeypatch.setattr(neardup, "LONG_LIST", length)
        monkeypatch.setattr(neardup, "RARE", rare)
        assert sorted(tuple(x) for x in neardup.near_duplicates(frame(spark, texts)).collect()) == want


def test_a_filled_in_template(spark, monkeypatch):
    r = random.Random(5)
    words = [f"t{k}" for k in range(100)]
    own = lambda k, n: [f"own{k}x{j}" for j in range(n)]
    alone = [" ".join(words[:50] + own(k, 12) + words[50:]) for k in range(240)]
    swapped = []
    for k in range(240):  # alike only where the word that differs is at about the same place
        at = r.randrange(100)
        swapped.append(" ".join(f"s{j}" if j != at else f"other{k}" for j in range(100)))
    tried = []
    estimated = neardup._estimated

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return estimated(pairs, *rest)

    monkeypatch.setattr(neardup, "_estimated", counted)
    for texts in (alone + [" ".join(words)], swapped, alone + swapped):
        tried.clear()
        want = sorted(brute.near_duplicates(list(enumerate(texts))))
        assert sorted(tuple(x) for x in neardup.near_duplicates(frame(spark, texts)).collect()) == want
        assert sum(tried) < 40 * len(texts), tried  # far from all pairs


def test_near_duplicates_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(50))
    given = [(None, text), (4, text), (4, text), (9, text + " x"), (None, "alone here is a text of words"), (2, None), (2, None), (None, "")]
    got = neardup.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=key) == sorted(
        [(None, 46, 4), (4, 46, 4), (4, 46, 4), (9, 47, 4), (None, 3, None), (2, 0, 2), (2, 0, 2), (None, 0, None)], key=key
    )
    assert [x.kept for x in got if x.doc_id == 9] == [False] and all(x.kept for x in got if x.doc_id in (2, 4))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 160)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixture", "token_files"]
    docs = rows.table(spark, sf_dir, "documents")
    texts = {x.doc_id: x.text for x in docs.collect()}
    current, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        folder = output_folder(spark, f"test-{name}")
        stage(spark, current, sf_dir).write.parquet(folder)
        current = spark.read.parquet(folder)
        assert current.columns == docs.columns
        kept[name] = Counter(x.doc_id for x in current.collect())
        assert all(texts[x.doc_id] == x.text for x in current.select("doc_id", "text").collect())
    first = kept["quality_rules"]
    assert all(not (brute.quality_counts(texts[k])[0] < 50) for k in first)
    groups = brute.near_duplicates([(k, texts[k]) for k in first])
    assert set(kept["near_duplicates"]) == {k for k, _, _, stays in groups if stays}
    found = tiling.contaminated(docs, rows.table(spark, sf_dir, "benchmark")).select("doc_id").distinct().collect()
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - {x.doc_id for x in found}
    assert found and set(kept["mixture"]) <= set(kept["decontamination"])
    result = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(x.doc_id for x in result) == kept["mixture"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_registered_with_sql(spark, sf_dir):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    import compare

    from wirepulse.llm import queries

    assert {int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES} == set(range(1, 11))
    con = compare.duck(sf_dir)
    for name, sql in queries.ORACLES.items():
        assert compare.compare(con, queries.QUERIES[name](spark, sf_dir), sql) is None


@pytest.mark.parametrize("pieces, held", [(300, 1 << 40), (1 << 40, 3000)])
def test_encoder_forgets_what_is_not_met_again(monkeypatch, pieces, held):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "REMEMBERED", pieces)
    monkeypatch.setattr(tokens, "REMEMBERED_IDS", held)
    codec = tokens.Encoder(tokens.default_tokenizer())
    library = codec.library
    for block in range(8):
        long = "".join(chr(97 + (block * 7 + i * i) % 26) for i in range(3000))  # one piece of many ids
        texts = [f"the same words come again {block * 100 + i} q{block * 977 + i * 31}z" for i in range(80)] + [long]
        ids, counts = codec.encode_column(pa.array(texts, pa.string()))
        whole = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in whole for i in w] and counts.tolist() == [len(w) for w in whole]
        # At most what may stay and what one block adds.
        assert len(codec.slots) <= pieces + 200 and codec.used <= held + 3000
        if block > 2:
            assert {"the", " same", " words"} <= set(codec.slots)
