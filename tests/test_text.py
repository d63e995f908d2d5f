import pytest
from pyspark.sql import functions as F

from wirepulse.functions import text as tx, times as tm
from wirepulse.functions.patterns import contains_any, first_pattern, java_pattern, padded


@pytest.mark.parametrize(
    "raw, canonical",
    [
        ("https://news.example.com/2026/a?utm_source=x&utm_campaign=y", "https://news.example.com/2026/a"),
        ("https://example.com/news?b=2&a=1", "https://example.com/news?a=1&b=2"),
        ("http://WWW.Example.COM/Press/Item-A", "https://example.com/Press/Item-A"),
        ("https://example.com/x#part-2", "https://example.com/x"),
        ("https://example.com/x/", "https://example.com/x"),
        ("https://example.com/", "https://example.com/"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com/x/?a=1", "https://example.com/x/?a=1"),
        ("https://example.com:80/x", "https://example.com/x"),
        ("https://example.com:8443/x", "https://example.com:8443/x"),
        ("https://example.com/?a=2&a=1&b", "https://example.com/?a=2&a=1&b="),
        ("https://example.com/a?hsCtaTracking=1&REF=z&q=1", "https://example.com/a?q=1"),
        ("  https://example.com/x ", "https://example.com/x"),
        ("Plain Words", "plain words"),
        ("mailto:Someone@Example.com", "mailto:someone@example.com"),
        ("", ""),
    ],
)
def test_canonical_url(evaluate, raw, canonical):
    assert evaluate(tx.canonical_url, [raw]) == [canonical]


def test_url_key_joins_variants_of_one_address(evaluate):
    a, b, c = evaluate(
        tx.url_key, ["https://www.x.com/n/y/?utm_source=rss&utm_medium=feed", "http://x.com/n/y#comments", "http://x.com/n/z"]
    )
    assert a == b != c and len(a) == 32


def test_normalize_title(evaluate):
    cases = {
        "Scoop: Willow wins $9M": "willow wins $9m",
        "BREAKING: Scoop - Willow wins $9M": "willow wins $9m",
        "Editor's Pick: Update: Exclusive: three": "exclusive three",
        "Café Zürich nets 3%": "cafe zurich nets 3%",
        "Société": "societe",
        "Willow’s “plan”": "willows plan",
        "Willow's plan": "willow s plan",
        "20% premium + more": "20% premium + more",
        "ﬁne №5 ½ Ｆｕｌｌ": "fine no5 1 2 full",
        "東京の会社": "",
        "  padded  ": "padded",
    }
    assert dict(zip(cases, evaluate(tx.normalize_title, list(cases)))) == cases


def test_title_key_is_null_for_short_titles(evaluate):
    short, a, b = evaluate(tx.title_key, ["Scoop", "Report: Willow wins $9M prize", "Willow wins $9M prize"])
    assert short is None and a == b is not None


def test_deal_key_ignores_suffixes(spark):
    rows = [("Willow Technologies GmbH", "launch"), ("Willow", "launch"), ("Willow", "rebrand"), ("Coinco", "funding"), ("Coin", "funding")]
    frame = spark.createDataFrame(rows, "c string, e string")
    a, b, c, d, e = [r[0] for r in frame.select(tx.deal_key(F.col("c"), F.col("e"))).collect()]
    assert a == b != c and d != e


def test_html_to_text(evaluate):
    cases = {
        "<h2>Salt &amp; <i>pepper</i></h2>": "Salt & pepper",
        "<style>p{x:1}</style>Kept<SCRIPT x>gone()\n</script>": "Kept",
        "costs &#165;900": "costs ¥900",
        "costs &#x20AC;2 &#X1F600;": "costs €2 😀",
        "&yen;1 &MDASH; &cent;2&hellip;": "¥1 — ¢2…",
        "&madeup; y": "&madeup; y",
        "&amp;lt; &amp;#163;": "&lt; &#163;",
        "x&#99999999999999999999;y&#x110000;z": "xyz",
        "a&nbsp;&nbsp; b": "a b",
    }
    assert dict(zip(cases, evaluate(tx.strip_html, list(cases)))) == cases


def test_article_text(evaluate):
    prose = "word " * 60
    page = f"<html><body><nav>menu</nav><article><h1>T</h1><header>x</header>{prose}<aside>ad</aside></article><footer>f</footer></body></html>"
    no_article = f"<body>B {prose}<footer>f</footer></body>"
    got = evaluate(tx.article_text, [page, no_article, "<article>short</article>" + prose, f"<article></article><body>{prose}</body>", prose * 30])
    assert got[0] == ("T " + prose).strip()
    assert got[1] == ("B " + prose).strip()
    assert got[2] is None and got[3] is None
    assert len(got[4]) == 4000


def test_escape_and_plain_text(evaluate):
    assert evaluate(tx.escape_html, ["a & <b> \"c\" 'd'"]) == ["a &amp; &lt;b&gt; &quot;c&quot; &#39;d&#39;"]
    assert evaluate(tx.plain_text, ['<b>A</b> &amp;lt; <a href="u">t</a>']) == ["A < t u"]


def test_filings(evaluate):
    assert evaluate(tx.sec_filer_name, ["D - Willow Pay Inc (0009876543) (Filer)", "8-K - X (Subject) Y"]) == ["Willow Pay Inc", "X Y"]


def test_lenient_values(evaluate):
    assert evaluate(tx.null_text, [" Null ", "N/A", "", " ", "n/a.", " x ", None]) == [None, None, None, None, "n/a.", "x", None]
    assert evaluate(tx.confidence_from_text, ["85", "0.8", "", "1", "250", "high", "Infinity"]) == [0.85, 0.8, 0.0, 1.0, 2.5, None, None]
    assert evaluate(tx.confidence_from_number, [85.0, 0.8, 1.0, 100.0, 101.0, -1.0], "double") == [0.85, 0.8, 1.0, 1.0, 101.0, -1.0]
    assert evaluate(tx.comma_list, ["A, B ,,C", " , "]) == [["A", "B", "C"], []]


def test_formats(evaluate):
    assert evaluate(tm.format_duration, [0, 31000, 601000, 7200000, -1, 7384000], "bigint") == ["0s", "31s", "10m 1s", "2h 0m", "0s", "2h 3m"]
    assert evaluate(tm.age_text, [59 * 60000, 69 * 60000, 75 * 60000, 2 * 86400000, None], "bigint") == ["59m", "1.1h", "1.3h", "2.0d", "unknown"]
    assert evaluate(lambda x: tx.to_fixed(x, 2), [0.7, 0.145, 0.125, 0.999, 12.0], "double") == ["0.70", "0.14", "0.13", "1.00", "12.00"]


def test_eastern_time(evaluate):
    to_ts = lambda c: tm.format_et_datetime(c.cast("timestamp"))
    assert evaluate(to_ts, ["2025-07-04 15:05:00", "2025-12-09 15:05:00"]) == ["Jul 4, 11:05", "Dec 9, 10:05"]


def test_feed_dates(evaluate):
    texts = ["Tue, 22 Sep 2026 11:00:00 GMT", "22 Sep 2026 13:00:00 +0200", "2026-09-22T10:00:00-04:00", "2026-09-22", "22 Sep 2026 11:00 EST", "soon", ""]
    got = evaluate(lambda c: tm.parse_feed_date(c).cast("string"), texts)
    assert got == ["2026-09-22 11:00:00", "2026-09-22 11:00:00", "2026-09-22 14:00:00", "2026-09-22 00:00:00", "2026-09-22 16:00:00", None, None]


def test_no_future(evaluate):
    got = evaluate(
        lambda c: tm.no_future(c.cast("timestamp"), "2026-01-01 00:00:00").cast("string"), ["2026-01-01 01:00:00", "2026-01-01 01:00:01"]
    )
    assert got == ["2026-01-01 01:00:00", None]


def test_word_boundaries_are_ascii(evaluate):
    buys = lambda c: contains_any(padded(c), (r"\bbuys\b",))
    assert evaluate(buys, ["ébuys", "buysé", "xbuys", "Buys", "a buys!"]) == [True, True, False, True, True]
    assert java_pattern(r"\ba\sb\b").startswith("(?<![A-Za-z0-9_])a[")
    spaced = lambda c: contains_any(padded(c), (r"\bseries\s+[a-h]\b",))
    assert evaluate(spaced, ["Series B", "seriesb"]) == [True, False]


def test_first_pattern_follows_list_order(evaluate):
    named = lambda c: first_pattern(padded(c), (r"\bseed\b", r"\bround\b"))
    assert evaluate(named, ["a round then seed", "round", "background"]) == [r"\bseed\b", r"\bround\b", None]
