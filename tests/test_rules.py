"""Gate, deals, queue, health and verdict rules on small cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirepulse.operators import deals as dl, gate, health, queue, reports, verdicts as vd

NOW = datetime(2026, 9, 22, 12)


def ago(**kw):
    return NOW - timedelta(**kw)


DEAL = (
    "event string, region string, company string, round string, amount string, deal_value string, lead_investors array<string>, "
    "other_investors array<string>, acquirer string, target string, summary string, source_name string, link string, "
    "published_at timestamp, latency_ms bigint, unverified boolean, n_sources bigint"
)


def render(spark, **fields):
    base = dict(
        event="funding", region="US", company="Orchid", round="Series C", amount="$30M", deal_value=None, lead_investors=["Alpha"],
        other_investors=[], acquirer=None, target=None, summary="Cards & more.", source_name="Wire", link="https://x.com/?a=1&b=2",
        published_at=datetime(2026, 9, 22, 15, 5), latency_ms=601000, unverified=False, n_sources=1,
    )
    row = spark.createDataFrame([tuple((base | fields).values())], DEAL)
    return dl.render_alert(row, gate.event_table(spark)).first().alert_html


def test_render_full_alert(spark):
    assert render(spark).split("\n") == [
        "💰 <b>FUNDING</b> · 🇺🇸", "<b>Orchid</b> — Series C · $30M", "Led by: Alpha", "Cards &amp; more.",
        "<i>Wire · published 11:05 ET · detected in 10m 1s</i>", '<a href="https://x.com/?a=1&amp;b=2">Read source →</a>',
    ]


def test_render_optional_lines(spark):
    html = render(
        spark, round=None, amount=None, lead_investors=[], other_investors=["A", "", "B", "C", "D"], summary="", published_at=None,
        latency_ms=None, unverified=True, n_sources=3, region="other",
    )
    assert html.split("\n") == [
        "⚠️ <b>UNVERIFIED</b> (AI offline — keyword match only)", "💰 <b>FUNDING</b> · 🌐", "<b>Orchid</b>", "Investors: A, B, C",
        "<i>Wire</i>", '<a href="https://x.com/?a=1&amp;b=2">Read source →</a>', "<i>also reported by 2 other source(s)</i>",
    ]
    html = render(spark, event="acquisition", acquirer="Big", target="Small", deal_value="$1B", round=None, amount=None)
    assert "<b>Orchid</b> — $1B\nBig → Small · $1B\n" in html
    assert "→" not in render(spark, event="acquisition", acquirer="Big").split("Read source")[0]


def test_gate_reasons(spark):
    rows = [
        (1, True, "funding", True, "US", 0.7), (2, True, "partnership", True, "US", 0.79), (3, False, "funding", False, "US", 0.9),
        (4, False, "funding", True, "other", 0.9), (5, True, None, True, "US", 0.9), (6, True, "launch", True, "CA", 0.75),
    ]
    frame = spark.createDataFrame(rows, "id int, relevant boolean, event string, is_fintech boolean, region string, confidence double")
    got = {r.id: (r.alert, r.rejected_reason) for r in gate.gate_verdicts(frame, gate.event_table(spark)).collect()}
    assert got == {
        1: (True, None), 2: (False, "confidence 0.79 below 0.8"), 3: (False, "not fintech"), 4: (False, "region other"),
        5: (False, "not a tracked event"), 6: (True, None),
    }
    paused = {r.id: r.rejected_reason for r in gate.gate_verdicts(frame, gate.event_table(spark), paused=True).collect()}
    assert paused[1] == "paused" and paused[3] == "not fintech"


def test_claims_and_expiry(spark):
    rows = [
        (1, ago(hours=5), ago(hours=5), "pending", ago(minutes=1), 0), (2, None, ago(hours=7), "pending", ago(minutes=10), 1),
        (3, ago(hours=7), ago(hours=1), "pending", ago(minutes=1), 1), (4, ago(hours=1), ago(hours=1), "pending", ago(minutes=5), 4),
        (5, ago(hours=1), ago(hours=1), "pending", ago(minutes=9), 5), (6, ago(hours=6), ago(hours=9), "pending", ago(minutes=9), 0),
    ]
    frame = spark.createDataFrame(
        [r + (None, None) for r in rows],
        "id int, published_at timestamp, fetched_at timestamp, status string, status_at timestamp, attempts int, rejected_reason string, expires_at timestamp",
    )
    claimed = queue.claim_batch(frame, NOW, 3).collect()
    assert [(r.id, r.attempts) for r in claimed] == [(4, 5), (1, 1), (2, 2)]
    stale = queue.expire_stale(frame, NOW).where("status = 'rejected'").collect()
    assert sorted(r.id for r in stale) == [2, 3]
    assert stale[0].expires_at == NOW + timedelta(days=30)


def test_health_needs_silence_and_errors(spark):
    log = []
    for name, outcomes in {"ok": "sssf", "quiet": "sff", "failing": "sfff", "never": "fff", "back": "fffs"}.items():
        for i, o in enumerate(outcomes):
            log.append((name, NOW - timedelta(minutes=20 - i), i, o == "s", None if o == "s" else f"e{i}"))
    frame = spark.createDataFrame(log, "source_id string, ts timestamp, check_id int, ok boolean, error string")
    state = health.state_asof(frame, NOW)
    sources = spark.createDataFrame([(n, True, 60) for n in ("ok", "quiet", "failing", "never", "back", "unknown")], "source_id string, enabled boolean, min_interval_seconds int")
    assert sorted(r.source_id for r in health.stale_sources(sources, state, NOW).collect()) == ["failing", "never"]
    assert "unknown" in {r.source_id for r in health.unhealthy_sources(sources, state, NOW).collect()}
    assert {r.source_id: r.error_count for r in state.collect()} == {"ok": 1, "quiet": 2, "failing": 3, "never": 3, "back": 0}
    earlier = {r.source_id: r.error_count for r in health.state_asof(frame, NOW - timedelta(minutes=18)).collect()}
    assert earlier["back"] == 3 and earlier["failing"] == 2


def test_backoff(spark):
    rows = [("m", ago(minutes=100 - i), i, False) for i in range(7)] + [("m", ago(minutes=50), 9, True)]
    frame = spark.createDataFrame(rows, "model string, ts timestamp, call_id int, ok boolean")
    got = health.backoff_schedule(frame, 180_000, NOW).orderBy("call_id").collect()
    waits = [(r.next_at - r.ts).total_seconds() for r in got]
    assert waits == [60, 120, 240, 480, 600, 600, 600, 180]


def test_quota_counts(spark):
    rows = [("m.1", NOW, s) for s in (200, 429, 400, 500, 503, None)]
    frame = spark.createDataFrame(rows, "model string, ts timestamp, status int")
    assert [(r.model, r.requests) for r in reports.model_requests(frame).collect()] == [("m_1", 3)]
    choice = lambda p, f: reports.model_choice(frame, "m.1", p, "m.2", f).first().model
    assert (choice(4, 9), choice(3, 9), choice(3, 0)) == ("m.1", "m.2", None)


def test_projection(spark):
    rows = [("d", 100, 200_000, 5_000), ("e", 0, 0, 0)]
    got = reports.project_usage(spark.createDataFrame(rows, "day string, cycles bigint, wall_ms bigint, cpu_ms bigint")).orderBy("day").collect()
    assert round(got[0].cpu_hours, 6) == 0.6 and round(got[0].gb_hours, 6) == 48.0 and not got[0].warn
    assert got[1].cpu_hours == 0.0


def entry(**fields):
    base = dict(
        id="i0", relevant=True, event="funding", is_fintech=True, region="US", company="Orchid", fintech_subsector="null", amount="$1M", currency="USD",
        round="N/A", lead_investors=["A"], other_investors="B, C", acquirer=None, target="", deal_value=None, one_line_summary="s", confidence=85,
    ) | fields
    return {k: v for k, v in base.items() if v != "missing"}


def test_verdicts(spark):
    import json

    texts = [
        json.dumps({"verdicts": [entry(), entry(id="i1", region="Mars", confidence=-1), entry(id="i2", relevant="yes", company=5)]}),
        "```json\n" + json.dumps([entry(confidence="0.8", event="missing", other_investors="missing")]) + "\n```",
        "Here: " + json.dumps({"verdicts": [entry(company='a "q" } {', confidence="")]}) + " done } ok",
        '{"verdicts": [{"id": "i0"', "no json", '{"items": []}', "[]", None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "request_id int, body string")
    entries, errors = vd.verdict_entries(vd.extract_json(frame), "request_id")
    good, bad = vd.validate_verdicts(entries)
    rows = {(r.request_id, r.id): r for r in good.collect()}
    assert set(rows) == {(0, "i0"), (1, "i0"), (2, "i0")}
    first = rows[(0, "i0")]
    assert (first.confidence, first.round, first.fintech_subsector, first.target, first.other_investors) == (0.85, None, None, None, ["B", "C"])
    assert (rows[(1, "i0")].confidence, rows[(1, "i0")].event, rows[(1, "i0")].other_investors) == (0.8, None, [])
    assert (rows[(2, "i0")].confidence, rows[(2, "i0")].company) == (0.0, 'a "q" } {')
    problems = {(r.request_id, r.position): r.problems for r in bad.collect()}
    assert problems[(0, 1)] == "region: not a known region; confidence: expected a number from 0 to 1"
    assert problems[(0, 2)] == "company: expected string; relevant: expected boolean"
    assert sorted(r.request_id for r in errors.collect()) == [3, 4, 5, 7]


def test_packing_and_enrichment(spark):
    rows = [(i, "s" if i % 3 else "paywalled", NOW + timedelta(seconds=i), "short" if i % 2 else "x" * 400, "t", None) for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, source_id string, fetched_at timestamp, summary string, title string, published_at timestamp")
    packed = queue.pack_batches(frame)
    got = {r.id: (r.batch_id, r.item_no) for r in packed.collect()}
    assert got[0] == (0, "i0") and got[15] == (1, "i0") and got[39] == (2, "i9")
    sources = spark.createDataFrame([("s", None), ("paywalled", False)], "source_id string, fetch_article boolean")
    picked = sorted(r.id for r in queue.needs_enrichment(packed, sources).where("fetch_article").collect())
    want = []
    for batch in range(3):
        want += [i for i in range(batch * 15, min(batch * 15 + 15, 40)) if i % 2 and i % 3][:5]
    assert picked == want
    text = queue.render_requests(packed.withColumn("body", F.col("summary"))).where("batch_id = 2").first().request
    assert text.startswith("Classify each of the following 10 news item(s).\n\n--- ITEM id=i0 ---\nSource: paywalled\nPublished: unknown\nTitle: t\nBody: ")


@pytest.mark.parametrize("public, dm, also, want", [(True, True, False, ["public"]), (False, True, False, ["dm", "dm"]), (True, True, True, ["dm", "dm", "public"]), (False, False, False, [])])
def test_routing(spark, public, dm, also, want):
    frame = spark.createDataFrame([("a", False), ("b", True)], "deal_key string, unverified boolean")
    assert sorted(r.channel for r in dl.route_alerts(frame, public, dm, also).collect()) == want


def test_search_parameters(spark):
    frame = spark.createDataFrame(
        [("a", "sent", ago(days=2), "funding", "US", "Or.chid"), ("b", "sent", ago(days=2), "launch", "CA", "Orxchid"), ("c", "sent", ago(days=40), "funding", "US", "Or.chid"), ("d", "alerting", ago(days=2), "funding", "US", "Or.chid")],
        "deal_key string, alert_state string, alerted_at timestamp, event string, region string, company string",
    )
    keys = lambda **kw: sorted(r.deal_key for r in dl.search_deals(frame, NOW, **kw).collect())
    assert keys() == ["a", "b"]
    assert keys(days="90") == ["a", "b", "c"] and keys(days="x") == ["a", "b"]
    assert keys(q="R.C") == ["a"] and keys(event="launch") == ["b"] and keys(event="ipo") == ["a", "b"] and keys(region="US") == ["a"]
