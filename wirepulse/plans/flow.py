"""The whole way from documents to alerts, as one lazy plan per stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wirepulse import config
from wirepulse.functions import text as tx, times as tm
from wirepulse.operators import deals as dl, dedupe, gate, prefilter as pf, queue, verdicts as vd
from wirepulse.session import checkpointed

ORDER = ["fetched_at", "source_id", "check_id", "position"]
Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class Alerts:
    """What scoring a set of candidates led to.

    ``verdicts`` are the answers used, ``rejected`` those that raise no alert (with
    the gate's reason), ``pending`` the candidates that got no answer.
    """

    verdicts: DataFrame
    rejected: DataFrame
    pending: DataFrame
    reports: DataFrame
    alerts: DataFrame
    outbox: DataFrame


def candidates_from(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items (with dedupe keys) that pass the keyword stage, after the category
    filter, the payload rule, two-key dedupe and the bootstrap gate."""
    wanted = payload_firsts(pf.category_filter(items, sources))
    return pf.prefilter(dedupe.bootstrap_gate(wanted, dedupe.dedupe_two_key(wanted, ORDER))).where("pass")


def payload_firsts(items: DataFrame) -> DataFrame:
    """The first item per address inside each payload: later ones are not tried at all."""
    return dedupe.first_per_key(items, ["source_id", "check_id", "url_key"], ORDER)


def last_answers(answers: DataFrame) -> DataFrame:
    """One verdict per item: of several the last (by ``position`` if the scorer gives one)."""
    order = F.col("position") if "position" in answers.columns else F.monotonically_increasing_id()
    rest = [c for c in answers.columns if c not in ("batch_id", "id", "position")]
    numbered = answers.withColumn("_order", order)
    latest = F.max_by(F.struct(*rest), "_order").alias("_answer")
    return numbered.groupBy("batch_id", "id").agg(latest).select("batch_id", "id", "_answer.*")


def alerts_from(
    cands: DataFrame, events: DataFrame, scorer: Scorer = vd.keyword_scorer, *, global_floor: float = 0.7,
    paused: bool = False, history: DataFrame | None = None, prior_sources: DataFrame | None = None,
    public: bool = True, also_dm: bool = False, sources: DataFrame | None = None, body_chars: int | None = config.BODY_CHARS,
) -> Alerts:
    """Score candidates in packed batches and turn verdicts into outbox rows.

    ``cands`` need id (a BIGINT), source_id, title, link, summary, published_at,
    fetched_at, hit and strong. The scorer runs once over each of them: its answers
    are checkpointed before anything reads them. A candidate without an answer is
    returned as pending; ``sources`` gives alerts their source names; ``body_chars``
    is what the scorer sees of a summary (None: all of it).
    """
    packed = checkpointed(queue.pack_batches(cands))
    body = F.col("summary") if body_chars is None else F.substring("summary", 1, body_chars)
    answers = checkpointed(last_answers(scorer(packed.withColumn("body", body))).withColumnRenamed("id", "item_no"))
    asked = packed.join(answers.select("batch_id", "item_no"), ["batch_id", "item_no"], "left_anti")
    pending = asked.select(*cands.columns)
    kept = packed.select("batch_id", "item_no", F.col("id").alias("report_id"), "source_id", "title", "link", "published_at", "fetched_at")
    verdicts = kept.join(answers, ["batch_id", "item_no"])
    gated = gate.gate_verdicts(verdicts, events, global_floor, paused)
    reports = gated.where("alert").withColumns({
        "deal_key": tx.deal_key(F.col("company"), F.col("event")),
        "reported_at": F.col("fetched_at"),
        "unverified": F.lit(False),
    })
    if history is None:
        cooled = dl.deal_cooldown(reports, events)
    else:
        cooled = dl.cooldown_after(reports, events, history)
    emitted = dl.emitted_deals(cooled, prior_sources)
    if sources is None:
        emitted = emitted.withColumn("source_name", F.col("source_id"))
    else:
        names = sources.groupBy("source_id").agg(F.min("name").alias("_name"))
        emitted = emitted.join(names, "source_id", "left").withColumn("source_name", F.coalesce("_name", "source_id")).drop("_name")
    alerts = emitted.withColumns({
        "summary": F.col("one_line_summary"),
        "latency_ms": tm.ms_between(F.col("published_at"), F.col("emit_ts")),
    })
    rendered = dl.render_alert(alerts, events)
    outbox = dl.route_alerts(rendered, public, also_dm=also_dm).select("deal_key", "emit_ts", "channel", "alert_html")
    return Alerts(verdicts, gated.where("not alert"), pending, cooled, rendered, outbox)
