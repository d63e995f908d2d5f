"""The candidate queue: claiming, expiry, recovery, packing and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirepulse import config
from wirepulse.functions import text as tx, times as tm
from wirepulse.operators.ordered import numbered, previous, running

PENDING, CLASSIFIED, ALERTED, REJECTED = "pending", "classified", "alerted", "rejected"


#: Which status may follow which; a candidate begins as pending.
TRANSITIONS = (
    (None, PENDING), (PENDING, PENDING), (PENDING, CLASSIFIED), (PENDING, REJECTED), (CLASSIFIED, ALERTED), (CLASSIFIED, REJECTED),
    (CLASSIFIED, PENDING), (ALERTED, PENDING), (REJECTED, PENDING),
)


def _set(df: DataFrame, where: Column, **changes: Column) -> DataFrame:
    """Rows with some columns replaced where a condition holds."""
    where = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def claimable(cands: DataFrame, now) -> Column:
    waited = F.col("status_at") <= tm.shift(tm.instant(now), -config.STUCK_SECONDS)
    return (F.col("status") == PENDING) & ((F.col("attempts") == 0) | waited) & (F.col("attempts") < config.MAX_ATTEMPTS)


def claim_batch(cands: DataFrame, now, n: int = config.MAX_BATCH) -> DataFrame:
    """The ``n`` freshest eligible candidates, attempts counted up and marked now."""
    picked = cands.where(claimable(cands, now)).orderBy(F.desc("fetched_at"), "id").limit(n)
    return picked.withColumn("attempts", F.col("attempts") + 1).withColumn("status_at", tm.instant(now))


def expire_stale(cands: DataFrame, now, hours: int = config.MAX_AGE_HOURS) -> DataFrame:
    """Reject pending candidates published (or, undated, fetched) before the cutoff."""
    cutoff = tm.shift(tm.instant(now), -hours * 3600)
    stale = (F.col("status") == PENDING) & (F.coalesce("published_at", "fetched_at") < cutoff)
    return _reject(cands, stale, F.lit(f"stale: older than {hours}h before it could be classified"), now)


def _reject(cands: DataFrame, where: Column, reason: Column, now) -> DataFrame:
    moment = tm.instant(now)
    # The condition reads columns it also sets, so settle it first.
    marked = cands.withColumn("_hit", F.coalesce(where, F.lit(False)))
    return _set(
        marked, F.col("_hit"), status=F.lit(REJECTED), status_at=moment,
        rejected_reason=F.substring(reason, 1, 200),
        expires_at=tm.shift(moment, config.REJECTED_TTL_DAYS * 86_400),
    ).drop("_hit")


def split_late(items: DataFrame, now, hours: int = config.MAX_AGE_HOURS) -> tuple[DataFrame, DataFrame]:
    """(on time, late) by event time, or ingest time where there is none."""
    late = F.coalesce("published_at", "fetched_at") < tm.shift(tm.instant(now), -hours * 3600)
    return items.where(~late), items.where(late)


def recover_stuck(cands: DataFrame, now) -> DataFrame:
    """Candidates left classified too long return to the queue."""
    cutoff = tm.shift(tm.instant(now), -config.STUCK_SECONDS)
    marked = cands.withColumn(
        "_hit", (F.col("status") == CLASSIFIED) & (F.col("status_at") <= cutoff) & (F.col("attempts") < config.MAX_ATTEMPTS)
    )
    return _set(marked, F.col("_hit"), status=F.lit(PENDING), status_at=cutoff).drop("_hit")


def reset_exhausted(cands: DataFrame, now) -> DataFrame:
    """Pending candidates at the attempt limit start over (scorer healthy again)."""
    marked = cands.withColumn("_hit", (F.col("status") == PENDING) & (F.col("attempts") >= config.MAX_ATTEMPTS))
    rewound = tm.shift(tm.instant(now), -config.STUCK_SECONDS - 1)
    return _set(marked, F.col("_hit"), attempts=F.lit(0), status_at=rewound).drop("_hit")


def return_to_pending(cands: DataFrame, now, failed: Column, refund: Column) -> DataFrame:
    """Rows in ``failed`` are queued again at once; ``refund`` uncounts the attempt."""
    marked = cands.withColumn("_hit", failed).withColumn("_refund", failed & refund)
    rewound = tm.shift(tm.instant(now), -config.STUCK_SECONDS - 1)
    back = _set(marked, F.col("_hit"), status=F.lit(PENDING), status_at=rewound)
    return _set(back, F.col("_refund"), attempts=F.col("attempts") - 1).drop("_hit", "_refund")


def latest_state(transitions: DataFrame, columns: list[str]) -> DataFrame:
    """Current state of each candidate from its transition log (``id``, ``seq``)."""
    return transitions.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("_s")).select("id", "_s.*")


def queue_depth(cands: DataFrame) -> DataFrame:
    return cands.groupBy("status").agg(F.count("*").alias("n"))


def pack_batches(rows: DataFrame, n: int = config.MAX_BATCH) -> DataFrame:
    """Oldest first, cut into batches: adds ``batch_id`` and the local ``item_no``."""
    ranked = numbered(rows, "fetched_at", "id")
    return ranked.withColumn("batch_id", F.floor((F.col("rn") - 1) / n)).withColumn(
        "item_no", F.concat(F.lit("i"), ((F.col("rn") - 1) % n).cast("string"))
    ).drop("rn")


def needs_enrichment(
    packed: DataFrame, sources: DataFrame, cap: int = config.MAX_ARTICLE_FETCHES, thin_chars: int = config.THIN_SUMMARY_CHARS,
) -> DataFrame:
    """Add ``fetch_article``: thin rows of permitting sources, at most ``cap`` per batch."""
    permits = sources.select("source_id", F.col("fetch_article").alias("_permit"))
    thin = (F.length(tx.strip(F.col("summary"))) < thin_chars) & F.coalesce("_permit", F.lit(True))
    # A batch holds at most a request's worth of rows.
    turn = Window.partitionBy("batch_id").orderBy("fetched_at", "id")
    turn = turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        packed.join(permits, "source_id", "left")
        .withColumn("_thin", thin)
        .withColumn("fetch_article", F.col("_thin") & (F.count_if("_thin").over(turn) <= cap))
        .select(*packed.columns, "fetch_article")
    )


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def choose_body(cands: DataFrame, articles: DataFrame, body_chars: int | None = config.BODY_CHARS) -> DataFrame:
    """Add ``body``: the article when longer than the summary, else the summary; cut.

    ``articles`` has (link, article), one row per link.
    """
    joined = cands.join(articles.select("link", "article"), "link", "left")
    longer = F.length("article") > F.length("summary")
    body = _cut(F.when(longer, F.col("article")).otherwise(F.col("summary")), body_chars)
    return joined.select(*cands.columns, body.alias("body"))


def associate(cands: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Attach verdicts; a candidate without one goes back to pending.

    Of several verdicts for a candidate the last counts: by ``position`` where the
    verdicts carry one.
    """
    order = F.col("position") if "position" in verdicts.columns else F.monotonically_increasing_id()
    rest = [c for c in verdicts.columns if c not in keys]
    last = verdicts.withColumn("_order", order).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_order").alias("_verdict"))
    flagged = last.select(*keys, "_verdict.*", F.lit(True).alias("_answered"))
    joined = cands.join(flagged, keys, "left")
    status = F.when(F.coalesce("_answered", F.lit(False)), CLASSIFIED).otherwise(PENDING)
    return joined.withColumn("status", status).drop("_answered")


def render_requests(packed: DataFrame, body_chars: int | None = config.BODY_CHARS) -> DataFrame:
    """One request text per batch: a header, then a block per item."""
    published = F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("unknown"))
    form = F.col("sec_form_type") if "sec_form_type" in packed.columns else F.lit(None).cast("string")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("--- ITEM id="), F.col("item_no"), F.lit(" ---")),
        F.concat(F.lit("Source: "), F.coalesce("source_name", "source_id") if "source_name" in packed.columns else F.col("source_id")),
        F.concat(F.lit("Published: "), published),
        F.concat(F.lit("SEC form type: "), form),
        F.concat(F.lit("Title: "), F.col("title")),
        F.concat(F.lit("Body: "), _cut(F.col("body"), body_chars)),
    )
    order = F.substring("item_no", 2, 10).cast("int")
    # Batches are cut to a fixed size, so the list stays that short.
    return (
        packed.groupBy("batch_id")
        .agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), block.alias("b")))).alias("_items"))
        .select(
            "batch_id", F.size("_items").cast("bigint").alias("n_items"),
            F.concat(
                F.lit("Classify each of the following "), F.size("_items").cast("string"), F.lit(" news item(s).\n\n"),
                F.array_join(F.transform("_items", lambda s: s["b"]), "\n\n"),
            ).alias("request"),
        )
    )


def transition_violations(log: DataFrame, transitions=TRANSITIONS) -> DataFrame:
    """What a log of candidate states (id, ts, seq, status, attempts) shows that no sequence of allowed steps can: (id, seq, kind).

    "illegal": the step is not in ``transitions``. "lost attempt": attempts go down other than by one when an
    attempt is refunded, or to none when exhausted attempts are reset, both on the way to pending. "double alert": an
    earlier row of the candidate is alerted, too. A row may violate several rules; a null status is an illegal one. Steps and earlier alerts come from
    range-cut slices, so the log of one candidate may be of any length.
    """
    chain = previous(log, ["id"], "ts", "seq", {"_status": "status", "_attempts": "attempts"})
    chain = running(chain, F.col("id"), ["ts", "seq"], {"_alerts": (F.col("status") == ALERTED).cast("int")})
    step = F.concat_ws(">", F.coalesce("_status", F.lit("")), F.coalesce("status", F.lit("")))
    allowed = step.isin([f"{a or ''}>{b}" for a, b in transitions])
    refunded = (F.col("attempts") == F.col("_attempts") - 1) | ((F.col("attempts") == 0) & (F.col("_attempts") >= config.MAX_ATTEMPTS))
    lost = (F.col("attempts") < F.col("_attempts")) & ~(F.col("status").eqNullSafe(PENDING) & refunded)
    double = (F.col("status") == ALERTED) & (F.col("_alerts") > 1)
    kinds = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for c, k in ((~allowed, "illegal"), (lost, "lost attempt"), (double, "double alert"))])
    return chain.select("id", "seq", F.explode(F.array_compact(kinds)).alias("kind"))
