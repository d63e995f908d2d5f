"""Structured Streaming jobs.

Stateless and single-key work uses Spark's own operators with a watermark. Rules
that need two keys at once or a whole key's history run the batch operators in
``foreachBatch`` against append-only tables; a batch reads only the parts before
its own, so repeating it after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from wirepulse import config
from wirepulse.functions import times as tm
from wirepulse.operators import deals as dl, dedupe, ordered, prefilter as pf, queue, verdicts as vd
from wirepulse.plans import flow
from wirepulse.session import checkpointed, discard, written
from wirepulse.sources import feeds, versioned
from wirepulse.sources.sinks import append_once, appended
from wirepulse.streaming.cooling import all_emissions, emit_with_cooldown  # noqa: F401
from wirepulse.streaming.seen import SeenStore

ACCEPTED = (
    "source_id string, check_id bigint, position int, title string, link string, summary string, "
    "published_at timestamp, guid string, categories array<string>, sec_form_type string, fetched_at timestamp, "
    "url_key string, title_key string"
)
CANDIDATES = f"{ACCEPTED}, hit string, strong boolean, id bigint"
ALERTS = "deal_key string, emit_ts timestamp"
DEAL_SOURCES = "deal_key string, source_id string, title string, link string, published_at timestamp"


def once_per_key(stream: DataFrame, keys: Sequence[str], ts: str, memory: str, salts: int = 64) -> DataFrame:
    """First row per key, remembered for ``memory`` ("30 days", "1 day").

    Two chained steps, both in the JVM: the first remembers key and salt, so that a
    hot key's copies meet in as many tasks as there are salts, and the second sees at
    most one row per key and salt. Rows behind the watermark are dropped by Spark;
    ``write_timely`` with ``add_firsts`` keeps them aside.
    """
    names = list(keys)
    salted = stream.withColumn("_salt", F.pmod(F.xxhash64(F.struct(*stream.columns)), F.lit(salts))).withWatermark(ts, memory)
    return salted.dropDuplicatesWithinWatermark([*names, "_salt"]).dropDuplicatesWithinWatermark(names).drop("_salt")


def daily_totals(log: DataFrame, ts: str, counters: Sequence[str], late: str = "6 hours") -> DataFrame:
    """Counters per UTC day: in append mode once the day is closed, in update mode as they grow.

    Rows of days behind the watermark are dropped by Spark; ``write_timely`` with ``add_totals`` keeps them aside.
    """
    totals = [F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in counters]
    return log.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("_w")).agg(*totals).select(
        tm.day_key(F.col("_w.start")).alias("day"), *counters
    )


def write_updates(totals: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep growing totals: every batch appends the rows it changed as its own part."""
    def run(batch: DataFrame, batch_id: int) -> None:
        append_once(batch, out, batch_id)

    writer = totals.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_totals(spark, out: str, schema: str, key: str) -> DataFrame:
    """The newest row of every key that ``write_updates`` has written, open windows included."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(out)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(key, "_row.*")


def activity_sessions(log: DataFrame, key: str, ts: str, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of activity per key, split only where more than ``gap`` passes, as in ``ordered.sessions``.

    Only what the watermark has closed is written; ``write_sessions`` keeps open sessions and late rows, too.
    """
    return log.withWatermark(ts, late).groupBy(key, F.session_window(ts, f"{gap} 1 microsecond").alias("_w")).agg(F.count("*").alias("n")).select(
        key, "n", F.col("_w.start").alias("started_at")
    )


def write_sessions(log: DataFrame, key: str, ts: str, gap_us: int, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep growing sessions: every batch appends the pieces its rows make as its own part.

    There is no watermark, so a row counts however late it comes.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        append_once(ordered.session_pieces(batch, [key], ts, gap_us), out, batch_id)

    return _start(log, run, checkpoint, trigger)


def latest_sessions(spark, out: str, key: str, gap_us: int, key_type: str = "string") -> DataFrame:
    """All sessions of what ``write_sessions`` has written, open ones included."""
    pieces = appended(spark, out, f"{key} {key_type}, first timestamp, last timestamp, n bigint")
    return ordered.merged_sessions(pieces, [key], gap_us).select(key, "n", "started_at", "ended_at")


def dedupe_two_key_stream(
    stream: DataFrame, order: Sequence[str], ts: str, out: str, checkpoint: str, *, memory_days: int | None = None,
    buckets: int = 64, merge_after: int = 8, **trigger,
) -> StreamingQuery:
    """First-wins on ``url_key`` and ``title_key`` over a stream; ``out/kept`` receives the kept rows.

    Equal to ``dedupe.dedupe_two_key`` over all rows where batches come in the sequence of ``order``. Of the keys
    kept before, a batch reads those parts that may hold one of its own; with ``memory_days`` keys that
    much older than the batch's newest row are forgotten.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        items = written(batch)
        store = SeenStore(spark, f"{out}/seen", buckets, merge_after)
        after = None
        if memory_days is not None:
            newest = items.agg(F.max(ts)).first()[0]
            after = None if newest is None else newest - timedelta(days=memory_days)
        known = written(store.known(dedupe.both_keys(items), batch_id, after))
        seen = known.select(
            F.when(F.col("kind") == "url", F.col("key")).alias("url_key"), F.when(F.col("kind") == "title", F.col("key")).alias("title_key")
        )
        append_once(dedupe.dedupe_two_key(items, order, seen=seen), f"{out}/kept", batch_id)
        kept = spark.read.schema(items.schema).parquet(f"{out}/kept/batch={batch_id}")
        store.add(dedupe.both_keys(kept, F.col(ts).alias("at")), batch_id, after)
        discard(known)
        discard(items)

    return _start(stream, run, checkpoint, trigger)


def unchanged_skip_stream(docs: DataFrame, out: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Documents whose body differs from the stored one of their source, in ``out/changed``; as ``health.changed_only``.

    The last hash of each source is kept in a table to upsert into, so a batch reads the buckets of its sources and no
    earlier documents. Within a batch documents count in the sequence of (ts, check_id); the stored hash counts
    before all of them.
    """
    schema = "source_id string, body_hash string, ts timestamp, check_id bigint"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, table = batch.sparkSession, f"{out}/last"
        stored = checkpointed(batch.where(F.col("status") == "ok").withColumn("body_hash", F.substring(F.sha2("body", 256), 1, 32)))
        newest = versioned.version_at(spark, table)
        # A repeated batch starts from the version that the first attempt started from.
        before = newest.number - (newest.done.get("stream", -1) >= batch_id)
        known = versioned.read_version(spark, table, schema, before).join(stored.select("source_id").distinct(), "source_id", "left_semi")
        rows = stored.select("source_id", "body_hash", "ts", "check_id", F.lit(1).alias("_new")).unionByName(known.withColumn("_new", F.lit(0)))
        rows = rows.withColumn("_at", F.struct("_new", "ts", "check_id"))
        chain = ordered.previous(rows, ["source_id"], "_at", "_new", {"_before": "body_hash"}).where("_new = 1")
        changed = chain.where(F.col("_before").isNull() | (F.col("_before") != F.col("body_hash"))).select("source_id", "check_id")
        append_once(stored.join(changed, ["source_id", "check_id"], "left_semi"), f"{out}/changed", batch_id)
        versioned.upsert_table(
            stored, table, schema, ["source_id"], ["ts", "check_id"], how="replace", buckets=buckets, writer="stream", batch=batch_id
        )

    return _start(docs, run, checkpoint, trigger)


# ---------------------------------------------------------------- late rows

#: Takes a batch's rows that are on time, the number of the batch and the output folder.
Job = Callable[[DataFrame, int, str], None]


def write_timely(stream: DataFrame, ts: str, delay_ms: int, out: str, checkpoint: str, *work: Job, **trigger) -> StreamingQuery:
    """Part rows behind the watermark from the others: ``out/late`` and ``out/timely``, row for row the input.

    The watermark of a batch is the newest time of all batches before it less ``delay_ms``, to the millisecond; it is
    written with the batch and read by the next one alone. A row is late if its time is not after it; rows without a time
    are on time. ``work`` (``add_totals``, ``add_sessions``, ``add_firsts``) sees what is on time. All
    of a batch's folders carry its number, so a repeated batch splits the same way and overwrites what it wrote.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = checkpointed(batch)
        marks = f"{out}/marks/batch={batch_id - 1}"
        newest = spark.read.schema("newest long").parquet(marks).first()[0] if batch_id else None
        moment = F.unix_millis(ts)
        behind = F.lit(False) if newest is None else F.coalesce(moment <= newest - delay_ms, F.lit(False))
        append_once(rows.where(behind), f"{out}/late", batch_id)
        append_once(rows.where(~behind), f"{out}/timely", batch_id)
        timely = spark.read.schema(rows.schema).parquet(f"{out}/timely/batch={batch_id}")
        for job in work:
            job(timely, batch_id, out)
        now = rows.agg(F.greatest(F.max(moment), F.lit(newest).cast("long")).alias("newest"))
        append_once(now, f"{out}/marks", batch_id)

    return _start(stream, run, checkpoint, trigger)


def add_totals(ts: str, counters: Sequence[str]) -> Job:
    """Counters per UTC day of each batch's timely rows, in ``out/totals``; ``timely_totals`` adds them up."""
    def job(rows: DataFrame, batch_id: int, out: str) -> None:
        totals = [F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in counters]
        append_once(rows.groupBy(tm.day_key(F.col(ts)).alias("day")).agg(*totals), f"{out}/totals", batch_id)

    return job


def timely_totals(spark, out: str, counters: Sequence[str]) -> DataFrame:
    rows = appended(spark, f"{out}/totals", "day string, " + ", ".join(f"{c} bigint" for c in counters))
    return rows.groupBy("day").agg(*[F.sum(c).cast("bigint").alias(c) for c in counters])


def add_sessions(key: str, ts: str, gap_us: int) -> Job:
    """Pieces of sessions of the timely rows, in ``out/sessions``; ``latest_sessions`` merges them."""
    def job(rows: DataFrame, batch_id: int, out: str) -> None:
        append_once(ordered.session_pieces(rows, [key], ts, gap_us), f"{out}/sessions", batch_id)

    return job


def add_firsts(keys: Sequence[str], order: Sequence[str], ts: str, buckets: int = 64) -> Job:
    """The first timely row of every key (in the sequence of batches, within a batch of ``order``), in ``out/firsts``."""
    def job(rows: DataFrame, batch_id: int, out: str) -> None:
        store = SeenStore(rows.sparkSession, f"{out}/seen", buckets)
        named = rows.withColumns({"kind": F.lit("key"), "key": F.to_json(F.struct(*keys))})
        known = store.known(named.select("kind", "key"), batch_id)
        fresh = dedupe.first_per_key(named, ["key"], order).join(known, ["kind", "key"], "left_anti")
        append_once(fresh.select(*rows.columns), f"{out}/firsts", batch_id)
        written = rows.sparkSession.read.schema(rows.schema).parquet(f"{out}/firsts/batch={batch_id}")
        store.add(written.select(F.lit("key").alias("kind"), F.to_json(F.struct(*keys)).alias("key"), F.col(ts).alias("at")), batch_id)

    return job


def _start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def process_batch(
    docs: DataFrame, batch_id: int, out: str, sources: DataFrame, events: DataFrame,
    scorer: flow.Scorer = vd.keyword_scorer, now=None, max_age_hours: int = config.MAX_AGE_HOURS, seen_days: int = 30,
) -> None:
    """One micro-batch of fetched documents, through to the outbox.

    ``now`` is the batch's clock: by default its latest fetch time.
    """
    spark = docs.sparkSession
    docs = checkpointed(docs)
    if now is None:
        now = docs.agg(F.max("ts")).first()[0]
        if now is None:
            return
    items, errors = feeds.parse_feeds(docs, sources, now)
    append_once(errors, f"{out}/errors", batch_id)

    keyed = checkpointed(flow.payload_firsts(dedupe.with_keys(pf.category_filter(items, sources))))
    accepted = appended(spark, f"{out}/accepted", ACCEPTED, before=batch_id)
    known = appended(spark, f"{out}/sources", "source_id string", before=batch_id).distinct()
    remembered = accepted.where(F.col("fetched_at") > tm.shift(tm.instant(now), -seen_days * 86_400))
    kept = dedupe.dedupe_two_key(keyed, flow.ORDER, seen=dedupe.touching(remembered, keyed))
    append_once(kept.select(*keyed.columns), f"{out}/accepted", batch_id)
    append_once(keyed.select("source_id").distinct(), f"{out}/sources", batch_id)

    # From here on, work on what was written: the lineage ends at the table.
    stored = spark.read.schema(ACCEPTED).parquet(f"{out}/accepted/batch={batch_id}")
    newcomers = keyed.join(known, "source_id", "left_anti")
    first = newcomers.groupBy("source_id").agg(F.min("fetched_at").alias("_first"))
    fresh = stored.join(first, "source_id", "left").where("_first is null or fetched_at > _first").select(*stored.columns)
    passed = pf.prefilter(fresh).where("pass")
    # Candidates the scorer left unanswered come again, as long as they are young enough.
    again = appended(spark, f"{out}/pending", CANDIDATES, before=batch_id, after=batch_id - 2)
    waiting = passed.withColumn("id", F.xxhash64("url_key")).select(*again.columns).unionByName(again)
    timely, late = queue.split_late(waiting, now, max_age_hours)
    append_once(late, f"{out}/late", batch_id)
    append_once(timely, f"{out}/candidates", batch_id)

    cands = spark.read.schema(CANDIDATES).parquet(f"{out}/candidates/batch={batch_id}")
    result = flow.alerts_from(
        cands, events, scorer, sources=sources,
        history=appended(spark, f"{out}/alerts", ALERTS, before=batch_id),
        prior_sources=appended(spark, f"{out}/deal_sources", DEAL_SOURCES, before=batch_id),
    )
    append_once(result.pending.select(*cands.columns), f"{out}/pending", batch_id)
    append_once(result.rejected, f"{out}/rejected", batch_id)
    append_once(checkpointed(result.outbox), f"{out}/outbox", batch_id)
    append_once(result.alerts.select("deal_key", "emit_ts"), f"{out}/alerts", batch_id)
    append_once(dl.merge_sources(result.reports).drop("first_reported_at"), f"{out}/deal_sources", batch_id)


def run_stream(
    docs: DataFrame, out: str, checkpoint: str, sources: DataFrame, events: DataFrame,
    scorer: flow.Scorer = vd.keyword_scorer, now=None, max_age_hours: int = config.MAX_AGE_HOURS, **trigger,
) -> StreamingQuery:
    """Run ``process_batch`` on a stream of documents (``read_fetch_log(streaming=True)``)."""
    return _start(
        docs,
        lambda batch, batch_id: process_batch(batch, batch_id, out, sources, events, scorer, now, max_age_hours),
        checkpoint, trigger,
    )
