"""Removing repeats: single key, two keys at once, and the bootstrap gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wirepulse.functions import text as tx
from wirepulse.session import discard, written


def with_keys(items: DataFrame) -> DataFrame:
    """Add ``url_key`` and ``title_key`` (the URL key where the title is too short)."""
    return items.withColumn("url_key", tx.url_key(F.col("link"))).withColumn(
        "title_key", F.coalesce(tx.title_key(F.col("title")), F.col("url_key"))
    )


def first_per_key(items: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of each key group.

    An aggregate rather than a window: copies of a hot key are reduced on the
    map side, so no task ever sees them all.
    """
    rest = [c for c in items.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return items.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*items.columns)


def dedupe_url(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per canonical address."""
    return first_per_key(items, ["url_key"], order)


def anti_seen(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items neither of whose keys is recorded in ``seen``."""
    return items.join(seen.select("url_key").distinct(), "url_key", "left_anti").join(
        seen.select("title_key").distinct(), "title_key", "left_anti"
    ).select(*items.columns)


def touching(seen: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``seen`` that share a key with a (small) batch of items.

    A long history is then reduced to its matches before it is joined; whether the
    keys are broadcast is left to the planner, which knows their size in bytes.
    """
    def known(key: str) -> DataFrame:
        return seen.join(items.select(key).distinct(), key, "left_semi").select("url_key", "title_key")

    return known("url_key").unionByName(known("title_key"))


def both_keys(items: DataFrame, *more: Column) -> DataFrame:
    """A row (kind, key, and ``more``) for the URL key and one for the title key of every item; null keys are none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_key").alias("key")) for k in ("url", "title")])
    return items.select(F.inline(pairs), *more).where("key is not null")


def insert_if_absent(target: DataFrame, updates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``target`` plus the first update of every key it does not have yet."""
    fresh = first_per_key(updates, [key], order).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


# ---------------------------------------------------------------- two keys



def dedupe_two_key(items: DataFrame, order: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """First-wins on two keys: keep a row iff neither its ``url_key`` nor its
    ``title_key`` belongs to an earlier *kept* row (or to ``seen``).

    A dropped row reserves nothing, so this is a greedy matching and not two
    chained dedupes. ``order`` must be a total order. Rows equal on both keys
    collapse to their earliest first, on the map side, and what is left is sorted
    once, so that one number stands for a row and its rank; a key becomes the number of
    its earliest row, so the strings are shuffled no more. Then, in rounds over numbers:

    1. a row that is the earliest on both keys is kept;
    2. where the round before left more than half of its rows: a row with exactly one
       earlier rival has the opposite fate of that rival, so whole chains of such
       rows are settled from their end by pointer doubling;
    3. rows that share a key with a kept row go.

    Every step joins against one row per key or per undecided row, at any size.
    """
    rank = F.struct(*order).alias("rank")
    pairs = items.select("url_key", "title_key", rank).groupBy("url_key", "title_key").agg(F.min("rank").alias("rank"))
    if seen is not None:
        pairs = anti_seen(pairs, seen)
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = written(
        pairs.repartitionByRange(parts, "rank").sortWithinPartitions("rank").withColumn("node", F.monotonically_increasing_id())
    )
    undecided, kept = written(_numbered(ranked.drop("rank"))), []
    before, left = 0, undecided.count()
    while left:
        winners = written(_settled(undecided) if before and 2 * left > before else _earliest(undecided))
        kept.append(winners.select("node"))
        rest = written(anti_seen(undecided, winners))
        discard(undecided)
        undecided, before, left = rest, left, rest.count()
    if not kept:
        return items.limit(0)
    # The rank identifies a row (a code of its keys would tell equal ranks apart): fetch the kept rows back in full.
    code = F.xxhash64("url_key", "title_key")
    found = ranked.select("node", "rank", code.alias("_code")).join(reduce(DataFrame.unionByName, kept), "node", "left_semi")
    flat = found.select(F.col("_code").alias("__code"), *[F.col(f"rank.{c}").alias(f"_{c}") for c in order])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ["_code", *order]])
    return items.withColumn("_code", code).join(flat, same, "left_semi").select(*items.columns)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (url_key, title_key, node) with the number of its earliest row in place of each key, their own for a null key."""
    for key in ("url_key", "title_key"):
        firsts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("node").alias("_first"))
        rows = rows.join(firsts, key, "left").withColumn(key, F.coalesce("_first", "node")).drop("_first")
    return rows.select("url_key", "title_key", "node")


def _earliest(rows: DataFrame) -> DataFrame:
    """Rows that are the earliest on both of their keys."""
    by_url = rows.groupBy("url_key").agg(F.min("node").alias("node"))
    by_title = rows.groupBy("title_key").agg(F.min("node").alias("node"))
    return by_url.join(by_title, "node").select(*rows.columns)


def _places(rows: DataFrame, key: str) -> DataFrame:
    """The earliest row of every key, and the one after it with the earliest as its rival."""
    first = rows.groupBy(key).agg(F.min("node").alias("one"))
    rest = rows.select(key, "node").join(first, key).where(F.col("node") != F.col("one"))
    second = rest.groupBy(key).agg(F.min("node").alias("node"), F.min("one").alias("rival"))
    return first.select(F.col("one").alias("node"), F.lit(None).cast("bigint").alias("rival")).unionByName(second.select("node", "rival"))


def _settled(rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` that are certainly kept, at least the earliest one."""
    places = _places(rows, "url_key").unionByName(_places(rows, "title_key"))
    known = written(
        places.groupBy("node").agg(F.count_if(F.col("rival").isNull()).alias("firsts"), F.max("rival").alias("rival")).where("firsts > 0")
        .where("firsts = 2 or rival is not null").select("node", "rival")
    )
    free = known.where("rival is null").select("node")
    ends = chain_ends(known.where("rival is not null").select("node", F.col("rival").alias("to"), F.lit(True).alias("opposite")))
    even = ends.where("not opposite").join(free.withColumnRenamed("node", "to"), "to", "left_semi").select("node")
    return rows.join(free.unionByName(even), "node", "left_semi").select(*rows.columns)


def chain_ends(chains: DataFrame) -> DataFrame:
    """For pointers (node, to, opposite) without cycles: the node where each one's way ends, and whether it is opposite to it.

    By pointer doubling. Every pass over all pointers would shuffle them as many times as the longest way has bits; so
    they first only go on to the next post, one node in sixteen by hash, and the rest of the way is between posts.
    """
    to_post = _doubled(chains, _is_post)
    posts = _doubled(to_post.where(_is_post("node")), lambda _: F.lit(False))
    return _onward(to_post, posts).drop("went")


def _is_post(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(16)) == 0


def _doubled(chains: DataFrame, stop: Callable[[str], Column]) -> DataFrame:
    """Pointers moved on until they come to a node that has none, or one where ``stop`` holds."""
    moved = written(chains.withColumn("went", F.lit(True)))
    done: list[DataFrame] = []
    while True:
        moving = F.col("went") & ~stop("to")
        done.append(moved.where(~moving).drop("went"))
        active = moved.where(moving).drop("went")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)
        known = reduce(DataFrame.unionByName, [active, *done])
        moved = written(_onward(active, known.where(~stop("node"))))


def _onward(pointers: DataFrame, known: DataFrame) -> DataFrame:
    """Pointers replaced by what their targets point at, where these point at something."""
    ahead = known.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("opposite").alias("then"))
    return pointers.join(ahead, "to", "left").select(
        "node", F.coalesce("next", "to").alias("to"), (F.col("opposite") != F.coalesce("then", F.lit(False))).alias("opposite"),
        F.col("next").isNotNull().alias("went"),
    )


def bootstrap_gate(items: DataFrame, fresh: DataFrame | None = None, by: str = "fetched_at") -> DataFrame:
    """Drop the rows of each source's first payload.

    ``items`` is every row that arrived (after the category filter, so a payload
    that filter empties does not count as the first); ``fresh`` the rows to
    gate, by default the same ones.
    """
    firsts = items.groupBy("source_id").agg(F.min(by).alias("_first"))
    fresh = items if fresh is None else fresh
    return fresh.join(firsts, "source_id").where(F.col(by) > F.col("_first")).select(*fresh.columns)


def duplicate_counts(items: DataFrame, kept: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Per payload: distinct rows, rows kept, and duplicates of known stories.

    Repeats of an address inside one payload are not duplicates.
    """
    distinct = items.groupBy(*payload, "url_key").agg(F.lit(1).alias("_one")).groupBy(*payload).agg(
        F.count("*").alias("n_items")
    )
    accepted = kept.groupBy(*payload).agg(F.count("*").alias("n_kept"))
    return distinct.join(accepted, list(payload), "left").select(
        *payload, "n_items", F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        (F.col("n_items") - F.coalesce("n_kept", F.lit(0))).alias("duplicates"),
    )
