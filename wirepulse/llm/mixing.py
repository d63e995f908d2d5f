"""Mixing sources to target weights.

Source shares of all tokens are raised to an exponent and normalised; the exponent is
bisected until the weights reach a target entropy, or until no source is repeated more
often than a limit, whichever asks for weights nearer the natural ones. A source's
part of the budget is then spent on permutations of its documents: whole ones, and
the beginning of a last one. Built-in expressions throughout. Texts are not shuffled:
what a document contributes follows from its hash and its source's two numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirepulse.session import checkpointed

#: Entropy of the weights, as a share of the natural entropy's way to the largest (0: natural, 1: equal weights).
EVENNESS = 0.5
#: Most times a source's tokens may be used.
REPEATS = 4.0
#: Rows in a slice of a permutation; the one slice where the budget ends is put in order.
SLICE_ROWS = 10_000
#: Exponents tried per pass; each pass narrows the bracket that many times.
SECTIONS = 32


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _place(id_col: Column, block: Column, seed: int) -> Column:
    """Place of a document in a block's permutation, as a whole number below 2^62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), block, id_col.cast("string")), 2)


def source_tokens(rows: DataFrame) -> DataFrame:
    """``(source, n_rows, tokens)`` of ``rows (source, tokens)``, one row per source."""
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("tokens"))


def _measure(totals: DataFrame, exponents: list[float], budget: float) -> dict[float, tuple[float, float]]:
    """Entropy of the weights and largest repetition at each exponent, in one pass over the sources."""
    tried = F.explode(F.array(*(F.lit(float(e)) for e in exponents))).alias("exponent")
    each = totals.where("tokens > 0").select("tokens", "share", tried)
    scaled = F.exp(F.col("exponent") * F.log("share"))
    sums = each.withColumn("scaled", scaled).groupBy("exponent").agg(
        F.sum("scaled").alias("z"), F.sum(F.col("scaled") * F.log("share")).alias("zlog"), F.max(F.col("scaled") / F.col("tokens")).alias("densest"),
    )
    return {
        r.exponent: (math.log(r.z) - r.exponent * r.zlog / r.z, r.densest / r.z * budget) for r in sums.collect()
    }


def solve_exponent(totals: DataFrame, budget: float, entropy: float | None, repeats: float | None) -> float:
    """The least exponent in [0, 1] whose weights have at most ``entropy`` and repeat no source over ``repeats``.

    Entropy falls and, towards 1, so does the largest repetition, so one bracket serves
    both. Only numbers per tried exponent reach the driver.
    """

    def fits(found: tuple[float, float]) -> bool:
        return (entropy is None or found[0] <= entropy + 1e-12) and (repeats is None or found[1] <= repeats * (1 + 1e-12))

    low, high = 0.0, 1.0
    while high - low > 1e-9:
        tried = [low + (high - low) * k / SECTIONS for k in range(SECTIONS)]
        found = _measure(totals, tried, budget)
        good = [e for e in tried if e in found and fits(found[e])]
        if not found or (good and good[0] == 0.0):
            return 0.0
        first = good[0] if good else high
        low, high = max(e for e in tried if e < first), first
    return high


def weigh(rows: DataFrame, budget: int | None, evenness: float | None = EVENNESS, repeats: float | None = REPEATS) -> DataFrame:
    """``(source, n_rows, tokens, weight, quota, whole, rest)`` per source, checkpointed.

    ``quota`` is the source's part of the budget in tokens (all tokens by default), ``whole``
    the permutations it uses entirely and ``rest`` what is left for the last one.
    ``evenness`` sets the target entropy between the natural one and that of equal weights. Where
    even the natural weights repeat a source more than ``repeats`` times, they are used.
    """
    totals = source_tokens(rows)
    everything = totals.agg(F.sum("tokens").alias("tokens"), F.count(F.when(F.col("tokens") > 0, 1)).alias("n")).first()
    whole = float(everything.tokens or 0)
    spend = float(whole if budget is None else budget)
    shared = checkpointed(totals.withColumn("share", F.col("tokens") / F.lit(max(whole, 1.0))))
    natural = _measure(shared, [1.0], spend).get(1.0, (0.0, 0.0))[0]
    target = None if evenness is None else natural + evenness * (math.log(max(everything.n, 1)) - natural)
    exponent = solve_exponent(shared, spend, target, repeats)
    scaled = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * F.log("share"))).otherwise(F.lit(0.0))
    norm = shared.agg(F.sum(scaled)).first()[0] or 1.0
    quota = F.col("weight") * F.lit(spend)
    weighted = shared.withColumn("weight", scaled / F.lit(float(norm))).withColumn("quota", quota)
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(F.lit(0)).cast("int")
    return checkpointed(
        weighted.withColumn("whole", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("whole") * F.col("tokens"))).drop("share")
    )


def cut_points(rows: DataFrame, weights: DataFrame, seed: int) -> DataFrame:
    """``weights`` with ``cut``: the last block takes the documents placed up to it (-1: none).

    A document is taken as long as the tokens placed before it are under ``rest``. Slices of
    the permutation are summed first; only the rows of the slice in which the budget
    ends are put in order, so a hot source costs one slice and not its size.
    """
    keyed = weights.where("rest > 0").select("source", "whole", "rest", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / SLICE_ROWS)).cast("long").alias("slices"))
    placed = (
        rows.join(keyed, F.col("source_key").eqNullSafe(F.col("source")))
        .withColumn("place", _place(F.col("id"), F.col("whole"), seed))
        .withColumn("slice", F.floor(F.col("place") / F.lit(float(1 << 62)) * F.col("slices")).cast("long"))
    )
    slices = placed.groupBy("source", "slice", "rest").agg(F.sum("tokens").alias("tokens"))
    ahead = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The last slice that begins under the budget.
    ending = slices.withColumn("ahead", ahead).where("ahead < rest").groupBy("source").agg(F.max("slice").alias("end_slice"), F.max("ahead").alias("end_ahead"))
    inside = placed.join(ending.withColumnRenamed("source", "end_source"), F.col("source").eqNullSafe(F.col("end_source")) & (F.col("slice") == F.col("end_slice")))
    steps = inside.groupBy("source", "place", "rest", "end_ahead").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = steps.withColumn("before", before + F.col("end_ahead")).where("before < rest").groupBy("source").agg(F.max("place").alias("cut"))
    joined = weights.join(cuts.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return checkpointed(joined.drop("cut_source").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long"))))


#: Most sources whose weights are broadcast; with more, rows meet them in a shuffle join.
BROADCAST_SOURCES = 100_000


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None,
    evenness: float | None = EVENNESS, repeats: float | None = REPEATS, seed: int = 0,
) -> DataFrame:
    """The mixture: ``row`` (the input row as a struct) with ``source, block, place, n_tokens, weight, mix_key``.

    One row for every use of a document; ``block`` numbers the permutation and ``place``
    is its place there. Sorting by ``mix_key`` interleaves the sources by their weights.
    Null sources are a source of their own; null and empty texts have no tokens and go
    with their places; rows that repeat an id share a place and are used together;
    an empty table gives an empty result; extra columns stay inside ``row``.
    """
    packed = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source_key"), token_count(F.col(text_col)).alias("tokens"))
    narrow = checkpointed(packed.select("id", "source_key", "tokens"))
    weights = weigh(narrow.select(F.col("source_key").alias("source"), "tokens"), budget, evenness, repeats)
    ready = cut_points(narrow, weights, seed)
    side = ready.select("source", "weight", "quota", F.col("tokens").alias("source_tokens"), "whole", "cut")
    if ready.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    met = packed.join(side, F.col("source_key").eqNullSafe(F.col("source")))
    last = F.when(_place(F.col("id"), F.col("whole"), seed) <= F.col("cut"), F.lit(1)).otherwise(F.lit(0))
    uses = F.col("whole") + last
    used = met.where(uses > 0).select(
        "row", "id", "source", "weight", "quota", "source_tokens", F.col("tokens").alias("n_tokens"), F.explode(F.sequence(F.lit(0), uses - 1)).alias("block"),
    )
    placed = used.withColumn("place", _place(F.col("id"), F.col("block"), seed))
    along = (F.col("block") + F.col("place") / F.lit(float(1 << 62))) * F.col("source_tokens") / F.col("quota")
    return placed.select("row", "source", "block", "place", "n_tokens", "weight", along.alias("mix_key"))


def mixing_report(docs: DataFrame) -> DataFrame:
    """Every use of every document in the mixture."""
    return mix(docs).select("row.doc_id", "source", "block", "place", "n_tokens", "weight", "mix_key")
