"""Near-duplicate groups: bottom-k sketches, inverted lists, exact Jaccard.

1. A text's shingles are hashed by one function; the sketch is its ``k`` smallest
   hashes. Texts with equal shingle sets form a class and go on as one.
2. Two sets with the wanted similarity share so many of their retained hashes that
   each class may leave out its most frequent ones and a shared one still remains in
   both lists (prefix filtering). Hot hashes of common passages so drop out of the lists.
3. Classes are first compared with the lowest class of each list only. A pair passes if
   the sketch of the union estimates enough similarity, and becomes a link if the
   full sets confirm it. Linked classes are merged into components.
4. Only lists that then still hold several components are compared further, between
   components. Pairs inside a component cannot change the result and are never made, nor
   are pairs that the shingles found in one class alone rule out. Long lists go through
   rounds of a linear number of pairs first: each class meets its list's hub, the class
   with fewest shingles of its own, and a few classes drawn by hash. Components found so
   leave little of a large group for the comparison of all that remains.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wirepulse.llm import bloom
from wirepulse.llm.rows import text_map
from wirepulse.llm.shingles import mix, shingles
from wirepulse.session import checkpointed, written

#: Words of a shingle, similarity in hundredths, hashes a sketch retains.
WORDS, PERCENT, RETAINED = 5, 85, 64
#: Hashes whose frequency is told to every task: bounds what is broadcast, not what is compared.
HOT_HASHES = 1 << 16
#: Flips a hash's top bit, so that sketches stored as signed longs keep the order of the unsigned hashes.
TOP_BIT = np.uint64(1 << 63)
#: Standard deviations by which a sketch may fall short of the wanted similarity.
SLACK = 6.0


#: Length from which a list first loses the classes that cannot have a link in it.
LONG_LIST = 64
#: Most classes of the long lists that hold a shingle called rare.
RARE = 16
#: In a round, a class of a long list meets one class of each of ``DRAWS`` groups of about ``GROUP``.
GROUP, DRAWS = 16, 4


def overlap_floor(size: int, percent: int, retained: int) -> int:
    """Retained hashes that two similar sets share at least, of ``size`` in one's sketch.

    A set so small that every similar one is retained whole, too, shares its exact part.
    """
    if 100 * size <= percent * retained:
        return max(1, -(-size * percent // 100))
    share = percent / 100
    return max(1, math.floor(share * size - SLACK * math.sqrt(share * (1 - share) * size)))


def _describe(size: int, retained: int):
    def describe(text: str) -> tuple:
        hashes = shingles(text, size)
        if not len(hashes):
            return 0, None, None
        key = np.array([np.add.reduce(hashes), np.bitwise_xor.reduce(mix(hashes + np.uint64(1)))], np.uint64).tobytes()
        return len(hashes), key + len(hashes).to_bytes(6, "little"), (hashes[:retained] ^ TOP_BIT).view(np.int64)

    return describe


def _sets(size: int):
    def full(text: str) -> tuple:
        return shingles(text, size).view(np.int64), _describe(size, 1)(text)[1]

    return full


def _postings(reps: DataFrame, percent: int, retained: int) -> DataFrame:
    """``(value, cid)``: the retained hashes each class lists, the most frequent left out.

    The order is one for all classes: by frequency where that is known (the
    ``HOT_HASHES`` most frequent hashes), then by value.
    """
    counts = reps.select(F.explode("sketch").alias("value")).groupBy("value").count().where("count > 8")
    top = counts.orderBy(F.desc("count"), "value").limit(HOT_HASHES).collect()
    top.sort(key=lambda r: r["value"])
    hot = np.array([r["value"] for r in top], np.int64)
    often = np.array([r["count"] for r in top], np.int64)
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("value", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for cid, sketch in zip(batch.column(0).to_pylist(), batch.column(1)):
                sketch = sketch.values.to_numpy(zero_copy_only=False)
                rank = np.zeros(len(sketch), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, sketch), len(hot) - 1)
                    rank = np.where(hot[at] == sketch, often[at], 0)
                order = np.lexsort((sketch, rank))
                listed = sketch[order[: len(sketch) - overlap_floor(len(sketch), percent, retained) + 1]]
                ids.append(np.full(len(listed), cid, np.int64))
                values.append(listed)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(values))], names=["cid", "value"])

    return reps.select("cid", "sketch").mapInArrow(run, schema)


def _union_sketch(retained: int) -> tuple[Column, Column]:
    """How many hashes of the union's sketch both sets hold, and its size, from the sketches ``s_a`` and ``s_b``."""
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, retained)
    return F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b"))), F.size(union)


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int, retained: int) -> DataFrame:
    """Pairs whose union sketch does not rule the similarity out."""
    left = reps.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = reps.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    shared, size = _union_sketch(retained)
    share = percent / 100
    floor = share * size - SLACK * F.sqrt(share * (1 - share) * size)
    return both.where(shared >= floor).select("a", "b")


def _full_sets(wanted: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``(cid, items)``: the whole shingle sets of the classes in ``wanted (cid, key, fp)``.

    Only their texts are read again: a Bloom filter of fixed size drops the others in
    the scan, an exact join the rest.
    """
    probed = bloom.probe(texts, F.col("key"), bloom.build(wanted, F.col("key")), "possible").where("possible")
    chosen = probed.select("key", "text").join(wanted.select("key").distinct(), "key").dropDuplicates(["key", "text"])
    sets = text_map(chosen, "key", "text", [("items", T.ArrayType(T.LongType())), ("fp", T.BinaryType())], lambda: _sets(words))
    return wanted.join(sets, ["key", "fp"]).select("cid", "items")


def _sets_of(pairs: DataFrame, reps: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``(cid, items)`` of the classes in ``pairs (a, b)``."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    return _full_sets(checkpointed(members.join(reps.select("cid", "key", "fp"), "cid")), texts, words)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links: pairs whose full shingle sets, given as ``sets (cid, items)``, reach the similarity."""
    left, right = (sets.select(F.col("cid").alias(x), F.col("items").alias(f"items_{x}")) for x in ("a", "b"))
    met = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return met.select("a", "b", shared.alias("shared"), (F.size("items_a") + F.size("items_b")).alias("total")).where(
        100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))
    ).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node reachable, for every node in ``edges (a, b)``.

    Each round takes the least label among neighbours and then that label's own label,
    so distances halve; labels are written out between rounds.
    """
    both = written(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("via"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        moved = written(lower.join(hop, "via").select("node", "was", F.least("via", "next").alias("label")))
        changed = moved.where("label <> was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, retained: int = RETAINED,
) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    Texts are linked where ``100 * shared >= percent * union`` over their shingle sets;
    ``component_id`` is the smallest id of a component and ``kept`` marks its row. Null,
    empty and wordless texts have no shingles and stand alone. Rows with a null id
    take part with their text; a component of such rows only has a null
    ``component_id`` and its rows are kept. Rows that repeat an id and its text are one
    document: all of them carry the same values. Other columns are not read; an
    empty table gives an empty result.
    """
    found = near_duplicate_rows(df, id_col, text_col, words, percent, retained)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def near_duplicate_rows(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT, retained: int = RETAINED) -> DataFrame:
    """As :func:`near_duplicates`, with ``key``, the hash of text and id that finds a row again."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text", "id"))
    fields = [("n", T.LongType()), ("fp", T.BinaryType()), ("sketch", T.ArrayType(T.LongType()))]
    described = text_map(texts.select(F.struct("id", "key").alias("of"), "text"), "of", "text", fields, lambda: _describe(words, retained))
    rows = checkpointed(described.select("of.id", "of.key", "n", "fp", "sketch", F.monotonically_increasing_id().alias("rid")))
    classes = rows.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("id").alias("least"), F.min("rid").alias("cid"))
    is_rep = F.col("rid") == F.col("cid")
    joined = checkpointed(
        rows.where(F.col("fp").isNotNull()).join(classes, "fp").select(
            "id", "n", "cid", "least", "key", is_rep.alias("rep"), F.when(is_rep, F.col("fp")).alias("fp"),
            F.when(is_rep, F.col("sketch")).alias("sketch"),
        )
    )
    reps = joined.where("rep").drop("id", "rep")
    labels = class_labels(reps, texts, words, percent, retained)
    merged = reps.select("cid", "least").join(labels, F.col("cid") == F.col("node"))
    lowest = merged.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = merged.join(lowest, "label").select("cid", "component_id")
    known = joined.select("id", "key", "n", "cid", "least").join(placed, "cid", "left").select("id", "key", "n", F.coalesce("component_id", "least").alias("component_id"))
    alone = rows.where(F.col("fp").isNull()).select("id", "key", "n", F.col("id").alias("component_id"))
    return known.unionAll(alone).select(
        "id", "key", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def class_labels(reps: DataFrame, texts: DataFrame, words: int, percent: int, retained: int) -> DataFrame:
    """``(node, label)`` of the classes that have a link."""
    lists = checkpointed(_postings(reps, percent, retained))
    centres = lists.groupBy("value").agg(F.min("cid").alias("a"), F.max("cid").alias("last")).where("a <> last").select("value", "a")
    first = checkpointed(lists.join(centres, "value").where("cid <> a").select("a", F.col("cid").alias("b")).distinct())
    likely = checkpointed(_estimated(first, reps, percent, retained))
    links = checkpointed(_confirmed(likely, _sets_of(likely, reps, texts, words), percent))
    mixed = checkpointed(_mixed(_labelled(lists, components(links))))
    long, merging = _merged(mixed.where(F.col("length") > LONG_LIST), reps, texts, percent, words, retained)
    links = checkpointed(links.unionAll(merging))
    short = mixed.where(F.col("length") <= LONG_LIST).join(reps.select("cid", "n", F.lit(0).cast("long").alias("own")), "cid")
    columns = ["value", "cid", "n", "own"]
    rest = checkpointed(_mixed(_labelled(short.select(columns).unionAll(long.select(columns)), components(links))))
    x = rest.where("label <> main").select("value", *(F.col(c).alias(f"{c}_x") for c in ("cid", "label", "n", "own")))
    y = rest.select("value", *(F.col(c).alias(f"{c}_y") for c in ("cid", "label", "n", "own")), (F.col("label") == F.col("main")).alias("central"))
    across = x.join(y, "value").where((F.col("label_x") != F.col("label_y")) & (F.col("central") | (F.col("cid_x") < F.col("cid_y"))) & _possible(percent))
    second = across.select(F.least("cid_x", "cid_y").alias("a"), F.greatest("cid_x", "cid_y").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    likely = checkpointed(_estimated(second, reps, percent, retained))
    more = _confirmed(likely, _sets_of(likely, reps, texts, words), percent)
    return components(checkpointed(links.unionAll(more)))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of ``cid``, which is ``cid`` itself where it has no link."""
    return rows.join(labels, F.col("cid") == F.col("node"), "left").select(*rows.columns, F.coalesce("label", "cid").alias("label"))


def _mixed(named: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, with ``main``, the lowest of them, and the list's ``length``."""
    columns = [c for c in named.columns if c not in ("main", "length")]
    ends = named.groupBy("value").agg(F.min("label").alias("main"), F.max("label").alias("other"), F.count("*").alias("length"))
    return named.select(*columns).join(ends.where("main <> other").drop("other"), "value")


def _possible(percent: int) -> Column:
    """Whether ``x`` and ``y`` may be similar, given that the ``own`` shingles of each are not the other's."""
    most = F.least(F.col("n_x") - F.col("own_x"), F.col("n_y") - F.col("own_y"))
    return 100 * most >= percent * (F.col("n_x") + F.col("n_y") - most)


def _able(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of mixed lists less those that have too many own shingles for any partner in their list."""
    least = rows.groupBy("value").agg(F.min("n").alias("least_n"), F.min("own").alias("least_own"))
    shared = F.col("n") - F.col("own")
    union = F.greatest(F.col("own") + F.col("least_n"), F.col("n") + F.col("least_own"))
    return _mixed(rows.join(least, "value").where(100 * shared >= percent * union).drop("least_n", "least_own"))


def _own_shingles(wanted: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cid, own)``, the number of rare shingles of each class, and the pairs ``(a, b)`` that share a rare one.

    A shingle held by at most ``RARE`` classes of ``wanted`` is rare, so the pairs are
    few. Any other pair has the rare shingles of both in its union and none in common.
    """
    items = sets.select("cid", F.explode("items").alias("item"))
    rare = items.groupBy("item").agg(F.count("*").alias("holders")).where(F.col("holders") <= RARE)
    held = checkpointed(items.join(rare, "item"))
    tagged = held.where("holders > 1").select("item", "cid").join(wanted.select("cid", "label"), "cid")
    left = tagged.select("item", F.col("cid").alias("a"), F.col("label").alias("label_a"))
    right = tagged.select("item", F.col("cid").alias("b"), F.col("label").alias("label_b"))
    near = left.join(right, "item").where("a < b AND label_a <> label_b").select("a", "b").distinct()
    return held.groupBy("cid").agg(F.count("*").alias("own")), near


def _drawn(rows: DataFrame, hubs: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of a round, a bounded number for each row: with the list's hub and with classes drawn by hash.

    Groups and draws do not depend on the list, so that two classes which share many lists mostly meet once.
    """
    groups = F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(F.col("length") / GROUP))).cast("long"))
    dealt = rows.select("*", F.explode(F.array(*(F.lit(turn * DRAWS + k) for k in range(DRAWS)))).alias("draw"))
    dealt = dealt.select("*", F.pmod(F.xxhash64("cid", "draw"), groups).alias("group"))
    one = F.struct(F.col("cid").alias("cid_x"), F.col("label").alias("label_x"), F.col("n").alias("n_x"), F.col("own").alias("own_x"))
    drawn = dealt.groupBy("value", "draw", "group").agg(F.min_by(one, F.struct(F.xxhash64("draw", "cid"), "cid")).alias("one"))
    other = [F.col(c).alias(f"{c}_y") for c in ("cid", "label", "n", "own")]
    met = dealt.join(drawn, ["value", "draw", "group"]).select("one.*", *other).unionAll(rows.join(hubs, "value").select("hub.*", *other))
    return met.where((F.col("label_x") != F.col("label_y")) & _possible(percent)).select(
        F.least("cid_x", "cid_y").alias("a"), F.greatest("cid_x", "cid_y").alias("b")
    ).distinct()


def _merged(lists: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, words: int, retained: int) -> tuple[DataFrame, DataFrame]:
    """What the rounds leave of long mixed lists ``(value, cid, label)``, with ``n`` and ``own``, and the links they found.

    The rounds go on while they at least halve the pairs left and these outnumber the
    rows by more than ``LONG_LIST``. A hub has met its whole list and leaves it. Nothing is
    lost: whatever rows remain are still to be compared with one another.
    """
    wanted = written(lists.select("cid", "label").distinct().join(reps.select("cid", "key", "fp", "n"), "cid"))
    sets = written(_full_sets(wanted.select("cid", "key", "fp"), texts, words))
    own, near = _own_shingles(wanted, sets)
    profile = wanted.select("cid", "n").join(own, "cid", "left").select("cid", "n", F.coalesce("own", F.lit(0)).alias("own"))
    rows = written(_able(lists.select("value", "cid", "label").join(profile, "cid"), percent))
    links, turn, before = _confirmed(near, sets, percent), 0, math.inf
    while True:
        size, left = rows.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("label") != F.col("main"), F.col("length"))), F.lit(0))).first()
        if not size or turn and (left <= LONG_LIST * size or 2 * left > before):
            return rows, links
        one = F.struct(F.col("cid").alias("cid_x"), F.col("label").alias("label_x"), F.col("n").alias("n_x"), F.col("own").alias("own_x"))
        hubs = checkpointed(rows.groupBy("value").agg(F.min_by(one, F.struct("own", "n", "cid")).alias("hub")))
        pairs = checkpointed(_estimated(_drawn(rows, hubs, turn, percent), reps, percent, retained))
        links = checkpointed(links.unionAll(_confirmed(pairs, sets, percent)))
        unsettled = rows.join(hubs.select("value", F.col("hub.cid_x").alias("cid")), ["value", "cid"], "left_anti")
        old = wanted.select("cid", "label")
        merged = links.join(old.select(F.col("cid").alias("a"), F.col("label").alias("label_a")), "a").join(
            old.select(F.col("cid").alias("b"), F.col("label").alias("label_b")), "b").where("label_a <> label_b")
        renamed = components(merged.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
        current = old.join(renamed.withColumnRenamed("label", "lowest"), F.col("label") == F.col("node"), "left").select(
            "cid", F.coalesce("lowest", "label").alias("label")
        )
        rows = written(_able(_mixed(unsettled.drop("label").join(current, "cid")), percent))
        turn, before = turn + 1, left
