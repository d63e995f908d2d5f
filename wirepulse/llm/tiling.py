"""Benchmark decontamination by greedy string tiling.

Seeds are windows of words. A Bloom filter of the benchmark's seeds, of fixed size,
picks out of each text the stretches that may be shared; an exact join on the seed finds
(text, item) candidates, and only those are tiled: the longest non-overlapping matches
are marked again and again, found by running Karp-Rabin hashes, until none of the
least length is left. An item whose words are covered enough is reported, in whatever
order its parts occur.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wirepulse.llm.rows import text_map
from wirepulse.llm.shingles import ALNUM, windows, words
from wirepulse.session import checkpointed

#: Least words of a tile, and share of an item's words (in hundredths) that tiles must cover.
TILE, PERCENT = 5, 50
#: Bits of the seed filter sent to every task: two megabytes up to a quarter of a million seeds,
#: then 64 bits a seed up to 32 megabytes, beyond which it only lets more through.
FILTER_BITS, WIDEST_FILTER = 1 << 24, 1 << 28


def _filter_bits(seeds: int) -> int:
    return min(WIDEST_FILTER, max(FILTER_BITS, 1 << max(0, 64 * seeds - 1).bit_length()))


def _filter(seeds: DataFrame, bits: int) -> tuple[dict[int, np.ndarray], list[int]]:
    """The seed filter as a bit table per seed length, from at most ``bits / 32`` rows of 32 bits each."""
    slot = F.pmod(F.col("seed"), F.lit(bits))
    cells = seeds.select("size", (slot / 32).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int")).alias("bit"))
    tables: dict[int, np.ndarray] = {}
    for row in cells.groupBy("size", "cell").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        tables.setdefault(row["size"], np.zeros(bits // 32, np.uint32))[row["cell"]] = row["bits"]
    return tables, sorted(tables)


def _item_words(tile: int):
    def split(text: str) -> tuple:
        hashes, starts, ends, data = words(text, ALNUM)
        size = min(tile, len(hashes))
        seeds = windows(hashes, size) if size else np.zeros(0, np.uint64)
        return [data[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends)], size, seeds.view(np.int64)

    return split


def _stretches(tables: dict[int, np.ndarray], bits: int):
    """Words of the stretches that may be shared, an empty word between two stretches, and their seeds."""

    def find(text: str) -> tuple:
        hashes, starts, ends, data = words(text, ALNUM)
        inside = np.zeros(len(hashes), bool)
        seeds = []
        for size, table in tables.items():
            values = windows(hashes, size)
            slot = (values.view(np.int64) % bits).astype(np.int64)
            hit = np.flatnonzero((table[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1)
            if len(hit):
                seeds.append(values[hit])
                for k in range(size):
                    inside[hit + k] = True
        if not seeds:
            return None, None
        at = np.flatnonzero(inside)
        parts, previous = [], at[0]
        for k in at.tolist():
            if k > previous + 1:
                parts.append("")
            parts.append(data[starts[k] : ends[k]].decode("utf-8", "replace"))
            previous = k
        return parts, np.unique(np.concatenate(seeds)).view(np.int64)

    return find


def tile_cover(pattern: list[str], text: list[str], least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(pattern start, text start, length)``, longest first, none overlapping.

    Each round looks for matches of one length: running hashes of all unmarked windows
    of the pattern are entered in a table, those of the text are looked up, hits are
    verified word by word and extended as far as they go. Matches at least twice as long
    as sought restart the search at their length; otherwise they are marked in order
    of length, and the sought length shrinks until it is the least. Empty words match nothing.
    """
    codes: dict[str, int] = {}
    a = [codes.setdefault(w, len(codes) + 1) for w in pattern]
    b = [codes.get(w, 0) for w in text]
    marked_a, marked_b = [False] * len(a), [not c for c in b]
    prime, base = (1 << 61) - 1, 1_000_003

    def running(seq: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
        value, run, lead = 0, 0, pow(base, size - 1, prime)
        for k, code in enumerate(seq):
            if marked[k]:
                value = run = 0
                continue
            if run >= size:
                value = (value - seq[k - size] * lead) % prime
            value, run = (value * base + code) % prime, run + 1
            if run >= size:
                yield k - size + 1, value

    tiles, size = [], max(least, min(20, len(a)))
    while True:
        table: dict[int, list[int]] = {}
        for at, value in running(a, marked_a, size):
            table.setdefault(value, []).append(at)
        matches, longest = [], 0
        for at, value in running(b, marked_b, size) if table else ():
            for start in table.get(value, ()):
                length = 0
                while (
                    start + length < len(a) and at + length < len(b) and a[start + length] == b[at + length]
                    and not marked_a[start + length] and not marked_b[at + length]
                ):
                    length += 1
                if length >= size:
                    matches.append((length, start, at))
                    longest = max(longest, length)
        if longest >= 2 * size:
            size = longest
            continue
        hidden = False
        for length, start, at in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if any(marked_a[start : start + length]) or any(marked_b[at : at + length]):
                hidden = True  # what is left of it may still be long enough
            else:
                marked_a[start : start + length] = marked_b[at : at + length] = [True] * length
                tiles.append((start, at, length))
        if hidden:
            continue
        if size == least:
            return sorted(tiles, key=lambda t: (-t[2], t[0], t[1]))
        size = max(least, size // 2)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", tile: int = TILE, percent: int = PERCENT, filter_bits: int | None = None,
) -> DataFrame:
    """``(id, row_key, item, covered, n_words, key, tiles)`` for every text that holds enough of an item.

    ``covered`` of an item's ``n_words`` words lie in tiles of at least ``tile`` words; an
    item of fewer words must occur whole. Null, empty and wordless texts and items are
    never reported; repeated texts and items each count; null ids are carried along
    (``row_key`` tells rows apart, ``key`` hashes text and id); other columns are not read; an empty table on
    either side gives an empty result. Words are runs of ASCII letters and digits
    and of other characters, A-Z folded. A text is read whole by one task, however long;
    only its stretches that may be shared go further. The filter's size follows the
    number of seeds unless given.
    """
    fields = [("item_words", T.ArrayType(T.StringType())), ("size", T.IntegerType()), ("seeds", T.ArrayType(T.LongType()))]
    numbered = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    items = checkpointed(
        text_map(numbered, "item", "text", fields, lambda: _item_words(tile)).where("size > 0").withColumn("item_key", F.monotonically_increasing_id())
    )
    seeds = items.select("item_key", "size", F.explode("seeds").alias("seed"))
    filter_bits = filter_bits or _filter_bits(items.agg(F.sum(F.size("seeds"))).first()[0] or 0)
    tables, _ = _filter(seeds, filter_bits)
    content = F.xxhash64(F.col(text_col).cast("string"), F.col(id_col)).alias("key")
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_key"), content).alias("of"), F.col(text_col).alias("text"))
    found_fields = [("parts", T.ArrayType(T.StringType())), ("found", T.ArrayType(T.LongType()))]
    stretches = checkpointed(
        text_map(keyed, "of", "text", found_fields, lambda: _stretches(tables, filter_bits)).where("found is not null").select("of.id", "of.row_key", "of.key", "parts", "found")
    )
    # Tiles that cover c words of an item hold at least (c / tile) of its seeds, so its most
    # widespread ones can be left out: enough rarer ones remain to meet every such text.
    each = seeds.distinct().join(seeds.groupBy("seed").agg(F.countDistinct("item_key").alias("spread")), "seed")
    rank = F.row_number().over(Window.partitionBy("item_key").orderBy("spread", "seed"))
    count = F.count("*").over(Window.partitionBy("item_key"))
    lengths = items.select("item_key", F.size("item_words").alias("n_words"))
    need = F.when(F.col("n_words") < tile, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_words") * percent / F.lit(100.0 * tile)) - F.col("repeats")))
    ranked = each.join(lengths, "item_key").withColumn("rank", rank).withColumn("distinct", count)
    ranked = ranked.withColumn("repeats", F.greatest(F.lit(0), F.col("n_words") - F.col("size") + 1 - F.col("distinct")))
    index = ranked.where(F.col("rank") <= F.col("distinct") - need + 1).select("seed", "item_key")
    met = stretches.select("row_key", F.explode("found").alias("seed")).join(index, "seed").select("row_key", "item_key").distinct()
    pairs = met.join(stretches.select("row_key", "id", "key", "parts"), "row_key").join(items.select("item_key", "item", "item_words"), "item_key")
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("row_key", T.LongType()),
        T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("covered", T.LongType()),
        T.StructField("n_words", T.LongType()), T.StructField("key", T.LongType()), T.StructField("tiles", T.ArrayType(T.ArrayType(T.LongType()))),
    ])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiled = []
            for pattern, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                tiled.append((tile_cover(pattern, text, min(tile, len(pattern))), len(pattern)))
            covered = [sum(t[2] for t in tiles) for tiles, _ in tiled]
            keep = [k for k, (_, n) in enumerate(tiled) if 100 * covered[k] >= (percent if n >= tile else 100) * n]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array([covered[k] for k in keep], pa.int64()),
                    pa.array([tiled[k][1] for k in keep], pa.int64()), batch.column(5).take(at),
                    pa.array([[list(t) for t in tiled[k][0]] for k in keep], pa.list_(pa.list_(pa.int64()))),
                ],
                names=schema.names,
            )

    return pairs.select("id", "row_key", "item", "item_words", "parts", "key").mapInArrow(judge, schema)
