"""A blocked Bloom filter as a table: 256 bits in four longs per block.

The number of blocks is a parameter, so the table has a proven size whatever the
number of keys: with more keys than it was sized for it lets more false hits through
and nothing else changes. Absent blocks are empty. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Blocks by default: 65,536 of 40 bytes, good for a million keys at under a hundredth of false hits.
BLOCKS = 1 << 16
WORDS = tuple(f"bloom_word{k}" for k in range(4))
BLOCK = "bloom_block"


#: Blocks up to which a filter is sent to every task (10 MB).
SENT = 1 << 18


def sized(keys: int) -> int:
    """Blocks for a number of keys: the least power of two with at most 16 keys a block, 64 at least."""
    return max(64, 1 << max(0, -(-keys // 16) - 1).bit_length())


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the four words, from twelve bits apiece of a second hash."""
    bits = F.xxhash64(key, F.lit("bits"))
    masks = []
    for k in range(4):
        part = F.shiftrightunsigned(bits, 12 * k)
        low, high = part.bitwiseAND(F.lit(63)).cast("int"), F.shiftrightunsigned(part, 6).bitwiseAND(F.lit(63)).cast("int")
        masks.append(F.call_function("shiftleft", F.lit(1).cast("long"), low).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), high)))
    return masks


def build(keys: DataFrame, key: Column, blocks: int = BLOCKS) -> DataFrame:
    """One row per block that has a bit set, at most ``blocks``; null keys set none."""
    rows = keys.where(key.isNotNull()).select(_block(key, blocks).alias(BLOCK), *(m.alias(w) for m, w in zip(_masks(key), WORDS)))
    return rows.groupBy(BLOCK).agg(*(F.bit_or(w).alias(w) for w in WORDS))


def probe(df: DataFrame, key: Column, built: DataFrame, flag: str, blocks: int = BLOCKS) -> DataFrame:
    """``df`` with a boolean column ``flag``: false means the key is certainly not in the filter.

    A filter of at most ``SENT`` blocks of 40 bytes is broadcast, and ``df`` is not shuffled.
    A wider one is met partition by partition, in a join on the block's number; a key that
    fills many rows is split by the planner's skew handling, as a block has one row.
    """
    filters = F.broadcast(built) if blocks <= SENT else built.hint("shuffle_hash")
    marked = df.withColumn(BLOCK, _block(key, blocks)).join(filters, BLOCK, "left")
    hit = key.isNotNull()
    for mask, word in zip(_masks(key), WORDS):
        hit = hit & (F.col(word).bitwiseAND(mask) == mask)
    return marked.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(BLOCK, *WORDS)
