"""Keys seen so far, in bucketed parts with a digest each.

    <path>/keys/batch=N/bucket=B/    kind, key, at: what a batch added to a bucket, or a merge of that bucket's parts
    <path>/filters/batch=N/          bucket, word, bits: a Bloom filter of each of these parts, a row for each 64-bit word
    <path>/manifests/batch=N/        the parts alive after batch N: bucket, origin (their batch), size, newest time

A batch probes the digests with its own keys, in a join on (bucket, word), and opens only parts that may hold one of
them. So many keys that every part would be opened, if only by chance, are not probed. Where a bucket has more than
``merge_after`` parts, the batch's part takes them in, without expired keys. Everything a batch reads was written by
earlier batches and everything it writes lies under its own number, so a repeated batch gives the same result.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

KEYS = "kind string, key string, at timestamp"
DIGESTS = "bucket int, word long, bits long"
MANIFEST = "bucket int, origin long, size long, newest timestamp"
#: Bits that a key sets, all in one word, and filter bits a key at least.
PROBES, BITS = 4, 16
#: A filter lets one foreign key in 190 to 1,200 pass: beyond this many keys a bucket, probing them rules no part out.
PROBED = 4096
#: A bucket's part is written by up to so many tasks, each with words of its own of the filter.
TASKS = 16


class SeenStore:
    """``buckets`` fixes how keys are dealt and must stay the same."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, merge_after: int = 8):
        self.spark, self.path, self.buckets, self.merge_after = spark, path.rstrip("/"), buckets, merge_after

    def alive(self, batch_id: int) -> list[Row]:
        """The parts that batches before ``batch_id`` have left: at most ``merge_after`` a bucket."""
        if batch_id <= 0:
            return []
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/batch={batch_id - 1}").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def may_hold(self, keys: DataFrame, batch_id: int, after=None) -> list[Row]:
        """The parts that may hold one of ``keys`` (kind, key), of those with keys newer than ``after``."""
        parts = [r for r in self.alive(batch_id) if after is None or r.newest is None or r.newest > after]
        most = self.buckets * PROBED
        if not parts or keys.limit(most + 1).count() > most:
            return parts
        origins = sorted({r.origin for r in parts})
        digests = self.spark.read.schema(f"{DIGESTS}, batch long").option("basePath", f"{self.path}/filters").parquet(
            *[f"{self.path}/filters/batch={o}" for o in origins]
        )
        live = self.spark.createDataFrame([(r.bucket, r.origin, _words(r.size)) for r in parts], "bucket int, batch long, words long")
        filters = digests.join(F.broadcast(live), ["bucket", "batch"])  # a row for each part
        sizes = sorted({_words(r.size) for r in parts})  # powers of two: few
        probes = self._hashed(keys.distinct()).withColumn("words", F.explode(F.array(*[F.lit(s) for s in sizes])))
        probes = probes.select("bucket", "words", _word("words").alias("word"), _mask().alias("mask"))
        hits = probes.join(filters, ["bucket", "words", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        names = {(r.bucket, r.batch) for r in hits.select("bucket", "batch").distinct().collect()}  # parts again
        return [r for r in parts if (r.bucket, r.origin) in names]

    def known(self, keys: DataFrame, batch_id: int, after=None) -> DataFrame:
        """Those of ``keys`` that batches before ``batch_id`` have added, at times after ``after``."""
        rows = self._read(self.may_hold(keys, batch_id, after))
        if after is not None:
            rows = rows.where(F.col("at") > F.lit(after))
        on = ["hash", "kind", "key"]  # the hash comes first, as a number sorts faster
        return self._hashed(keys).select(*on).distinct().join(self._hashed(rows).select(*on), on, "left_semi").select("kind", "key")

    def add(self, keys: DataFrame, batch_id: int, after=None) -> None:
        """Record ``keys`` (kind, key, at) under ``batch_id``, each given once and not known; what is not newer than ``after`` is forgotten on the way."""
        alive = [r for r in self.alive(batch_id) if after is None or r.newest is None or r.newest > after]
        counts = Counter(r.bucket for r in alive)
        full = [r for r in alive if counts[r.bucket] >= self.merge_after]
        rows = keys.select("kind", "key", "at")
        if full:
            old = self._read(full)
            rows = rows.unionByName(old if after is None else old.where(F.col("at").isNull() | (F.col("at") > F.lit(after))))
        whole = self._hashed(rows).select("kind", "key", "at", "bucket", "task").repartition("bucket", "task").drop("task")
        whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/batch={batch_id}")
        rows = self.spark.read.schema(f"{KEYS}, bucket int").parquet(f"{self.path}/keys/batch={batch_id}")
        origin = F.lit(batch_id).cast("long").alias("origin")
        sizes = rows.groupBy("bucket").agg(origin, F.count("*").alias("size"), F.max("at").alias("newest")).collect()  # a row for each bucket
        words = self.spark.createDataFrame([(r.bucket, _words(r.size)) for r in sizes], "bucket int, words long")
        masks = self._hashed(rows).join(F.broadcast(words), "bucket").select("bucket", _word("words").alias("word"), _mask().alias("mask"))
        digest = masks.groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
        digest.write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch_id}")
        gone = {(r.bucket, r.origin) for r in full}
        kept = [r for r in alive if (r.bucket, r.origin) not in gone]
        self.spark.createDataFrame([*kept, *sizes], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/batch={batch_id}")

    def _hashed(self, keys: DataFrame) -> DataFrame:
        code = F.xxhash64("kind", "key")
        return keys.withColumns({
            "hash": code, "bucket": F.pmod(code, F.lit(self.buckets)).cast("int"), "task": F.pmod(F.xxhash64(code), F.lit(TASKS)),
        })

    def _read(self, parts: list[Row]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], KEYS)
        return self.spark.read.schema(KEYS).parquet(*[f"{self.path}/keys/batch={r.origin}/bucket={r.bucket}" for r in parts])


def _words(size: int) -> int:
    """64-bit words of a filter for ``size`` keys: a power of two with ``BITS`` bits a key or more."""
    return max(TASKS, 1 << (size * BITS // 64).bit_length())


def _word(words: str) -> Column:
    """The word of a key in a filter of ``words`` words. A task's words follow each other, so its keys meet before any shuffle."""
    each = F.expr(f"{words} div {TASKS}")
    return (F.col("task") * each + F.pmod(F.xxhash64("hash", F.lit(1)), each)).cast("long")


def _mask() -> Column:
    """The bits that a key sets in its word."""
    code = F.xxhash64("hash", F.lit(2))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(code, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    return reduce(Column.bitwiseOR, bits)
