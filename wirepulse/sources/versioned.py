"""Tables one can upsert into and expire from: Parquet parts and a small manifest a version.

    <path>/parts/<commit>/_part=<name>/   rows; written once, never changed
    <path>/versions/v=<n>/                the parts that make up version n, and how far each writer has come

A commit writes the parts it changes and then one manifest file, which makes
them visible; parts of a commit that did not get that far belong to no version. A reader
is pinned to the version it opened. The manifest has a row for each part: as many as there are buckets
or days, so the driver may hold it. A table takes one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wirepulse.functions import times as tm
from wirepulse.session import checkpointed

MANIFEST = "part string, folder string, buckets int, writer string, batch long"
#: The part of rows without a time, which never expire.
UNDATED = "undated"


@dataclass(frozen=True)
class Version:
    """Number, folder of each part, number of buckets (0: parts are days) and last batch of each writer."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    buckets: int = 0
    done: dict[str, int] = field(default_factory=dict)


def version_at(spark: SparkSession, path: str, version: int | None = None) -> Version:
    """The newest version, or the newest up to ``version``; an empty one where there is none."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, v long").parquet(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return Version()
    if version is not None:
        rows = rows.where(F.col("v") <= version)
    newest = rows.agg(F.max("v")).first()[0]
    if newest is None:
        return Version()
    found = rows.where(F.col("v") == newest).collect()
    parts = {r.part: r.folder for r in found if r.part is not None}
    return Version(newest, parts, max(r.buckets for r in found), {r.writer: r.batch for r in found if r.writer is not None})


def _publish(spark: SparkSession, path: str, base: Version, parts: dict[str, str], buckets: int, writer: str, batch: int | None) -> int:
    done = dict(base.done)
    if batch is not None:
        done[writer] = batch
    rows = [(p, f, buckets, None, None) for p, f in sorted(parts.items())] + [(None, None, buckets, w, b) for w, b in sorted(done.items())]
    rows = rows or [(None, None, buckets, None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/versions/v={base.number + 1}")
    return base.number + 1


def write_parts(rows: DataFrame, path: str, names: Sequence[str]) -> dict[str, str]:
    """Write rows under their value of column ``_part``; ``names`` are all its values. Returns the folders."""
    commit = uuid.uuid4().hex
    rows.write.partitionBy("_part").parquet(f"{path}/parts/{commit}")
    return {n: f"parts/{commit}/_part={n}" for n in names}


def _read_parts(spark: SparkSession, path: str, schema: str, folders: Sequence[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders))


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the newest. Later commits do not change what it reads."""
    return _read_parts(spark, path, schema, sorted(version_at(spark, path, version).parts.values()))


# ---------------------------------------------------------------- upserts


def _first(rest: list[str], order: list) -> list:
    return [F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")]


def _last(rest: list[str], order: list) -> list:
    return [F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")]


def _filled(rest: list[str], order: list) -> list:
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in rest]
    return [*newest]


FOLDS = {"insert": _first, "replace": _last, "fill": _filled}


def upsert_table(
    updates: DataFrame, path: str, schema: str, keys: Sequence[str], order: Sequence[str], *, how: str = "replace",
    buckets: int = 64, writer: str = "", batch: int | None = None,
) -> int:
    """Bring ``updates`` into the table at ``path``; returns the version that has them.

    A table holds one row per key. ``how`` says what becomes of a key's stored row and its
    updates in the sequence of ``order``: "insert" keeps the stored row, else the first
    update; "replace" keeps the last update; "fill" keeps the last value of each column that
    is not null. Null keys are a key like any other.

    Keys are dealt to ``buckets`` by their hash (fixed by the first commit). Updates are
    first reduced to one row per key, on the map side; then only the buckets that
    hold one of them are read, merged and written, with one shuffle by bucket, and all other parts go
    over into the new version as they are. A bucket is written by one task, so choose their
    number for parts of some hundred MB. A ``batch`` of a ``writer`` that is already in the
    table is not applied again, and no updates make no version.
    """
    spark = updates.sparkSession
    base = version_at(spark, path)
    if batch is not None and base.done.get(writer, -1) >= batch:
        return base.number
    buckets, fold = base.buckets or buckets, FOLDS[how]
    layout = T.StructType.fromDDL(schema)
    rest = [f.name for f in layout if f.name not in keys]
    typed = updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in layout], *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)])
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")

    def folded(rows: DataFrame, by: list, *group: str) -> DataFrame:
        out = rows.groupBy(*group, *keys).agg(*fold(rest, by))
        return out if how == "fill" else out.select(*group, *keys, "_row.*")

    latest = checkpointed(folded(typed, [F.col(f"_by{i}") for i in range(len(order))]).withColumn("_part", place))
    touched = [r[0] for r in latest.select("_part").distinct().collect()]  # as many as there are buckets, at most
    if not touched:
        return base.number
    stored = _read_parts(spark, path, schema, [base.parts[p] for p in touched if p in base.parts])
    both = stored.withColumn("_part", place).withColumn("_rank", F.lit(0)).unionByName(latest.withColumn("_rank", F.lit(1)))
    merged = folded(both.repartition("_part"), [F.col("_rank")], "_part")
    written = write_parts(merged.select("_part", *layout.names), path, touched)
    return _publish(spark, path, base, {**base.parts, **written}, buckets, writer, batch)


# ---------------------------------------------------------------- days


def append_days(rows: DataFrame, path: str, schema: str, ts: str, *, writer: str = "", batch: int | None = None) -> int:
    """Add rows to a table kept by day of ``ts``; returns the version that has them.

    Every commit adds parts of its own, named by day and commit. A ``batch`` of a ``writer`` that is already there is not added again.
    """
    spark = rows.sparkSession
    base = version_at(spark, path)
    if batch is not None and base.done.get(writer, -1) >= batch:
        return base.number
    day = F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(UNDATED))
    fresh = checkpointed(rows.select(*T.StructType.fromDDL(schema).names).withColumn("_part", day))
    days = [r[0] for r in fresh.select("_part").distinct().collect()]  # a row for each day
    if not days:
        return base.number
    # Even parts whatever the days' sizes: a large day is dealt to several tasks.
    written = write_parts(fresh.hint("rebalance", "_part"), path, days)
    named = {f"{d} {base.number + 1:06d}": f for d, f in written.items()}
    return _publish(spark, path, base, {**base.parts, **named}, 0, writer, batch)


def retain(spark: SparkSession, path: str, schema: str, ts: str, days: int, now) -> int:
    """Expire rows ``days`` old or older; returns the version without them.

    Parts of days before the cutoff's are left out without being opened, only those of the cutoff's own day are
    rewritten, and all later parts stay the files they are. Rows without a time never expire.
    """
    base = version_at(spark, path)
    cutoff = tm.shift(tm.instant(now), -days * 86_400)
    edge = spark.range(1).select(F.date_format(cutoff, "yyyy-MM-dd")).first()[0]
    kept = {p: f for p, f in base.parts.items() if p.startswith(UNDATED) or p[:10] > edge}
    border = {p: f for p, f in base.parts.items() if p[:10] == edge}
    if len(kept) + len(border) == len(base.parts) and not border:
        return base.number
    if border:
        inside = _read_parts(spark, path, schema, sorted(border.values())).where(F.col(ts) > cutoff).withColumn("_part", F.lit(edge))
        inside = checkpointed(inside)
        if not inside.isEmpty():
            written = write_parts(inside, path, [edge])
            kept[f"{edge} {base.number + 1:06d}"] = written[edge]
    return _publish(spark, path, base, kept, 0, "", None)


# ---------------------------------------------------------------- upkeep


def forget_versions(spark: SparkSession, path: str, keep: int = 8) -> int:
    """Delete all but the newest ``keep`` versions and the parts that only they have; returns the number of commits deleted.

    For times without a writer, since parts of a commit under way belong to no version yet.
    Readers pinned to a deleted version fail.
    """
    newest = version_at(spark, path).number
    rows = spark.read.schema(f"{MANIFEST}, v long").parquet(f"{path}/versions")
    live = {r[0].split("/")[1] for r in rows.where((F.col("v") > newest - keep) & F.col("folder").isNotNull()).select("folder").distinct().collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for number in range(1, newest - keep + 1):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/v={number}"), True)
    for entry in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parts")):
        if entry.getPath().getName() not in live:
            files.delete(entry.getPath(), True)
            gone += 1
    return gone
