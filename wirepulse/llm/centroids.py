"""Centroid clustering on integer vectors; Ptolemy's inequality spares exact distances.

For any four points ``d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|``. With fixed
pivots ``p, s``, distances of a vector to the pivots that are computed once and stored with it, and
distances of the few centroids to the pivots, this bounds ``d(x, c)`` from below without
looking at the components. Bounds are rounded down by more than floating-point errors
can amount to; a centroid is passed over only if its bound is above an exact distance already known, and
all others are measured exactly in integers, so the result is that of measuring everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse.llm.files import output_folder

#: Components of the given vectors stay below this, so that squared distances fit a BIGINT.
LARGEST = float(1 << 21)
#: More than the relative error of a bound's dozen roundings.
SLACK = 2.0**-44
#: Vectors measured at a time.
SLICE = 2048


@dataclass
class Clusters:
    """``assigned`` has ``(id, cluster, distance)`` of every kept vector; ``centroids`` their final integer components."""

    assigned: DataFrame
    centroids: list[list[int]]


def kept_points(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """``(id, point)``: vectors of ``size`` finite components, each as the integer ``floor(scale * x)``."""
    good = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    point = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return vectors.where((F.size(vector_col) == size) & good).select(F.col(id_col).cast("long").alias("id"), point.alias("point"))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, as integers."""
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def lower_bounds(near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of vectors to centroids; ``near`` holds the vectors' distances to the pivots."""
    far = np.sqrt(squares(centroids[:, None], pivots[None]).astype(np.float64))
    low = np.zeros((len(near), len(centroids)))
    for p, s in combinations(range(len(pivots)), 2):
        between = float(np.sqrt(float(squares(pivots[p], pivots[s]))))
        if between:
            one, two = near[:, p, None] * far[None, :, s], near[:, s, None] * far[None, :, p]
            np.maximum(low, (np.abs(one - two) - SLACK * (one + two)) / between, out=low)
    return low * (1 - SLACK)


def nearest(points: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of the nearest centroid (of equal ones the first), and how many were measured."""
    low = lower_bounds(near, centroids, pivots)
    guess = low.argmin(axis=1)
    known = squares(points, centroids[guess])
    rows, columns = np.nonzero(low * low * (1 - SLACK) <= known[:, None].astype(np.float64) * (1 + SLACK))
    exact = squares(points[rows], centroids[columns])
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else rows
    best = np.minimum.reduceat(exact, starts) if len(rows) else exact
    # Of a row's nearest ones the first: pairs are in order of row and number.
    hits = np.flatnonzero(exact == np.repeat(best, np.diff(np.append(starts, len(rows)))))
    first = hits[np.concatenate([[True], rows[hits][1:] != rows[hits][:-1]])] if len(hits) else hits
    return columns[first], best, len(rows) + len(points)


def _blocks(batches: Iterable[pa.RecordBatch], size: int, pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
            near = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, pivots)
            yield batch.column(0), points, np.sqrt(near)


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, pivots: int = 4,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> Clusters:
    """Assign every vector to its nearest centroid after ``rounds`` exact refinements.

    Centroids start as the ``k`` vectors with the smallest sha-256 of ``seed:id``; each round
    replaces those of non-empty clusters by the floor of their vectors' exact mean. The first
    ``pivots`` starting vectors are the pivots.

    Points and their pivot distances are written once to the shared folder; every pass is one
    narrow scan of that table, and a task's vectors are summed up before they leave it, so
    what is shuffled is ``k`` rows a task, however many vectors a cluster has. ``k`` centroids
    are all the driver sees. Vectors with a null or non-finite component or another length are left out, and so
    are those with a component of 2^21 or more, whose distances would not fit a BIGINT. Vectors
    without an id are assigned but start no centroid; of repeated ids the smaller
    vector comes first. Fewer than ``k`` vectors give as many centroids; an empty table
    gives no rows. Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    points = kept_points(vectors, id_col, vector_col, size, scale)
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = points.where(F.col("id").isNotNull()).orderBy(code, "id", "point").limit(k).collect()
    centroids = [list(r.point) for r in first]
    if not first:
        # No id at all: the smallest vectors start, so that the others still have a cluster.
        centroids = [list(r.point) for r in points.orderBy("point").limit(k).collect()]
    if not centroids:
        return Clusters(spark.createDataFrame([], "id long, cluster int, distance long"), [])
    fixed = np.array(centroids[:pivots], np.int64)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                block = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
                near = squares(block[:, None], fixed[None])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(near.ravel(), len(fixed)).cast(pa.list_(pa.int64()))],
                    names=["id", "point", "near"],
                )

    folder = output_folder(spark, "points")
    points.mapInArrow(measure, "id long, point array<int>, near array<long>").write.parquet(folder)
    table = spark.read.parquet(folder).select("id", "point", "near")

    for _ in range(rounds):
        sums = _cluster_sums(table, np.array(centroids, np.int64), fixed, size)
        for r in sums.collect():  # a row for each centroid at most
            centroids[r[0]] = [int(total) // int(r[1]) for total in r[2:]]
    last = np.array(centroids, np.int64)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, block, near in _blocks(batches, size, len(fixed)):
            numbers, distances, _ = nearest(block, near, last, fixed)
            yield pa.RecordBatch.from_arrays([names, pa.array(numbers.astype(np.int32)), pa.array(distances)], names=["id", "cluster", "distance"])

    return Clusters(table.mapInArrow(assign, "id long, cluster int, distance long"), centroids)


def _cluster_sums(table: DataFrame, centroids: np.ndarray, fixed: np.ndarray, size: int) -> DataFrame:
    """``(cluster, n, sum of each component)`` of the vectors nearest to each centroid."""

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64)
        for _, block, near in _blocks(batches, size, len(fixed)):
            numbers, _, _ = nearest(block, near, centroids, fixed)
            np.add.at(sums, numbers, block)
            counts += np.bincount(numbers, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = table.mapInArrow(total, "cluster int, n long, sums array<long>")
    whole = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole)


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """Every vector's cluster and distance, with its cluster's and the whole inertia and its centroid's digest.

    Inertias are exact sums; one that does not fit a BIGINT is given as the largest.
    """
    spark = vectors.sparkSession
    result = cluster(vectors, **options)
    folder = output_folder(spark, "assigned")
    result.assigned.write.parquet(folder)
    assigned = spark.read.schema("id long, cluster int, distance long").parquet(folder)
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    most = (1 << 63) - 1
    rows = [
        (c, min(s, most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, result.centroids[c])).encode()).hexdigest())
        for c, s in sums.items()
    ]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(  # a row for each centroid
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL for ``cluster_report`` over ``embeddings`` with unique ids."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id) - 1 AS INT) AS n, p FROM v QUALIFY n < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v.p AS p, c.n AS n, list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, n) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.n, COALESCE(m.p, c.p) AS p FROM c{r} c LEFT JOIN (
    SELECT n, list((s - ((s % t) + t) % t) // t ORDER BY i) AS p FROM (
      SELECT n, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS t FROM (SELECT n, unnest(p) AS x, unnest(range(len(p))) AS i FROM a{r}) GROUP BY n, i)
    GROUP BY n) m ON c.n = m.n)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.n AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.n = c.n"""
