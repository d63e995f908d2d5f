"""One Python function over whole texts, batch by batch, with an id carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wirepulse.llm import bloom


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_map(
    df: DataFrame, id_col: str, text_col: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[str], tuple]],
) -> DataFrame:
    """``(id, *fields)`` for every row of ``df``; a null text counts as empty.

    ``make()`` runs once per task and returns the function applied to each text.
    Only the two named columns leave the scan, under names of their own, so other
    columns of the input cannot clash. Batches are taken in slices of 256 texts,
    which bounds what one task holds in Python objects.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, t) for n, t in fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = [function(text or "") for text in batch.column(1).to_pylist()]
                columns = [batch.column(0).cast(arrow.field(0).type)]
                columns += [pa.array([r[k] for r in rows], arrow.field(k + 1).type) for k in range(len(fields))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    narrow = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("row_text"))
    return narrow.mapInArrow(run, schema)


def without(df: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows in ``bad (id, key)``, ``key`` being the hash of text and id.

    A Bloom filter of fixed size lets rows that are certainly not listed pass without
    a shuffle; the others meet the list in an exact anti-join. All columns stay.
    """
    packed = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string"), F.col(id_col)).alias("key"))
    gone = bad.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    probed = bloom.probe(packed, F.col("key"), bloom.build(gone, F.col("gone_key")), "possible")
    same = (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id"))
    checked = probed.where("possible").join(gone, same, "left_anti")
    return probed.where(~F.col("possible")).select("row.*").unionAll(checked.select("row.*"))
