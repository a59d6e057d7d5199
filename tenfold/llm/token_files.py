"""Token ids in Parquet list columns: chosen encoding, row groups and pages, with page indexes.

The files hold a document's row (doc_id, n_tokens, ids, its place in the partition), in
ascending doc_id order over the partitions.  Spark's writer makes them, so a lost task
leaves nothing behind; the column and offset indexes let a reader skip pages by doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .tokens import encoder

SCHEMA = "doc_id long, part long, local_start long, n_tokens long, token_ids array<int>"
IDS = "token_ids.list.element"


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = 2, encoding: str = "delta", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10) -> str:
    """Encode (doc_id, text), add the id ``end`` to each, and write them in ascending doc_id order; returns the path.

    encoding: "delta" (DELTA_BINARY_PACKED) or "dictionary" for the list column.  A null or
    empty text is the end id alone.  Null ids come first; rows with equal ids follow each
    other in an order made by their texts.  Other columns are left out; an empty table gives
    a table without rows.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"encoding: {encoding}")
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(tokenizer).batches, TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, ids, lengths in encode(batch.column(1), end):
                ends = np.cumsum(lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(lengths)), pa.array(np.full(len(lengths), part, np.int64)), pa.array(at + ends - lengths), pa.array(lengths), lists], ["doc_id", "part", "local_start", "n_tokens", "token_ids"])
                at += len(ids)

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    options = {"compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "v2", f"parquet.enable.dictionary#{IDS}": str(encoding == "dictionary").lower(), "parquet.enable.dictionary#doc_id": "false"}
    ordered.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)
    return path


def read(spark: SparkSession, path: str, columns: list[str] | None = None, ids: tuple[int, int] | None = None) -> DataFrame:
    """The rows of a written path: only the columns named, only doc_ids from the first to the second number.

    Rows with a null doc_id are in no range; equal rows come as often as they were written; a
    path of no documents gives no rows; the names of the documents' other columns cannot clash, as they are not written.
    """
    df = spark.read.schema(SCHEMA).parquet(path)
    if ids:
        df = df.where(F.col("doc_id").between(*ids))
    return df.select(*columns) if columns else df


def with_starts(df: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before. One row for each file's partition is summed up in one task and broadcast: as few as the tasks that wrote."""
    from pyspark.sql import Window

    parts = df.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return df.join(F.broadcast(offsets), "part").withColumn("start", F.col("local_start") + F.col("before")).drop("before")


def with_crc32(df: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with ``start`` and ``token_ids``, from the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
