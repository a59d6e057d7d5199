"""Readers, keyed appends and staged tables."""

from __future__ import annotations

import gzip
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tenfold.schemas import TABLES


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where it is unset a local session (tests) gets a temporary one; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tenfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of its own and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored table with its fixed schema; one that was never written is empty."""
    schema, path = schema or TABLES[name], f"{folder}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def first_of_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by ``order``, and by all other columns in ties."""
    rest = [c for c in batch.columns if c not in keys and c not in order]
    value = F.struct(*order, *rest)
    return batch.groupBy(*keys).agg(F.min(value).alias("x")).select(*[F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in batch.columns])


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of the batch whose key is new: the first of each key in the batch, less the keys that exist. Running it twice adds nothing."""
    return first_of_key(batch, keys, order or []).join(existing.select(*keys), keys, "left_anti").select(*batch.columns)


def insert_new(batch: DataFrame, folder: str, name: str, keys: list[str], order: list[str] | None = None) -> int:
    """Append the new rows of the batch to a stored table; returns how many."""
    fresh = staged(new_rows(batch, read_table(batch.sparkSession, folder, name, batch.schema), keys, order), f"insert-{name}")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(f"{folder}/{name}")
    return n


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last state of each key in an append-only log; ties go to the largest of the other columns."""
    return log.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in log.columns if c not in [*keys, order]])).alias("x")).select(*keys, "x.*")


def ordinal(df: DataFrame, order: list[str], name: str, one_task: int = 5_000_000) -> DataFrame:
    """Number the rows from 0 in that order. Up to ``one_task`` rows are numbered in one task; more are dealt by range and numbered from each range's offset."""
    if df.count() <= one_task:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    at = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each task at most
    return at.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def gzipped(df: DataFrame, column: str) -> DataFrame:
    """A text column as gzip blobs of level 6; null stays null."""

    @F.pandas_udf("binary")
    def blob(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else gzip.compress(x.encode(), 6, mtime=0))

    return df.withColumn(column, blob(column))


def gunzipped(df: DataFrame, column: str) -> DataFrame:
    """A gzip blob column as text; a corrupt blob becomes null."""

    @F.pandas_udf("string")
    def text(blobs: pd.Series) -> pd.Series:
        def one(blob):
            try:
                return gzip.decompress(blob).decode() if blob is not None else None
            except (OSError, EOFError, UnicodeDecodeError):
                return None

        return blobs.map(one)

    return df.withColumn(column, text(column))


class LandingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        return [InputPartition(x.path) for x in files.get_file_info(fs.FileSelector(root)) if x.path.endswith((".json", ".json.gz"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        with files.open_input_stream(partition.value) as f:
            data = f.read()
        if data[:2] == b"\x1f\x8b":
            try:
                data = gzip.decompress(data)
            except (OSError, EOFError):
                data = b""
        name = partition.value.rsplit("/", 1)[-1].split(".")[0]
        yield name, data.decode("utf-8", "replace") or None


class Landing(DataSource):
    """Source "landing": a folder of payload files, plain or gzip, one row (match_id, payload) each."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return "match_id string, payload string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LandingReader(self.options)


def payload_of(raw: DataFrame, match_id: str) -> DataFrame:
    """One stored payload; the id is pushed down to the statistics and bloom filters of the files."""
    return raw.where(F.col("match_id") == match_id).select("match_id", "payload")


def unread_payloads(raw: DataFrame, extras: DataFrame, only_missing: bool = True, most: int = 100_000) -> DataFrame:
    """Payloads whose extras are not stored yet.

    What is missing is found by the ids alone.  Up to ``most`` ids, some megabytes, go to the scan of the
    payloads, which are filtered where they are read; more of them are joined by a shuffle.
    """
    if not only_missing:
        return raw
    missing = staged(raw.select("match_id").distinct().join(extras.select("match_id").distinct(), "match_id", "left_anti"), "unread")
    return raw.join(F.broadcast(missing) if missing.count() <= most else missing.hint("merge"), "match_id", "left_semi")


def ladder(spark: SparkSession, tiers: list[str], divisions: list[str], pages: int, apex: list[str]) -> DataFrame:
    """(ord, tier, division, page): the pages of a ranked ladder to ask for, apex tiers first."""
    rows = [(t, "I", 1) for t in apex] + [(t, d, p) for t in tiers for d in divisions for p in range(1, pages + 1)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, tier string, division string, page int")
