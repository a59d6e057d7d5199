"""What the corpus operators share: staged tables, row keys, names, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of op2 and op9: runs without ASCII white space.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
#: Words of op3 and op5, after A-Z are lowered: runs of 0-9, a-z and all beyond ASCII.
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a local session (tests) gets a temporary one; a cluster must set it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tenfold-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df does not have (names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for (doc_id, text), nulls included: equal rows share it, and so share a result."""
    shown = F.concat_ws("\x01", F.coalesce(doc_id.cast("string"), F.lit("\x02")), F.coalesce(text, F.lit("\x02")))
    return F.unhex(F.md5(shown))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, which need not have it installed; once for each session's context."""
    import os
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_tenfold_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = tempfile.mkdtemp(prefix="tenfold-package-")
    context.addPyFile(shutil.make_archive(os.path.join(target, top.name), "zip", top.parent, top.name))
    context._tenfold_shipped = True
