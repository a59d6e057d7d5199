"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  docs must have doc_id, text, lang and source; any may be null,
other columns may have any name and are passed on, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.llm import decontaminate, line_dedup, minhash, packing, quality
from tenfold.llm.common import ship, staged
from tenfold.llm.queries import table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond the thresholds of their language and source go.

    Null, empty and very short texts fail the base rules; a null language or source is a group
    of its own; equal rows get one verdict and all stay or go.
    """
    ship(spark)
    return quality.filtered(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its texts; n_chars follows. No row goes.

    Copies stay whole for the next stage to decide on, and a line must stand on five documents,
    as a pair of copies in a small source is no boilerplate.  Null texts stay null; a null source
    is a source of its own; equal rows count each.
    """
    ship(spark)
    cleaned = line_dedup.cleaned(docs, least_pages=5, keep_copies=True)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id: five words, similarity 0.8.

    Texts without words are in no group and stay; of equal rows one stays; a row with a null
    doc_id stays only where its group has no other.
    """
    ship(spark)
    return minhash.deduplicated(docs, k=5, share=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go: 5 % or more of their words lie in its windows of 13 words.

    Null and empty texts have no words and stay; equal rows get one verdict; null or empty items match nothing.
    """
    ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids, with the ids, sequences and offsets, instead of the columns of documents.

    A null or empty text is its end id alone; equal rows are packed each; a null doc_id stays null.
    """
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

#: Near-dedup and tokenizing cannot be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as a table before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
