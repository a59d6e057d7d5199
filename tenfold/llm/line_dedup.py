"""Boilerplate lines by site-relative frequency.

A line's pages on a host are divided by the host's pages; lines above the ratio go.  Lines
are counted by hash with a partial sum before the shuffle.  A host has at most (mean lines
of a page / ratio) such lines, so the list joined to each of its pages is bounded whatever
the host's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A section of a host has a template of its own.  A line of a section that makes up more than
#: a twentieth of its host is boilerplate; text of a page's own stands on a few pages of a host at most.
RATIO = 0.05
#: Pages that a line must stand on: on one page it is no boilerplate, however small the host.
LEAST_PAGES = 2
HASH = "struct(xxhash64(l) AS a, hash(l) AS b)"
BLANK = r"NOT l rlike r'[^\x20\x09-\x0D]'"


def host_of(url: Column) -> Column:
    """The host in a URL, without user and port, in lower case; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit("")))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): for each host that has any, the hashes of its boilerplate lines."""
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    lines = pages.selectExpr("host", rf"explode(array_distinct(transform(filter(split(t, '\n'), l -> NOT ({BLANK})), l -> {HASH}))) AS line")
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return counts.join(totals, "host").where(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.collect_set("line").alias("lines"))


def clean(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, keep_copies: bool = False) -> DataFrame:
    """Columns: row (a struct of the given columns), text (what is left), n_lines, n_removed.

    Lines are what stands between newlines; lines without a word are never removed.  With
    ``keep_copies`` a page whose every line with a word is boilerplate is taken as one of many
    copies rather than as a page with boilerplate, and stays whole: other operators decide on
    copies.  Null text stays null with no lines; a null host is a host of its own; equal rows
    count each as a page; extra columns of any name stay in ``row``; an empty table gives no rows.
    """
    found = staged(boilerplate(docs, host, text, ratio, least_pages), "boilerplate-lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"), F.col(text).alias("t"))
    return (
        rows.join(found.withColumnRenamed("lines", "bad"), "host", "left")
        .withColumn("l", F.expr(r"split(t, '\n')"))
        .withColumn("good", F.expr(f"CASE WHEN bad IS NULL THEN l ELSE filter(l, l -> {BLANK} OR NOT array_contains(bad, {HASH})) END"))
        .withColumn("left", F.expr(f"CASE WHEN size(good) < size(l) AND NOT exists(good, l -> NOT ({BLANK})) THEN l ELSE good END") if keep_copies else F.col("good"))
        .select("row", F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).alias("text"), F.expr("cast(coalesce(size(l), 0) as long) AS n_lines"), F.expr("cast(coalesce(size(l) - size(left), 0) as long) AS n_removed"))
    )


def cleaned(docs: DataFrame, host: str = "source", text: str = "text", **options) -> DataFrame:
    """docs with boilerplate lines taken out of their texts; all rows and columns stay; options, nulls, ties and empty tables as in ``clean``."""
    return clean(docs, host, text, **options).select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
