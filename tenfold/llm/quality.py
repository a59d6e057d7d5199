"""Quality rules with thresholds that adapt to language and source.

Each measure is kept as a log-linear quantile sketch: counts by buckets that double in width
with every power of two, so that a quantile of values of any size is off by a 128th of itself
at most, and sketches of parts of the corpus merge by adding counts.  A group's limits are its
own median, and so many times its own spread on either side, in buckets, which is a ratio of
values; no measure has a cutoff or a tolerance of its own.  The spread is one that a third of
junk cannot move.  Small groups, and those whose sketch has no spread, take the merged sketch
of their language or of the corpus.  A small table of limits is then joined to the documents.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, staged

#: measure: (counted, of, has a lower limit too); its values are millionths. One more is counted of what many texts have none of, so that their lengths give a spread.
MEASURES = {"word_length": ("word_chars", "n_words", True), "marks": ("(n_marks + 1)", "word_chars", False), "capitals": ("(n_capitals + 1)", "word_chars", False)}
#: Spreads between a group's median and its limits, for all measures alike.
SPREAD = 12
#: ASCII punctuation.
MARKS = r"[!-/:-@\[-`{-~]"
#: Documents from which a group has thresholds of its own: with a third of junk, under one group of 100 in a thousand has a majority of it.
LEAST_GROUP = 100
#: Groups of language and source up to which the thresholds are broadcast; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 20_000


def _words(df: DataFrame) -> DataFrame:
    """Adds the counts that need no windows of words. The frame has a column t of texts."""
    return (
        df.withColumn("words", F.expr(f"regexp_extract_all(t, r'{SPACE_WORDS}', 0)"))
        .withColumn("joined", F.array_join("words", ""))
        .withColumn("lines", F.expr(r"filter(split(t, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"))
        .withColumns(
            {
                "n_words": F.size("words").cast("long"),
                "word_chars": F.length("joined").cast("long"),
                "n_symbols": F.expr("cast(regexp_count(joined, '[#*$%&|<>]') as long)"),
                "n_capitals": F.expr("cast(regexp_count(joined, '[A-Z]') as long)"),
                "n_marks": F.expr(f"cast(regexp_count(joined, r'{MARKS}') as long)"),
                "n_dup_lines": F.expr("cast(size(lines) - size(array_distinct(lines)) as long)"),
            }
        )
        .drop("joined", "lines")
    )


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of five that are found twice or more. Texts without such windows are not sorted."""
    return (
        df.withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("g", F.expr("CASE WHEN size(h) > 5 THEN transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i+1], h[i+2], h[i+3], h[i+4])) END"))
        .withColumn("s", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> struct(x AS h, i AS p))) END"))
        .withColumn("starts", F.expr("sort_array(array_compact(transform(s, (x, i) -> CASE WHEN get(s, i - 1).h = x.h OR get(s, i + 1).h = x.h THEN x.p END)))"))
        .withColumn("n_repeat_words", F.expr("coalesce(aggregate(starts, struct(0L AS n, -5 AS last), (a, p) -> struct(a.n + least(5, p - a.last) AS n, p AS last), a -> a.n), 0L)"))
        .drop("words", "h", "g", "s", "starts")
    )


def bucket(measure: str) -> Column:
    """The bucket of millionths of a measure: 128 in each power of two, from 256 on; below, each its own. Null if there is nothing to count in."""
    counted, of, _ = MEASURES[measure]
    v = f"((1000000L * {counted}) div {of})"
    shift = f"(length(bin({v})) - 8)"
    return F.expr(f"CASE WHEN {of} > 0 THEN CASE WHEN {v} < 256 THEN {v} ELSE {shift} * 128L + shiftright({v}, {shift}) END END")


def least_value(b: str) -> str:
    """The least millionths in a bucket."""
    shift = f"cast({b} div 128 - 1 as int)"
    return f"CASE WHEN {b} < 256 THEN {b} ELSE shiftleft({b} - {shift} * 128L, {shift}) END"


def _buckets() -> dict[str, Column]:
    return {m: bucket(m) for m in MEASURES}


def _texts(docs: DataFrame) -> DataFrame:
    """Private names: row (all given columns), t, lang and source with a stand-in for null."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("t"), part("lang").alias("lang"), part("source").alias("source"))


def sketches(docs: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the histogram sketches; those of several tables merge by summing n."""
    measured = _words(_texts(docs).drop("row")).withColumns(_buckets())
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bucket")) for m in MEASURES])).alias("x")
    return measured.select("lang", "source", each).select("lang", "source", "x.*").where("bucket IS NOT NULL").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, *group: str) -> DataFrame:
    """(group, measure, n, q1, q2, q3) in buckets. A sketch has some thousand buckets at most."""
    quantile = lambda q: f"filter(c, x -> 100 * x.n >= {q} * n)[0].bucket"
    upto = F.sum("n").over(Window.partitionBy(*group, "measure").orderBy("bucket"))
    return (
        sketch.withColumn("upto", upto)
        .groupBy(*group, "measure")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", F.col("upto").alias("n")))).alias("c"), F.sum("n").alias("n"))
        .selectExpr(*group, "measure", "n", f"{quantile(25)} AS q1", f"{quantile(50)} AS q2", f"{quantile(75)} AS q3")
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high, <measure>_from) in buckets, with the sketch that they come from: group, language or corpus.

    The spread is the lesser distance of a quartile from the median: junk of up to half a
    group reaches one quartile only.  A group of under LEAST_GROUP documents, or one whose
    sketch has no spread or begins at 0, takes the merged sketch of its language, and a
    language that of the corpus; a measure without a spread there has no limits.
    """
    merged = lambda *by: _quartiles(sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n")), *by)
    own = lambda df, name: df.select(*[c for c in ("lang", "source", "measure") if c in df.columns], F.struct("n", "q1", "q2", "q3").alias(name))
    per = own(_quartiles(sketch, "lang", "source"), "a").join(own(merged("lang"), "b"), ["lang", "measure"]).join(F.broadcast(own(merged(), "c")), "measure")
    fit = lambda x: f"{x}.n >= {LEAST_GROUP} AND {x}.q1 > 0 AND {x}.q1 < {x}.q2 AND {x}.q2 < {x}.q3"
    shown = lambda x, name: f"named_struct('q2', {x}.q2, 'reach', {SPREAD} * least({x}.q3 - {x}.q2, {x}.q2 - {x}.q1), 'of', '{name}')"
    corpus = "c.q1 > 0 AND c.q1 < c.q2 AND c.q2 < c.q3"
    per = per.select("lang", "source", "measure", F.expr(f"CASE WHEN {fit('a')} THEN {shown('a', 'group')} WHEN {fit('b')} THEN {shown('b', 'language')} WHEN {corpus} THEN {shown('c', 'corpus')} END").alias("x"))
    out = []
    for m, (*_, lower) in MEASURES.items():
        out += [F.expr(f"max(CASE WHEN measure = '{m}' THEN x.q2 + x.reach END) AS {m}_high"), F.expr(f"max(CASE WHEN measure = '{m}' THEN x.of END) AS {m}_from")]
        if lower:
            out.append(F.expr(f"max(CASE WHEN measure = '{m}' THEN x.q2 - x.reach END) AS {m}_low"))
    return per.groupBy("lang", "source").agg(*out)


def score(docs: DataFrame) -> DataFrame:
    """Columns: row (a struct of the given columns), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Thresholds come from sketches of all of docs.  Null and empty texts have no words and
    fail the base rules.  A null lang or source is a group of its own.  Equal rows count
    each by itself and get equal verdicts.  Extra columns of any name stay in ``row``.  An
    empty table gives no rows.
    """
    limits = staged(thresholds(staged(sketches(docs), "quality-sketches")), "quality-thresholds")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    measured = _repeats(_words(_texts(docs))).withColumns(_buckets())
    inside = " AND ".join(f"coalesce({m} <= {m}_high, true)" + (f" AND coalesce({m} >= {m}_low, true)" if lower else "") for m, (*_, lower) in MEASURES.items())
    return (
        measured.join(limits, ["lang", "source"], "left")
        .withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
        .withColumn("kept", F.expr(f"NOT base_failed AND {inside}"))
        .select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept by ``score``, with their columns as they are; nulls, ties and empty tables as there.

    The verdict goes through a generator: a filter on it would else be pushed below the
    measures, and the optimizer would put their expressions into each other over and over.
    """
    return score(docs).select("row", F.explode(F.array("kept")).alias("kept")).where("kept").select("row.*")
