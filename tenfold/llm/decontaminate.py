"""Benchmark decontamination with a positional inverted index.  DataFrame functions only.

The words of the documents are split once and written as a table.  The words of the test
items are counted in it, and each window of an item is known by its few rarest words.  The
index stores, for these words, the list of positions in each document that has them.  For a
phrase the lists are taken from the rarest word on, each position less the word's offset in
the window, and intersected; what is left is compared with the words that the index holds
around the rarest one.  For proximity, each position of any of these words is a place at which enough of the window's
words may stand around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, discard, fresh, lowered, row_key, staged

WINDOW = 13
#: Share of a window's different words that must stand around a posting for a near match.
NEAR = 0.8
#: Rows of test terms or windows up to which they are broadcast; beyond, a shuffle join takes over.
BROADCAST_ROWS = 200_000


def _lower(c: Column) -> Column:
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(lowered(c))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(_lower(F.coalesce(c, F.lit(""))), F.lit(ALNUM_WORDS), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a staged table if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(w, items): the different windows of the items' words, and the ids, as strings, of the items that have them."""
    each = F.expr(f"CASE WHEN size(i) >= {size} THEN transform(sequence(1, size(i) - {size - 1}), p -> slice(i, p, {size})) WHEN size(i) > 0 THEN array(i) ELSE array() END")
    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words(F.col("text")).alias("i")).select("item", F.explode(each).alias("w")).groupBy("w").agg(F.collect_set("item").alias("items"))


def split_words(docs: DataFrame) -> DataFrame:
    """(doc_id, key, words), written: the documents' words in order."""
    return staged(docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), _words(F.col("text")).alias("words")), "document-words")


def term_counts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(term, n): how often each word of the windows stands in texts. Summed by word in each task before anything is joined."""
    terms = found.select(F.explode("w").alias("term")).distinct()
    seen = texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def rarest(found: DataFrame, counts: DataFrame, near: float = NEAR) -> DataFrame:
    """(w, items, rare): each window with its rarest different words, rarest first, as (n, term, k), k being the word's first place in it.

    They are as many as leave one that each near match must have.
    """
    words = found.select("w", "items", F.posexplode("w").alias("k", "term")).groupBy("w", "term").agg(F.min("k").alias("k"), F.first("items").alias("items")).join(_small(counts), "term")
    each = words.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("n", "term", "k"))).alias("x"), F.first("items").alias("items"))
    return each.select("w", "items", F.expr(f"slice(x, 1, cast(size(x) - ceil({near} * size(x)) + 1 AS int)) AS rare"))


def postings(texts: DataFrame, terms: DataFrame, size: int = WINDOW) -> DataFrame:
    """The index: (term, key, positions, contexts) for the terms, one list for each document. Only terms that are the rarest of a window have contexts: (pos, around), the words up to ``size`` - 1 away."""
    places = texts.select("key", "words", F.posexplode("words").alias("pos", "term")).join(_small(terms), "term")
    low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    context = F.when(F.col("first"), F.struct("pos", F.slice("words", low + 1, F.col("pos") - low + size).alias("around")))
    return places.select("term", "key", "pos", context.alias("context")).groupBy("term", "key").agg(F.array_sort(F.collect_set("pos")).alias("positions"), F.collect_set("context").alias("contexts"))


def phrase_starts(index: DataFrame, windows_of: DataFrame) -> DataFrame:
    """(key, w, items, rare, start): places where a window's rarest words all stand at their offsets."""
    lists = index.join(_small(windows_of), index["term"] == windows_of["rare"][0]["term"])
    at = lists.select("key", "w", "items", "rare", F.expr("filter(transform(positions, p -> p - rare[0].k), s -> s >= 0) AS starts")).where("size(starts) > 0")
    for i in (1, 2):
        more = index.select(F.col("key").alias("other_key"), F.col("term").alias("other"), F.col("positions").alias("next"))
        one = F.get(F.col("rare"), F.lit(i))
        joined = at.join(more, (at["key"] == more["other_key"]) & (one["term"] == more["other"]), "left")
        at = joined.select("key", "w", "items", "rare", F.expr(f"CASE WHEN size(rare) <= {i} THEN starts ELSE array_intersect(starts, transform(next, p -> p - rare[{i}].k)) END AS starts")).where("size(starts) > 0")
    return at.select("key", "w", "items", "rare", F.explode("starts").alias("start"))


def _index(docs: DataFrame, items: DataFrame, size: int, near: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the documents' words, the windows with their rarest words, and the index of these."""
    texts, found = split_words(docs), staged(windows(items, size), "test-windows")
    rare = staged(rarest(found, staged(term_counts(texts, found), "test-term-counts"), near), "test-rarest")
    terms = rare.select(F.posexplode("rare").alias("i", "x")).groupBy("x.term").agg((F.min("i") == 0).alias("first"))
    return texts, rare, staged(postings(texts, staged(terms, "index-terms"), size), "postings")


def phrase_matches(index: DataFrame, starts: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, start, length, items): the starts at which the whole window stands, by the words around its rarest word."""
    left = starts.withColumns({"term": F.col("rare")[0]["term"], "pos": F.col("start") + F.col("rare")[0]["k"]}).drop("rare")
    both = left.join(index.select("term", "key", "contexts"), ["term", "key"]).withColumn("low", F.greatest(F.col("pos") - (size - 1), F.lit(0)))
    whole = F.expr("exists(contexts, c -> c.pos = pos AND slice(c.around, start - low + 1, size(w)) = w)")
    return both.where(whole).select("key", "start", F.size("w").alias("length"), "items").distinct()


def proximity_matches(texts: DataFrame, index: DataFrame, rare: DataFrame, size: int = WINDOW, near: float = NEAR) -> DataFrame:
    """(key, start, length, items): where that share of a window's different words stands among the words up to ``size`` - 1 away from one of its rarest ones."""
    places = index.join(_small(rare.select("w", "items", F.explode("rare").alias("x"))), F.col("term") == F.col("x.term")).select("key", "w", "items", F.explode("positions").alias("pos"), F.col("x.k").alias("k"))
    low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    around = F.slice("words", low + 1, F.col("pos") - low + size)
    enough = F.size(F.array_intersect(around, "w")) >= near * F.size(F.array_distinct("w"))
    return places.join(texts.select("key", "words"), "key").where(enough).select("key", (F.col("pos") - F.col("k")).alias("start"), F.size("w").alias("length"), "items")


def near_items(texts: DataFrame, index: DataFrame, rare: DataFrame, size: int = WINDOW, near: float = NEAR) -> DataFrame:
    """(key, near): the items, sorted, that a document has a near match of, phrases included.

    The windows of each term are one row; while these are few, they are held against the words around
    each place of a term where the words are read, and nothing but what is near is moved.
    """
    if rare.count() > BROADCAST_ROWS:
        found = proximity_matches(texts, index, rare, size, near).select("key", F.explode("items").alias("item"))
    else:
        of_term = rare.select("w", "items", F.explode("rare").alias("x")).groupBy("x.term").agg(F.collect_list(F.struct("w", "items", F.ceil(F.lit(near) * F.size(F.array_distinct("w"))).cast("int").alias("least"))).alias("windows"))
        low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        places = texts.select("key", "words", F.posexplode("words").alias("pos", "term")).join(F.broadcast(of_term), "term")
        around = places.select("key", "windows", F.array_distinct(F.slice("words", low + 1, F.col("pos") - low + size)).alias("around"))
        matched = F.expr("flatten(transform(filter(windows, x -> size(array_intersect(around, x.w)) >= x.least), x -> x.items))")
        found = around.select("key", F.explode(matched).alias("item"))
    return found.groupBy("key", "item").agg(F.lit(1)).groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("near"))


def near_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, near: float = NEAR) -> DataFrame:
    """(key, start, length, items, exact): phrases, and near matches that are none; key is that of ``common.row_key``."""
    texts, rare, index = _index(docs, items, size, near)
    exact = staged(phrase_matches(index, phrase_starts(index, rare), size), "phrases")
    other = proximity_matches(texts, index, rare, size, near).distinct().join(exact, ["key", "start", "length", "items"], "left_anti")
    return exact.withColumn("exact", F.lit(True)).unionByName(other.withColumn("exact", F.lit(False)))


def _hits(rare: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """(key, n_hit, found): documents with any phrase."""
    runs = phrase_matches(index, phrase_starts(index, rare), size).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("found"))
    covered = "aggregate(runs, struct(0L AS n, 0 AS upto), (a, r) -> struct(a.n + greatest(0, r.end - greatest(r.start, a.upto)) AS n, greatest(a.upto, r.end) AS upto), a -> a.n)"
    return runs.select("key", F.expr(covered).alias("n_hit"), "found")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, near: float | None = None) -> DataFrame:
    """Per row of docs: doc_id, key, n_words, n_hit, found (item ids as strings), contaminated (hit words are 5 % or more).

    With ``near`` also the column near: the items, as strings, of which that share of a window's
    different words stands around one of its rarest; it decides nothing.

    Null and empty texts have no words and are clean; a null item has no windows; a null
    doc_id is kept as it is; equal rows get equal results; an item shorter than the window
    is one window; equal items with other ids are all named; other columns are left out;
    empty tables give no rows, or rows without hits.
    """
    texts, rare, index = _index(docs, items, size, NEAR if near is None else near)
    hits = staged(_hits(rare, index, size), "hits")
    rows = texts.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    more = []
    if near is not None:
        hits = hits.join(staged(near_items(texts, index, rare, size, near), "near-items"), "key", "full_outer")
        more = [F.coalesce("near", F.array().cast("array<string>")).alias("near")]
    discard(index)
    return (
        rows.join(hits, "key", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .withColumn("found", F.coalesce(F.sort_array("found"), F.array().cast("array<string>")))
        .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
        .select("doc_id", "key", "n_words", "n_hit", "found", "contaminated", *more)
    )


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns as they are; nulls, equal rows and empty tables as in ``contamination``."""
    (key,) = fresh(docs, "row_key")
    bad = staged(contamination(docs, items, size).where("contaminated").select(F.col("key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
