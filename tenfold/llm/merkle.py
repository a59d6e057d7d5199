"""Merkle manifest of a corpus: one leaf for each document, one tree for each language, one root over all.

Rows of a group are numbered by range: each range of the sort order numbers its own rows and
adds the rows of the group in the ranges before it, so that a language of any size is never in
one task.  A level groups the numbers, divided by the fanout, into sorted arrays of children
and hashes each array into its parent; the levels are written tables.  Paths go back down: a
join of each level's parents with their own paths appends the siblings of their children, so
that a sibling's digest is joined once for each run of children and not once for each document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, staged

FANOUT = 8
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Stands for a null group: it sorts before all others, which begin with a 1.
NULL_GROUP = "0"
PATH = "array<struct<before: string, after: string>>"


def digest(x: Column) -> Column:
    """Lowercase hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(x.cast("binary"), 256)


def field(x: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows give the same input; ``-`` if null."""
    shown = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(text: Column | str = "text") -> Column:
    """The digest of a document's row, with ``text`` as its text."""
    text = F.col(text) if isinstance(text, str) else text
    return digest(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]))


def tampered(text: Column | str = "text") -> Column:
    """The text with A-Z in lower case; null stays null."""
    return F.translate(text, UPPER, LOWER)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds i, the number of a row in its group g from 0 by ``order``, and n, the group's rows. Rows that tie in all of ``order`` are alike."""
    ranged = staged(rows.repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    inside = ranged.withColumn("at", F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)))
    sizes = ranged.groupBy("g", "part").agg(F.count("*").alias("size"))  # a row for each group and each range that it reaches into
    of = Window.partitionBy("g")
    sizes = sizes.select("g", "part", (F.sum("size").over(of.orderBy("part")) - F.col("size")).alias("ahead"), F.sum("size").over(of).alias("n"))
    out = staged(inside.join(sizes, ["g", "part"]).withColumn("i", F.col("ahead") + F.col("at") - 1).drop("part", "at", "ahead"), "merkle-numbered")
    discard(ranged)
    return out


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Tables (g, i, h, n, kids) of the parents, level by level, until each group has one node. ``nodes`` has g, i, h and n."""
    widest, out = nodes.agg(F.max("n")).first()[0] or 0, []
    while widest > 1:
        run = nodes.where("n > 1").groupBy("g", F.floor(F.col("i") / fanout).alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("kids"), F.first("n").alias("n"))
        run = run.select("g", "i", F.ceil(F.col("n") / fanout).alias("n"), F.expr("kids.h").alias("kids"))
        nodes = staged(run.withColumn("h", digest(F.array_join("kids", ""))), "merkle-level")
        out.append(nodes)
        widest = -(-widest // fanout)
    return out


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(g, h): the one node that is left of each group."""
    return reduce(DataFrame.unionByName, [x.where("n = 1").select("g", "h") for x in [nodes, *levels]])


SIBLINGS = "concat(array(struct(array_join(slice(kids, 1, at), '') AS before, array_join(slice(kids, at + 2, size(kids)), '') AS after)), path)"


def _below(parents: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """(g, i, path, top) of the children of parents (g, i, kids), which have the paths ``above`` (g, i, path, top): their own siblings first, then what is above."""
    each = parents.select("g", "i", "kids").join(above, ["g", "i"]).select("g", "i", "kids", "path", "top", F.expr("explode(sequence(0, size(kids) - 1))").alias("at"))
    return each.select("g", (F.col("i") * fanout + F.col("at")).alias("i"), F.expr(SIBLINGS).alias("path"), "top")


def _paths_down(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Paths (g, i, path, top) of the lowest parents; tops (g, path, top) has those of each group's last node. A written table."""
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].where("n = 1").join(tops, "g").select("g", "i", "path", "top")
        above, paths = paths, staged(here if paths is None else here.unionByName(_below(levels[k + 1], paths, fanout)), "merkle-paths")
        if above is not None:
            discard(above)
    return paths


def folded(start: Column | str, path: Column | str = "path") -> Column:
    """The root that a leaf gives with the siblings of its path."""
    name = path if isinstance(path, str) else "path"
    return F.aggregate(F.col(name), F.col(start) if isinstance(start, str) else start, lambda h, p: digest(F.concat(p["before"], h, p["after"])))


def proof(path: str = "path") -> Column:
    """The digest of all siblings of a path, level by level, from left to right; that of the empty string if there are none."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))


def manifest(docs: DataFrame, fanout: int = FANOUT, **more: Column) -> DataFrame:
    """One row for each document: doc_id, lang, leaf, subroot, root, path (siblings before and after, a level each) and the columns ``more``.

    docs must have doc_id, source, lang, n_chars and text; other columns may have any name and
    are not part of a leaf.  ``more`` are expressions over docs.  A null in a leaf is ``-``; null
    doc_ids come first, a null lang is a group of its own and the first.  Rows with equal doc_ids
    are ordered by their leaves; equal rows are leaves of their own.  A group of one row has its
    leaf as subroot; of one group the subroot is the root.  An empty table gives no rows.
    """
    extra = {f"more_{k}": x for k, x in enumerate(more.values())}
    group = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit(NULL_GROUP))
    rows = staged(docs.select("doc_id", group.alias("g"), leaf().alias("h"), *[x.alias(k) for k, x in extra.items()], F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    leaves = _numbered(rows, "doc_id", "h", "tie")
    levels = _levels(leaves, fanout)
    subroots = _numbered(_tops(leaves, levels).select(F.lit("").alias("g"), F.col("g").alias("lang"), "h"), "lang")
    crown = _levels(subroots, fanout)
    root = _tops(subroots, crown).select("g", F.expr(f"cast(array() AS {PATH})").alias("path"), F.struct(F.col("h").alias("root")).alias("top"))
    if crown:
        lowest = _paths_down(crown, root, fanout)
        paths = subroots.join(_below(crown[0], lowest, fanout), ["g", "i"])
    else:
        paths = subroots.join(root, "g")
    tops = staged(paths.select(F.col("lang").alias("g"), "path", F.struct(F.col("h").alias("subroot"), "top.root").alias("top")), "merkle-subroots")
    discard(rows, subroots, *crown, *([lowest] if crown else []))
    wanted = ["doc_id", "g", "h", "path", "top", *extra]
    out = leaves.where("n = 1").join(tops, "g").select(*wanted)
    if levels:
        runs = levels[0].select("g", "i", "kids").join(_paths_down(levels, tops, fanout), ["g", "i"]).withColumnRenamed("i", "up")
        inner = leaves.where("n > 1").withColumn("up", F.floor(F.col("i") / fanout)).withColumn("at", (F.col("i") % fanout).cast("int")).join(runs, ["g", "up"])
        out = inner.withColumn("path", F.expr(SIBLINGS)).select(*wanted).unionByName(out)
        discard(*levels[1:])
    lang = F.when(F.col("g") != NULL_GROUP, F.expr("substr(g, 2)"))
    return out.select("doc_id", lang.alias("lang"), F.col("h").alias("leaf"), "top.subroot", "top.root", "path", *[F.col(k).alias(name) for k, name in zip(extra, more, strict=True)])
