"""Scan for secrets with an incremental ledger of blobs.

Every version of a text is addressed by its content: equal texts, of any path and any time,
are one blob.  The ledger, a table that only grows, says for each blob which rules in which
version have been tried on it and what they found.  A scan takes the pairs of blob and rule
version that the ledger does not have, runs the rules' patterns over one copy of each such
blob, appends pairs and findings in one row for each blob, and joins the findings back to all
paths.  A cut-off append leaves whole rows or none; what is missing is scanned the next time.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, new_path, staged


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, the leftmost and not overlapping, whose ``group`` has ``least`` characters. A changed rule gets a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Base rules (fixed values). A shorter run of hex or access characters cannot begin a longer one, so their least length is in the pattern.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Rules of the method: forms that are secrets by their own marks.
MORE = (
    Rule("private", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,1000}\.eyJ[A-Za-z0-9_-]{10,1000}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE + MORE
LEDGER = "blob binary, scanned array<string>, spans array<struct<rule: string, start: long, end: long>>"
#: Blobs to scan up to which their ids are broadcast (some 10 MB), so that texts that were seen are not shuffled; beyond, texts and ids are joined by a shuffle.
BROADCAST_BLOBS = 100_000
#: A blob of more than one row in this many is hot, so there are fewer than this many; and the parts that its rows are dealt into.
HOT, SALTS = 1000, 64


def blob_of(text: str = "text"):
    """32 bytes that stand for a text; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def ledger_at(spark, path: str) -> DataFrame:
    """The ledger's rows; one that was never written is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def unseen(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): the rules' names that the ledger does not have for a blob; none, no row."""
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
    names = F.array(*[F.lit(r.name) for r in rules])
    return blobs.select("blob").join(seen, "blob", "left").select("blob", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where("size(todo) > 0")


def _lengths(rule: Rule):
    """Lengths in characters of what lies before each match, of the match and of the group that is tested; null where the rule is not to be tried or finds nothing."""
    of = lambda g: F.transform(F.regexp_extract_all("t", F.lit(rule.pattern), F.lit(g)), F.length)
    found = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.least).alias("least"), F.arrays_zip(F.transform(F.slice(F.split("t", rule.pattern, -1), 1, F.size(of(0))), F.length).alias("gap"), of(0).alias("size"), of(rule.group).alias("tested")).alias("matches"))
    return F.when(F.array_contains("todo", rule.name) & F.col("t").rlike(rule.pattern), found)


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of (blob, t, todo). A match starts after all gaps up to it and all matches before it; summed as rows, since a long text may have very many."""
    found = staged(texts.select("blob", "todo", F.array_compact(F.array(*[_lengths(r) for r in rules])).alias("found")), "secret-matches")
    each = found.select("blob", F.explode("found").alias("f")).select("blob", "f.rule", "f.least", F.posexplode("f.matches").alias("k", "m"))
    upto = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = each.withColumn("end", upto).where("m.tested >= least").groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("rule", (F.col("end") - F.col("m.size")).alias("start"), "end"))).alias("spans"))
    return found.select("blob", F.col("todo").alias("scanned")).join(spans, "blob", "left").select("blob", "scanned", F.coalesce("spans", F.array().cast("array<struct<rule: string, start: bigint, end: bigint>>")).alias("spans"))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: the columns ``keep``, blob, and findings, an array of (kind, start, end) by start and then by the rules' order.

    ``ledger`` is a path in a folder that all executors share; it is made where it is missing.
    Only unseen pairs of blob and rule version are scanned, each on one copy of its text, and
    the findings returned are those of the versions asked for.  docs must have text; a null
    text is an empty one, which has no findings.  Null keys, equal rows and old versions of a
    path each keep a row of their own.  Places count code points, the end is not included.  An
    empty table gives no rows and writes nothing.
    """
    spark = docs.sparkSession
    (blob,) = fresh(docs.select(*keep), "blob")
    paths = staged(docs.select(F.struct(*keep).alias("row"), blob_of().alias("blob")), "secret-paths")
    copies = staged(paths.groupBy("blob").agg(F.count("*").alias("n")), "secret-blobs")
    todo = staged(unseen(copies, ledger_at(spark, ledger), rules), "secret-todo")
    n = todo.count()
    if n:
        texts = docs.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("t"))
        if n <= BROADCAST_BLOBS:
            texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
        one = texts.groupBy("blob").agg(F.first("t").alias("t"))  # copies go before the shuffle; then the ids are where their texts are
        _scanned(one.join(todo, "blob"), rules).write.mode("append").option("compression", "zstd").parquet(ledger)
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.struct(F.lit(k).alias("k"), F.lit(r.kind).alias("kind")))])
    current = ledger_at(spark, ledger).where("size(spans) > 0").select("blob", F.explode("spans").alias("s")).where(F.col("s.rule").isin([r.name for r in rules]))
    found = current.withColumn("o", order[F.col("s.rule")]).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(F.col("s.start").alias("start"), F.col("o.k").alias("k"), F.col("s.end").alias("end"), F.col("o.kind").alias("kind")))).alias("found"))
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(copies.where(F.col("n") * HOT > total).select("blob", F.lit(True).alias("hot")))
    dealt = paths.join(hot, "blob", "left").withColumn("salt", F.when(F.col("hot"), (F.monotonically_increasing_id() % SALTS).cast("int")).otherwise(F.lit(0)))
    for_each = found.join(hot, "blob", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    out = dealt.join(for_each.select("blob", "salt", "found"), ["blob", "salt"], "left")
    findings = F.transform(F.coalesce("found", F.array().cast("array<struct<start: bigint, k: int, end: bigint, kind: string>>")), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    return out.select("row.*", F.col("blob").alias(blob), findings.alias("findings"))


def new_ledger(spark) -> str:
    """A path for a ledger in the shared folder."""
    return new_path(spark, "secret-ledger")
