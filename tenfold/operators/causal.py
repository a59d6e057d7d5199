"""Point-in-time aggregates: what was known strictly before a contest.

``seq`` numbers contests in time, so a range frame that ends at 1 preceding leaves out the
whole current contest.  Keys with few values would put much of the data in one window;
``prior_sums`` splits those by blocks of seq and adds the totals of earlier blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def with_seq(df: DataFrame, start: str = "game_start", group: str = "match_id") -> DataFrame:
    """Number groups by (start, id) from 0."""
    from tenfold.sources.tables import ordinal

    return df.join(ordinal(df.select(start, group).distinct(), [start, group], "seq").select(group, "seq"), group)


def exactly_ten(df: DataFrame, group: str = "match_id") -> DataFrame:
    """Groups of ten rows; others are neither read nor folded in."""
    return df.join(df.groupBy(group).agg(F.count("*").alias("_n")).where("_n = 10").select(group), group, "left_semi")


def before(*keys: str) -> str:
    return f"PARTITION BY {', '.join(keys)} ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def last(n: int, *keys: str) -> str:
    return f"PARTITION BY {', '.join(keys)} ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


def over(sql: str, window: str, default: str | None = "0") -> Column:
    return F.expr(f"coalesce({sql} OVER ({window}), {default})" if default is not None else f"{sql} OVER ({window})")


def prior_sums(df: DataFrame, keys: list[str], sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds for each name the sum of its expression over earlier seqs of the same keys (0 if none)."""
    names = list(sums)
    at = df.withColumns({f"_v_{n}": F.coalesce(F.expr(e), F.lit(0)) for n, e in sums.items()}).withColumn("_block", F.floor(F.col("seq") / block))
    blocks = at.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb"), *[F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_block").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    local = at.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)], F.col("_block") == F.col("_kb"))
    return local.join(offsets, same).select(*[df[c] for c in df.columns], *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names])


def asof_sums(writes: DataFrame, reads: DataFrame, keys: list[str], sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """For each read row (keys, seq, ...) the sums over writes of the same keys with an earlier seq.

    Reads and writes are one tagged table, so a read key may differ from the write key.
    """
    names = list(sums)
    written = writes.select(*keys, "seq", *[F.coalesce(F.expr(e), F.lit(0)).cast("long").alias(f"_w_{n}") for n, e in sums.items()], F.lit(None).cast(reads.select(F.struct("*")).schema[0].dataType).alias("_row"))
    asked = reads.select(*keys, "seq", *[F.lit(0).cast("long").alias(f"_w_{n}") for n in names], F.struct("*").alias("_row"))
    return prior_sums(written.unionByName(asked), keys, {n: f"_w_{n}" for n in names}, block).where("_row IS NOT NULL").select("_row.*", *names)


def condensed(writes: DataFrame, reads: DataFrame, keys: list[str], sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """The writes added up to fewer rows, which give the reads the same sums: a block of seqs in which nothing is read is one row of each key."""
    at = F.floor(F.col("seq") / block)
    read = reads.select(at.alias("_block")).distinct().withColumn("_read", F.lit(True))
    seq = F.when(F.col("_read"), F.col("seq")).otherwise(F.col("_block") * block).alias("seq")
    marked = writes.withColumn("_block", at).join(F.broadcast(read), "_block", "left")
    return marked.groupBy(*keys, seq).agg(*[F.sum(F.coalesce(F.expr(e), F.lit(0)).cast("long")).alias(n) for n, e in sums.items()])


def running_mean(df: DataFrame, key: str, order: list[str], values: list[str], block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """Adds <value>_mean: the mean of earlier rows of the key, row by row in ``order`` (of which seq is the first), nulls left out.

    ``known`` (key, sum_<value>, count_<value>) has what came before all rows of df.
    """
    at = df.withColumn("_block", F.floor(F.col("seq") / block))
    blocks = at.groupBy(key, "_block").agg(*[f(v).alias(f"_{t}_{v}") for v in values for t, f in (("s", F.sum), ("c", F.count))])
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(key, "_block", *[F.coalesce(F.sum(f"_{t}_{v}").over(earlier), F.lit(0)).alias(f"_o{t}_{v}") for v in values for t in "sc"])
    if known is not None:
        more = known.select(key, *[F.col(f"{n}_{v}").alias(f"_k{t}_{v}") for v in values for t, n in (("s", "sum"), ("c", "count"))])
        offsets = offsets.join(more, key, "left").select(key, "_block", *[(F.col(f"_o{t}_{v}") + F.coalesce(f"_k{t}_{v}", F.lit(0))).alias(f"_o{t}_{v}") for v in values for t in "sc"])
    inside = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda v: F.coalesce(F.sum(v).over(inside), F.lit(0.0)) + F.col(f"_os_{v}")
    many = lambda v: F.coalesce(F.count(v).over(inside), F.lit(0)) + F.col(f"_oc_{v}")
    joined = at.join(offsets, [key, "_block"])
    return joined.select(*df.columns, *[F.when(many(v) > 0, total(v) / many(v)).alias(f"{v}_mean") for v in values])
