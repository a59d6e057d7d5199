"""What to collect next: states, plan, coverage.  Pure functions on tables; a changed table is a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenfold.sources.tables import new_rows


def players(rows: DataFrame, source: str, now: Column) -> DataFrame:
    """Ladder or snowball rows as player rows; rows without an id go."""
    return rows.where(F.coalesce("puuid", F.lit("")) != "").select("puuid", "tier", F.col("rank").alias("division"), F.col("leaguePoints").alias("lp"), F.lit(source).alias("source"), now.alias("discovered_at"), F.lit(None).cast("timestamp_ntz").alias("processed_at"), F.lit(None).cast("int").alias("n_match_ids"))


def rank_snapshots(rows: DataFrame, queue: str, observed: Column) -> DataFrame:
    """Rank rows that have an id and a tier, with one time for all."""
    has = (F.coalesce("puuid", F.lit("")) != "") & (F.coalesce("tier", F.lit("")) != "")
    return rows.where(has).select("puuid", F.lit(queue).alias("queue"), "tier", F.col("rank").alias("division"), F.col("leaguePoints").alias("lp"), "wins", "losses", observed.alias("observed_at"))


def updated(table: DataFrame, staging: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """UPDATE ... FROM staging: columns of staging replace those of equal name where the key matches; the first row of a key counts."""
    cols = [c for c in staging.columns if c not in (key, order)]
    value = F.struct(*([order] if order else []), *cols)
    one = staging.groupBy(key).agg(F.min(value).alias("_new"))
    return table.join(one, key, "left").select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns])


def unprocessed(crawl_players: DataFrame) -> DataFrame:
    return crawl_players.where("processed_at IS NULL")


def claim(crawl_players: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n queued players: in order of discovery, or by a seeded shuffle."""
    return unprocessed(crawl_players).orderBy(*(["discovered_at", "puuid"] if seed is None else [F.xxhash64(F.lit(seed), "puuid"), "puuid"])).limit(n)


def pending(matches: DataFrame, least: int = 0) -> DataFrame:
    return matches.where((F.col("state") == "pending") & (F.col("discovery_count") >= least)) if least else matches.where("state = 'pending'")


def resolved(matches: DataFrame) -> DataFrame:
    return matches.where("state <> 'pending'")


def next_pending(matches: DataFrame, plan: DataFrame | None, n: int) -> DataFrame:
    """The next n ids to fetch: by plan priority, then known players, then id."""
    rows = pending(matches)
    if plan is not None:
        rows = rows.join(plan.select("match_id", "priority"), "match_id")
    else:
        rows = rows.withColumn("priority", F.lit(0))
    return rows.orderBy(F.coalesce("priority", F.lit(0)).desc(), F.col("discovery_count").desc(), "match_id").limit(n)


def discovery_counts(edges: DataFrame) -> DataFrame:
    """Known players of each match, from its edges."""
    return edges.groupBy("match_id").agg(F.count("*").alias("discovery_count"))


def add_discoveries(edges: DataFrame, matches: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new edges, new pending matches, matches with their counts brought up to date for touched ids)."""
    fresh = new_rows(batch.select("match_id", "puuid"), edges, ["match_id", "puuid"])
    unseen = fresh.select("match_id").distinct().join(matches, "match_id", "left_anti").select("match_id", F.lit("pending").alias("state"), F.lit(None).cast("string").alias("reason"), now.alias("discovered_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(0).alias("discovery_count"), F.lit(0).alias("attempts"))
    touched = edges.select("match_id", "puuid").union(fresh).join(fresh.select("match_id").distinct(), "match_id", "left_semi")
    counts = discovery_counts(touched).withColumn("discovery_count", F.col("discovery_count").cast("int"))
    return fresh, unseen, updated(matches.unionByName(unseen, allowMissingColumns=True), counts, "match_id")


def set_plan(ids: DataFrame) -> DataFrame:
    return ids.select("match_id").distinct().withColumn("priority", F.lit(0))


def extend_plan(plan: DataFrame, ids: DataFrame) -> DataFrame:
    return plan.unionByName(new_rows(set_plan(ids), plan, ["match_id"]))


def prioritised(plan: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The plan with priority: edges of the match to target players, else 0."""
    n = edges.join(targets.select("puuid").distinct(), "puuid", "left_semi").groupBy("match_id").agg(F.count("*").cast("int").alias("_n"))
    return plan.join(n, "match_id", "left").select("match_id", F.coalesce("_n", F.lit(0)).alias("priority"))


def priority_histogram(plan: DataFrame, matches: DataFrame, top: int = 8) -> DataFrame:
    """Pending planned matches by priority, the highest first."""
    return plan.join(pending(matches).select("match_id"), "match_id").groupBy("priority").agg(F.count("*").alias("n")).orderBy(F.col("priority").desc()).limit(top)


def after_failures(matches: DataFrame, failed: DataFrame, now: Column, max_attempts: int = 4) -> DataFrame:
    """One more attempt for failed ids: dead at the limit, else pending again."""
    hit = F.col("_hit").isNotNull()
    tries = F.coalesce("attempts", F.lit(0)) + 1
    dead = tries >= max_attempts
    rows = matches.join(failed.select("match_id").distinct().withColumn("_hit", F.lit(1)), "match_id", "left")
    changed = {"attempts": tries, "state": F.when(dead, "error").otherwise("pending"), "resolved_at": F.when(dead, now)}
    return rows.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in matches.columns])


def failure_counts(after: DataFrame, failed: DataFrame) -> DataFrame:
    """(requeued, dead) among the failed ids."""
    rows = after.join(failed.select("match_id").distinct(), "match_id", "left_semi")
    return rows.agg(F.count_if(F.col("state") != "error").alias("requeued"), F.count_if(F.col("state") == "error").alias("dead"))


def requeued(matches: DataFrame, reset_attempts: bool = True) -> DataFrame:
    """Errors become pending."""
    error = F.col("state") == "error"
    changed = {"state": F.lit("pending"), "resolved_at": F.lit(None)} | ({"attempts": F.lit(0)} if reset_attempts else {})
    return matches.select(*[F.when(error, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in matches.columns])


def progress(matches: DataFrame) -> DataFrame:
    """Counts of all states in one pass; 0 for absent ones."""
    return matches.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "stored", "rejected", "error")], F.count("*").alias("total"))


def tier_breakdown(crawl_players: DataFrame) -> DataFrame:
    return crawl_players.groupBy(F.coalesce("tier", F.lit("(unknown)")).alias("tier")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tier")


def coverage_histogram(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(covered, n, n_at_least): matches by how many of their players are known, exact and cumulative."""
    flag = known.select("puuid").distinct().withColumn("_known", F.lit(1))
    per = edges.join(flag, "puuid", "left").groupBy("match_id").agg(F.count("_known").alias("covered"))
    rows = per.groupBy("covered").agg(F.count("*").alias("n"))
    return rows.select("covered", "n", F.sum("n").over(Window.orderBy(F.col("covered").desc())).alias("n_at_least"))


def fully_covered(edges: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Edges of matches of which at least that many players, and all there are, are known."""
    flag = known.select("puuid").distinct().withColumn("_known", F.lit(1))
    per = edges.join(flag, "puuid", "left").groupBy("match_id").agg(F.count("_known").alias("covered"), F.count("*").alias("n")).where((F.col("covered") >= least) & (F.col("covered") == F.col("n")))
    return edges.join(per.select("match_id"), "match_id", "left_semi")


def fully_processed(participants: DataFrame, crawl_players: DataFrame, size: int = 10) -> DataFrame:
    """(match_id, puuid) of stored matches of which that many participants are processed."""
    known = crawl_players.where("processed_at IS NOT NULL").select("puuid").distinct().withColumn("_known", F.lit(1))
    per = participants.join(known, "puuid", "left").groupBy("match_id").agg(F.count("_known").alias("covered")).where(F.col("covered") == size)
    return participants.join(per.select("match_id"), "match_id", "left_semi").select("match_id", "puuid")


def pending_histogram(matches: DataFrame) -> DataFrame:
    """(discovery_count, n): how many pending matches stand at each count."""
    return pending(matches).groupBy("discovery_count").agg(F.count("*").alias("n"))


def processed(players: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Players with the time and the number of ids that were listed for them; done has puuid and n_match_ids."""
    return updated(players, done.select("puuid", now.alias("processed_at"), F.col("n_match_ids").cast("int").alias("n_match_ids")), "puuid")


def migrated(matches: DataFrame) -> DataFrame:
    """Older tables get attempts and discovery_count, 0 where missing."""
    for c in ("attempts", "discovery_count"):
        matches = matches.withColumn(c, F.coalesce(F.col(c), F.lit(0)) if c in matches.columns else F.lit(0))
    return matches
