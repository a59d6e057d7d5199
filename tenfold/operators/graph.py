"""k-core of the match-player graph, and the greedy top-up of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenfold.sources.tables import staged


def _peeled(edges: DataFrame, key: str, least: int) -> DataFrame:
    return edges.join(edges.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi").select("match_id", "puuid")


def k_core(edges: DataFrame, per_match: int = 3, per_player: int = 5) -> DataFrame:
    """Edges left when matches and players below their degrees are peeled off in turn until nothing changes.

    Each round's edges are written as a table: the lineage stays short, and a lost executor costs one round.
    There are as many rounds as the graph needs; each but the last takes an edge at least.
    """
    edges = staged(edges.select("match_id", "puuid").distinct(), "core")
    n = edges.count()
    while n:
        edges = staged(_peeled(_peeled(edges, "match_id", per_match), "puuid", per_player), "core")
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def plan_report(core: DataFrame) -> DataFrame:
    """(players, matches, games_per_player)"""
    return core.agg(F.countDistinct("puuid").alias("players"), F.countDistinct("match_id").alias("matches"), F.round(F.count("*") / F.countDistinct("puuid"), 1).alias("games_per_player"))


def post_counts(edges: DataFrame, plan: DataFrame, players: DataFrame) -> DataFrame:
    """players (puuid, ...) with post: their matches in the plan, 0 for none."""
    post = edges.join(plan.select("match_id"), "match_id", "left_semi").groupBy("puuid").agg(F.count("*").alias("post"))
    return players.join(post, "puuid", "left").withColumn("post", F.coalesce("post", F.lit(0)))


def candidates(edges: DataFrame, plan: DataFrame, resolved: DataFrame, short: DataFrame) -> DataFrame:
    """(match_id, who): matches neither planned nor resolved, with their short players."""
    free = edges.join(plan.select("match_id").union(resolved.select("match_id")).distinct(), "match_id", "left_anti")
    return free.join(short.select("puuid"), "puuid", "left_semi").groupBy("match_id").agg(F.sort_array(F.collect_list("puuid")).alias("who"))


def top_up(edges: DataFrame, plan: DataFrame, resolved: DataFrame, targets: DataFrame, min_coverage: int = 0, games: int = 10) -> DataFrame:
    """(match_id): matches to add so that the players of target matches reach that many planned games.

    Matches are looked at by how many short players they have, the most first, and then by id; one that
    still serves a player in need is taken, and all its players in need are served once.  A player is in
    need as long as fewer matches than needed were taken that have them, so each of the first ``need``
    matches of a player is taken, whoever else is in it, and after these the player needs none: what the
    scan takes is the union of every player's first matches.  That is one window by player, in any number
    of tasks; of a player with very many matches, each task sends on the first ``games`` only.

    One row for each edge and target is expected (tables with these keys); players who cannot reach the
    number get all their matches; null players match nothing.
    """
    counted = post_counts(edges, plan, targets)
    if min_coverage > 0:
        enough = counted.groupBy("match_id").agg(F.count_if(F.col("post") >= games).alias("ok")).where(F.col("ok") >= min_coverage)
        counted = counted.join(enough.select("match_id"), "match_id", "left_semi")
    short = counted.where(F.col("post") < games).select("puuid", (F.lit(games) - F.col("post")).cast("int").alias("need")).distinct()
    served = candidates(edges, plan, resolved, short).select("match_id", F.size("who").alias("n"), F.explode("who").alias("puuid"))
    turn = F.row_number().over(Window.partitionBy("puuid").orderBy(F.col("n").desc(), "match_id"))
    first = served.withColumn("turn", turn).where(F.col("turn") <= games).join(short, "puuid")
    return first.where("turn <= need").select("match_id").distinct()
