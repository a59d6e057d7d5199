"""Stored tables to the flat history that features start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.schemas import TRAITS

from .causal import with_seq


def joined_history(matches: DataFrame, participants: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """One row of each participant of each stored match, with the match's columns, the traits (null where there are none) and seq, the match's place in time."""
    rows = matches.select("match_id", "game_start", "patch", "duration_s", F.col("winner").cast("int").alias("winner")).join(participants, "match_id")
    if extras is not None:
        rows = rows.join(extras.select("match_id", "puuid", *TRAITS), ["match_id", "puuid"], "left")
    else:
        rows = rows.withColumns({t: F.lit(None).cast("double") for t in TRAITS})
    rows = rows.withColumns({"win": F.col("win").cast("int"), "pos_idx": F.col("team_pos_idx").cast("int"), "team_id": F.col("team_id").cast("int")}).drop("team_pos_idx")
    return with_seq(rows)


def history_of(history: DataFrame, players: DataFrame, exclude: str | None = None) -> DataFrame:
    """All rows of the matches in which any of the players took part, without the match excluded."""
    ids = history.join(players.select("puuid").distinct(), "puuid", "left_semi").select("match_id").distinct()
    if exclude is not None:
        ids = ids.where(F.col("match_id") != exclude)
    return history.join(ids, "match_id", "left_semi")


def depth(history: DataFrame, players: DataFrame) -> DataFrame:
    """(puuid, games): how many matches of each player are at hand; 0 for none."""
    n = history.groupBy("puuid").agg(F.count("*").alias("games"))
    return players.select("puuid").distinct().join(n, "puuid", "left").select("puuid", F.coalesce("games", F.lit(0)).alias("games"))
