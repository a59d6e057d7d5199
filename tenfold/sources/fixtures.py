"""Ten-slot contests, edges and states derived from the test tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ordinal, staged

#: Traits: expression by name; about a tenth of each is null.
TRAIT_SQL = {
    "damage_per_minute": "CASE WHEN k % 11 = 0 THEN NULL ELSE value END",
    "vision_per_min": "CASE WHEN k % 7 = 0 THEN NULL ELSE CAST((event_id*5) % 31 AS DOUBLE) END",
    "solo_kills": "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(k % 6 AS DOUBLE) END",
    "team_damage_pct": "CASE WHEN k % 13 = 0 THEN NULL ELSE CAST((event_id*3) % 40 AS DOUBLE) END",
    "damage_taken_pct": "CASE WHEN k % 9 = 0 THEN NULL ELSE CAST((event_id*11) % 37 AS DOUBLE) END",
    "kill_participation": "CASE WHEN k % 12 = 0 THEN NULL ELSE CAST((event_id*19) % 101 AS DOUBLE) END",
    "turret_plates": "CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k % 5 AS DOUBLE) END",
    "max_cs_adv_lane": "CASE WHEN event_type = 'click' AND k % 2 = 0 THEN NULL ELSE CAST(k % 29 AS DOUBLE) END",
    "time_spent_dead": "CASE WHEN k % 8 = 0 THEN NULL ELSE CAST((event_id*3) % 200 AS DOUBLE) END",
}
SLOT_SQL = ["event_id", "ts", "event_type", "value", "user_id", "CAST(regexp_extract(props,'[0-9]+',0) AS INT) AS k", "rn", "CAST(floor(rn/10) AS BIGINT) AS match_seq", "CAST(rn % 10 AS INT) AS slot", "CAST(floor((rn % 10)/5) AS BIGINT) AS side"]
ROW_SQL = [
    "match_seq", "game_start", "n_seq", "event_type",
    "'M_' || lpad(CAST(match_seq AS VARCHAR(20)),8,'0') AS match_id",
    "'16.' || CAST(1 + CAST(floor(match_seq*4/n_seq) AS INT) AS VARCHAR(4)) AS patch",
    "900 + CAST((match_seq*37) % 1800 AS INT) AS duration_s",
    "CASE WHEN (match_seq*7919) % 13 < 7 THEN 100 ELSE 200 END AS winner",
    "CASE WHEN (side + match_seq) % 2 = 0 THEN 100 ELSE 200 END AS team_id",
    "'P_' || CAST(slot*100 + user_id % 15 AS VARCHAR(20)) AS puuid",
    "CAST((slot + match_seq) % 5 AS INT) AS pos_idx",
    "k % 20 AS champion_id",
    "CASE WHEN ((match_seq*7919) % 13 < 7) = ((side + match_seq) % 2 = 0) THEN 1 ELSE 0 END AS win",
    "CAST((event_id*31) % 17 AS INT) AS kills", "CAST((event_id*17) % 11 AS INT) AS deaths", "CAST((event_id*13) % 19 AS INT) AS assists",
    "8000 + CAST((event_id*97) % 9000 AS INT) AS gold_earned", "CAST((event_id*7) % 260 AS INT) AS cs", "CAST((event_id*5) % 61 AS INT) AS vision_score",
    "CAST(floor(value*100) AS INT) AS dmg_champs",
    *(f"{sql} AS {name}" for name, sql in TRAIT_SQL.items()),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each participant of each contest: ten events in a row make a contest. seq is the contest's place in time. Written once as a table, since most operators read it several times."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "user_id", "props")
    slots = ordinal(events, ["ts", "event_id"], "rn").selectExpr(*SLOT_SQL)
    starts = slots.groupBy("match_seq").agg(F.min("ts").alias("game_start"))
    n = (F.col("last") + 1).alias("n_seq")
    rows = slots.join(starts, "match_seq").crossJoin(F.broadcast(starts.agg(F.max("match_seq").alias("last")).select(n))).selectExpr(*ROW_SQL)
    return staged(rows.withColumn("seq", F.col("match_seq")), "contests")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS match_id", "l_suppkey AS puuid").distinct()


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl states of groups, from orders."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS match_id", "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'stored' ELSE 'error' END AS state", "CAST(o_orderkey % 5 AS INT) AS attempts", "o_orderdate AS discovered_at")
