"""Serving as a batch of one: the very code of training over a history that ends with the live contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenfold.functions.scalars import anonymous_id
from tenfold.operators.features import CURVE, feature_rows
from tenfold.schemas import QUEUE_ID, TRAITS
from tenfold.sources.tables import staged

from .mlops import LinearModel
from .training import Predictor


def snapshot(df: DataFrame) -> dict[str, DataFrame]:
    """Corpus-level aggregates over all folded contests."""
    games = [F.count("*").alias("games"), F.sum("win").alias("wins")]
    traits = [c for c in TRAITS if c in df.columns]
    return {
        "champ_role": df.groupBy("patch", "champion_id", "pos_idx").agg(*games),
        "champ_duration": df.groupBy("champion_id", "pos_idx").agg(*[F.sum(F.expr(e)).alias(k) for k, e in CURVE.items()]),
        "role_traits": df.groupBy("pos_idx").agg(*[f(t).alias(f"{n}_{t}") for t in traits for n, f in (("sum", F.sum), ("count", F.count))]),
        "role_champ": df.groupBy("champion_id").agg(*[F.count_if(F.col("pos_idx") == r).alias(f"role_{r}") for r in range(5)]),
        "meta": df.agg(F.countDistinct("match_id").alias("matches"), F.max_by("patch", "seq").alias("latest_patch"), F.lit(1).alias("version")),
    }


SNAPSHOT = ("champ_role", "champ_duration", "role_traits", "role_champ", "meta")


def save_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """meta comes last: a folder without it is not a whole snapshot."""
    for name in SNAPSHOT:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def load_snapshot(spark: SparkSession, folder: str, version: int = 1) -> dict[str, DataFrame]:
    found = spark.read.parquet(f"{folder}/meta").first().version
    if found != version:
        raise ValueError(f"snapshot version {found}, not {version}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in SNAPSHOT}


def ineligible_reason(platforms: list[str]) -> Column:
    """Why a live contest cannot be scored; null if it can. Needs platform, queue_id, n_participants, n_anonymous; a null counts as '' or 0."""
    platform, queue, players = F.upper(F.coalesce("platform", F.lit(""))), F.coalesce("queue_id", F.lit(0)), F.coalesce("n_participants", F.lit(0))
    return (
        F.when(~platform.isin(platforms), F.concat(F.lit("platform="), platform))
        .when(queue != QUEUE_ID, F.concat(F.lit("queue="), queue.cast("string")))
        .when(players != 10, F.concat(F.lit("participants="), players.cast("string")))
        .when(F.coalesce("n_anonymous", F.lit(0)) == players, "anonymous")
    )


def live_players(games: DataFrame) -> DataFrame:
    """(match_id, puuid, team_id, champion_id, name, anonymous) of live games (game_id, platform, participants); hidden players get an id that no history has, and no name."""
    p = games.select("game_id", F.concat_ws("_", F.upper("platform"), F.col("game_id").cast("string")).alias("match_id"), F.posexplode("participants").alias("i", "p"))
    hidden = F.coalesce("p.puuid", F.lit("")) == ""
    return p.select("match_id", F.when(hidden, anonymous_id(F.col("game_id"), F.col("i"))).otherwise(F.col("p.puuid")).alias("puuid"), F.coalesce("p.teamId", F.lit(0)).alias("team_id"), F.coalesce("p.championId", F.lit(0)).alias("champion_id"), F.when(~hidden, F.coalesce("p.riotId", "p.summonerName")).alias("name"), hidden.alias("anonymous"))


def with_names(scored: DataFrame, players: DataFrame) -> DataFrame:
    """Rows by player with the name that the live game gave; null where it gave none."""
    names = players.groupBy("match_id", "puuid").agg(F.first("name").alias("name"), F.first("anonymous").alias("anonymous"))
    return scored.join(names, ["match_id", "puuid"], "left")


def missing_history(depth: DataFrame, listed: DataFrame, stored: DataFrame, games: int) -> DataFrame:
    """(puuid, match_id) to fetch: of each player short of that many games, the latest listed ids not stored yet."""
    short = depth.where(F.col("games") < games).select("puuid", (F.lit(games) - F.col("games")).alias("need"))
    rows = listed.join(stored.select("match_id"), "match_id", "left_anti").join(short, "puuid")
    place = F.row_number().over(Window.partitionBy("puuid").orderBy(F.col("ord"), "match_id"))
    return rows.withColumn("_i", place).where("_i <= need").select("puuid", "match_id")


def predict(live: DataFrame, history: DataFrame, model: LinearModel | Predictor | None = None, min_history: int = 5) -> DataFrame:
    """The live contests' feature rows, with p in [0.01, 0.99] if a model is given. Pure: nothing is kept between calls."""
    live = staged(history.where("false").unionByName(live, allowMissingColumns=True), "live")
    rows = history.join(live.select("match_id").distinct(), "match_id", "left_anti").unionByName(live, allowMissingColumns=True)
    row = feature_rows(rows, live, min_history)
    if model is None:
        return row
    return row.join(model.predict(row), "match_id").withColumn("p", F.least(F.greatest("p", F.lit(0.01)), F.lit(0.99)))
