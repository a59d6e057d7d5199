"""What is known after a contest, kept as rows that add up.

For each player, player and champion, pair of teammates, champion, role and patch there is one
row of sums, counts, extremes and a ring of the latest contests.  New contests give rows of
the same kind, which are merged by key; so the corpus is never read again, neither to fold
contests in nor to serve one: a live contest reads the rows of its own players and champions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenfold.functions.scalars import epoch_seconds
from tenfold.schemas import PLAYER_FEATURES, TRAITS
from tenfold.sources.tables import staged

from . import features as X

VERSION = 1
#: Contests of a player that are kept one by one; of these, those of the recent form; keys of a live batch that are looked up by value.
RING, RECENT, ASKED = 40, 10, 1000
MEANS = {"cs_per_min": "cs / minutes", "gold_per_min": "gold_earned / minutes", "vision_per_min": "vision_score / minutes", "kda": "(kills + assists) / cast(greatest(deaths, 1) AS double)", "dmg_share": "CASE WHEN team_dmg > 0 THEN dmg_champs / cast(team_dmg AS double) ELSE 0.2D END"}
_ROLES = {f"r{i}": f"CASE WHEN pos_idx = {i} THEN 1 ELSE 0 END" for i in range(5)}
_WINS = {f"rw{i}": f"CASE WHEN pos_idx = {i} THEN win ELSE 0 END" for i in range(5)}
_MEANS = {f"sum_{k}": e for k, e in MEANS.items()} | {f"count_{k}": f"CASE WHEN {e} IS NOT NULL THEN 1 ELSE 0 END" for k, e in MEANS.items()}
_STYLE = {f"style_sum_{t}": f"r_{t}" for t in TRAITS} | {f"style_count_{t}": f"CASE WHEN r_{t} IS NOT NULL THEN 1 ELSE 0 END" for t in TRAITS}
_GAMES = {"g": "1", "w": "win"}
#: table: (keys, columns that add up with the value of one row).
SUMS = {
    "player": (["puuid"], _GAMES | _ROLES | _WINS | _MEANS | _STYLE | {f"d_{k}": e for k, e in X.CURVE.items()}),
    "player_champion": (["puuid", "champion_id"], _GAMES | _ROLES),
    "pair": (["p1", "p2"], {"together": "1"}),
    "champion": (["champion_id"], _ROLES),
    "champion_role": (["patch", "champion_id", "pos_idx"], _GAMES),
    "champion_curve": (["champion_id", "pos_idx"], X.CURVE),
    "role_trait": (["pos_idx"], {f"sum_{t}": t for t in TRAITS} | {f"count_{t}": f"CASE WHEN {t} IS NOT NULL THEN 1 ELSE 0 END" for t in TRAITS}),
}
#: Of players, the least and greatest values, and the ring.
LEAST = {f"first{i}": f"CASE WHEN pos_idx = {i} THEN seq END" for i in range(5)}


def _ring(x: Column) -> Column:
    return F.slice(F.sort_array(x, asc=False), 1, RING)


def delta(rows: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """The state that contests alone give; ``known``, the role_trait rows of the state before them, tells their players' residuals."""
    at = X.trait_residuals(rows, known=known).withColumns({"ts_s": epoch_seconds(F.col("game_start")), "minutes": F.expr("greatest(duration_s, 1) / 60D"), "team_dmg": F.expr(f"sum(dmg_champs) OVER ({X.TEAM})")})
    at = staged(at, "state-rows")
    out = {}
    for name, (keys, sums) in SUMS.items():
        source = at if name != "pair" else at.alias("a").join(at.select("match_id", "team_id", F.col("puuid").alias("p2")), ["match_id", "team_id"]).where("puuid < p2").withColumnRenamed("puuid", "p1")
        more = [F.min(F.expr(e)).alias(c) for c, e in LEAST.items()] + [F.max("ts_s").alias("last")] if name == "player" else []
        out[name] = source.groupBy(*keys).agg(*[F.sum(F.expr(e)).alias(c) for c, e in sums.items()], *more)
    latest = at.select("puuid", "seq", "ts_s", "win", F.row_number().over(Window.partitionBy("puuid").orderBy(F.col("seq").desc())).alias("i")).where(F.col("i") <= RING)
    rings = latest.groupBy("puuid").agg(_ring(F.collect_list(F.struct("seq", "ts_s", "win"))).alias("ring"))
    out["player"] = out["player"].join(rings, "puuid")
    out["meta"] = at.agg(F.max("seq").alias("seq"), F.lit(VERSION).alias("version"))
    return out


def merged(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Both states as one, by key; the order of merging does not matter."""
    out = {}
    for name, (keys, sums) in SUMS.items():
        more = [F.min(c).alias(c) for c in LEAST] + [F.max("last").alias("last"), _ring(F.flatten(F.collect_list("ring"))).alias("ring")] if name == "player" else []
        out[name] = a[name].unionByName(b[name]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *more)
    out["meta"] = a["meta"].unionByName(b["meta"]).agg(F.max("seq").alias("seq"), F.max("version").alias("version"))
    return out


def fold(state: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
    """The state after contests that all come later than those in it."""
    return merged(state, delta(rows, state["role_trait"]))


def save(state: dict[str, DataFrame], folder: str) -> None:
    """Tables sorted by their first key, so that a lookup reads few row groups. meta comes last: a folder without it is no whole state."""
    for name, (keys, _) in SUMS.items():
        state[name].repartitionByRange(keys[0]).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{folder}/{name}")
    state["meta"].coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = spark.read.parquet(f"{folder}/meta").first().version
    if found != VERSION:
        raise ValueError(f"state version {found}, not {VERSION}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in [*SUMS, "meta"]}


def lookup(table: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """The table's rows of the keys in ``live``: by value, which the scan can be pruned by, for up to ASKED keys; more are joined."""
    keys = live.select(key).where(F.col(key).isNotNull()).distinct()
    asked = [r[0] for r in keys.limit(ASKED + 1).collect()]
    return table.where(F.col(key).isin(asked)) if len(asked) <= ASKED else table.join(keys, key, "left_semi")


def live_matrix(live: DataFrame, state: dict[str, DataFrame], min_history: int = 5) -> DataFrame:
    """The feature rows of live contests (match_id, puuid, team_id, champion_id, patch, game_start, seq, winner, pos_idx), from the state alone.

    A player, champion or pair that the state does not have has played no contest.  pos_idx
    and winner are not known yet and may be null; a true role only breaks ties of the inferred ones.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    fives = lambda prefix: F.array(*[zero(f"{prefix}{i}") for i in range(5)])
    player = lookup(state["player"], live, "puuid").select("puuid", F.struct("*").alias("p"))
    own = lookup(state["player_champion"], live, "puuid").select("puuid", "champion_id", F.struct("*").alias("pc"))
    champion = lookup(state["champion"], live, "champion_id").select("champion_id", F.struct("*").alias("ch"))
    at = live.join(player, "puuid", "left").join(own, ["puuid", "champion_id"], "left").join(champion, "champion_id", "left")
    ring = F.coalesce("p.ring", F.array().cast("array<struct<seq: bigint, ts_s: bigint, win: int>>"))
    mean = lambda c, of="": F.when(F.col(f"p.{of}count_{c}") > 0, F.col(f"p.{of}sum_{c}") / F.col(f"p.{of}count_{c}"))
    at = at.withColumns(
        {
            "ts_s": epoch_seconds(F.col("game_start")), "n": zero("p.g"), "w": zero("p.w"), "_ring": ring, "_last": F.col("p.last"),
            "rg": fives("p.r"), "rw": fives("p.rw"), "_first": F.array(*[F.col(f"p.first{i}") for i in range(5)]), "_cg": zero("pc.g"), "_cw": zero("pc.w"),
            "by_champion": fives("ch.r"), "by_player": fives("p.r"), "by_pair": fives("pc.r"), **{c: mean(c) for c in MEANS}, **{f"s_{t}": mean(t, "style_") for t in TRAITS},
            "style_games": zero("p.g").cast("double"), **{f"_d{k}": zero(f"p.d_{k}") for k in X.CURVE},
        }
    ).withColumns({"_times": F.expr("transform(_ring, x -> x.ts_s)"), "_rn": F.expr(f"least(size(_ring), {RECENT})"), "_rw": F.expr(f"aggregate(slice(_ring, 1, {RECENT}), 0, (a, x) -> a + x.win)"), "duration_preference": X.curve("_d", 8), "aggression": X.aggression()}).drop("p", "pc", "ch")
    at = staged(at, "live-rows")
    at = at.join(X.best_roles(X.scored_roles(at.select(*live.columns, "by_champion", "by_player", "by_pair"))), X.ID)
    by_role = lookup(state["champion_role"], live, "champion_id").select("patch", "champion_id", F.col("pos_idx").alias("role"), F.col("g").alias("_cg_r"), F.col("w").alias("_cw_r"))
    curves = lookup(state["champion_curve"], live, "champion_id").withColumnRenamed("pos_idx", "role")
    rows = X.player_values(at).join(by_role, ["patch", "champion_id", "role"], "left").withColumns({"_g": zero("_cg_r"), "_w": zero("_cw_r")}).withColumn("champ_role_winrate", X.champion_role_winrate())
    rows = rows.select(*[c for c in dict.fromkeys([*live.columns, "role", *PLAYER_FEATURES, *[f"s_{t}" for t in TRAITS], "style_games", "duration_preference", "aggression"])])
    styled = rows.join(curves, ["champion_id", "role"], "left").fillna(0, list(X.CURVE)).withColumn("champion_scaling", X.curve("", 40))
    mates = live.select("match_id", "team_id", F.col("puuid").alias("p1")).join(live.select("match_id", "team_id", F.col("puuid").alias("p2")), ["match_id", "team_id"]).where("p1 < p2")
    pairs = mates.join(lookup(state["pair"], live.withColumnRenamed("puuid", "p1"), "p1"), ["p1", "p2"], "left").fillna(0, ["together"])
    return X.team_differences(rows, min_history).drop("seq").join(X.style_rows(styled, X.premades(pairs)), "match_id")
