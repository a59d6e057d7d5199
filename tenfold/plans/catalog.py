"""Registered queries on the derived contests, edges and states; each takes (spark, sf_dir)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.functions.scalars import anonymous_id, epoch_seconds, parse_patch, parse_target, patch_number, smoothed
from tenfold.operators import features as X
from tenfold.operators import frontier, graph, ingest, state
from tenfold.operators.causal import asof_sums, before, exactly_ten, last, over, with_seq
from tenfold.schemas import PLAYER_FEATURES, TRAITS
from tenfold.sources.fixtures import contests, edges, states, table
from tenfold.sources.tables import latest, new_path, new_rows

from . import mlops, predict

Q: dict = {}
ID = ["match_id", "puuid"]


def query(f):
    Q[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and minus zero made zero, so that two engines agree; a tiny shift keeps exact halves from being rounded in two ways."""
    return df.select(*[(F.round(F.col(c) + F.lit(3.17e-8), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def prior_games_winrate(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf).withColumns({"n": over("count(*)", X.P), "w": over("sum(win)", X.P)})
    return rounded(df.select(*ID, F.col("n").alias("games"), F.col("w").alias("wins"), smoothed(F.col("w"), F.col("n"), 0.5, 10).alias("winrate")))


@query
def recent_form_last10(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf).withColumns({"n": over("count(*)", last(10, "puuid")), "w": over("sum(win)", last(10, "puuid"))})
    return df.select(*ID, F.col("n").alias("recent_games"), F.col("w").alias("recent_wins"))


def _features(columns: list[str], spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf).withColumn("role", F.col("pos_idx"))
    return rounded(X.player_features(df).select(*ID, *columns))


FEATURE_GROUPS = {
    "entity_category_prior": ["champ_games", "champ_winrate", "first_time_champ"],
    "ratio_means_prior": ["cs_per_min", "gold_per_min", "kda", "dmg_share", "vision_per_min"],
    "days_since_last": ["days_since_last"],
    "games_last_24h_of_40": ["games_today"],
    "main_role_off_role": ["role_games", "role_winrate", "off_role"],
    "asof_key_prior": ["champ_role_winrate"],
}
Q |= {name: partial(_features, cols) for name, cols in FEATURE_GROUPS.items()}


@query
def duration_curve_prior(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.champion_scaling(contests(spark, sf).withColumn("role", F.col("pos_idx"))))


@query
def duration_preference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.duration_preference(contests(spark, sf)).select(*ID, "duration_preference"))


@query
def pair_history(spark: SparkSession, sf: str) -> DataFrame:
    return X.premade_pairs(contests(spark, sf))


@query
def role_counts_prior(spark: SparkSession, sf: str) -> DataFrame:
    got = X.role_counts(contests(spark, sf))
    return got.select(*ID, *[F.col(f"by_{k}")[r].alias(f"{k}_{r}") for k in ("champion", "player", "pair") for r in range(5)])


@query
def role_log_prior(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.role_scores(contests(spark, sf)).select(*ID, *[F.col("scores")[r].alias(f"score_{r}") for r in range(5)]))


@query
def role_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return X.assigned_roles(contests(spark, sf))


@query
def role_residual(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.trait_residuals(contests(spark, sf)).select(*ID, *[f"r_{t}" for t in TRAITS]))


@query
def trait_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.player_style(contests(spark, sf)).select(*ID, *[f"s_{t}" for t in TRAITS], "style_games", "aggression"))


@query
def team_feature_diff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.team_differences(X.player_features(X.with_roles(contests(spark, sf), post_game=True))).drop("seq", "game_start"))


@query
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.feature_matrix(exactly_ten(contests(spark, sf))))


@query
def lane_diff(spark: SparkSession, sf: str) -> DataFrame:
    got = X.style_differences(X.with_roles(contests(spark, sf), post_game=True))
    return rounded(got.select("match_id", *[c for c in got.columns if c.startswith("d_lane_")]))


@query
def interaction_terms(spark: SparkSession, sf: str) -> DataFrame:
    got = X.style_differences(X.with_roles(contests(spark, sf), post_game=True))
    return rounded(got.select("match_id", *[c for c in got.columns if c.startswith("x_")], "d_premade_pairs", "d_champ_scaling_mean"))


@query
def coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf).withColumn("n", over("count(*)", X.P))
    side = lambda t: F.count_if((F.col("team_id") == t) & (F.col("n") >= 5))
    return df.groupBy("match_id").agg(side(100).alias("blue_coverage"), side(200).alias("red_coverage"))


@query
def side_swap_union(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf).withColumn("n", over("count(*)", X.P))
    rows = df.groupBy("match_id").agg(F.first((F.col("winner") == 100).cast("int")).alias("blue_win"), X.difference(F.sum, "n").alias("d_games"), X.side(F.count, "n", 100).alias("blue_coverage"), X.side(F.sum, "win", 200).alias("red_coverage"))
    return X.side_swapped(rows)


@query
def contest_seq(spark: SparkSession, sf: str) -> DataFrame:
    return with_seq(contests(spark, sf).drop("seq")).select("match_id", "seq").distinct()


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey AS puuid")


@query
def insert_new_anti(spark: SparkSession, sf: str) -> DataFrame:
    batch = table(spark, sf, "lineitem").selectExpr("l_orderkey AS match_id", "l_linenumber AS line", "l_suppkey AS puuid")
    return new_rows(batch, table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS match_id"), ["match_id"], ["line"])


@query
def progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.progress(states(spark, sf))


@query
def filtered_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("(unknown)")).alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("processed"))


@query
def coverage_histogram_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.coverage_histogram(edges(spark, sf), _known(spark, sf))


@query
def discovery_counts(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.discovery_counts(edges(spark, sf))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return states(spark, sf).join(frontier.discovery_counts(edges(spark, sf)), "match_id", "left").withColumn("discovery_count", F.coalesce("discovery_count", F.lit(0)))


@query
def pending_topk(spark: SparkSession, sf: str) -> DataFrame:
    plan = frontier.prioritised(frontier.set_plan(edges(spark, sf)), edges(spark, sf), _known(spark, sf))
    return frontier.next_pending(_matches(spark, sf), plan, 50).select("match_id", "priority", "discovery_count")


@query
def claim_players(spark: SparkSession, sf: str) -> DataFrame:
    queue = table(spark, sf, "customer").selectExpr("c_custkey AS puuid", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS processed_at", "c_nationkey AS discovered_at")
    return frontier.claim(queue, 40).select("puuid", "discovered_at")


@query
def retry_transition(spark: SparkSession, sf: str) -> DataFrame:
    failed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS match_id")
    rows = states(spark, sf).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    return frontier.after_failures(rows, failed, F.lit("2026-01-01").cast("timestamp_ntz")).select("match_id", "state", "attempts", F.col("resolved_at").isNotNull().alias("dead"))


@query
def requeue(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.requeued(states(spark, sf)).select("match_id", "state", "attempts")


@query
def priority_score(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.prioritised(frontier.set_plan(edges(spark, sf)), edges(spark, sf), _known(spark, sf))


@query
def priority_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.priority_histogram(priority_score(spark, sf), states(spark, sf))


@query
def fully_covered_groups(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.fully_covered(edges(spark, sf), _known(spark, sf), 3)


@query
def staged_update(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.lit("stored").alias("state")).where("match_id % 3 = 0")
    return frontier.updated(states(spark, sf).select("match_id", "state", "attempts"), new, "match_id")


@query
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "lineitem").selectExpr("l_orderkey AS match_id", "l_linestatus AS state", "l_linenumber AS ord")
    return latest(log, ["match_id"], "ord").select("match_id", "state", "ord")


@query
def discoveries_added(spark: SparkSession, sf: str) -> DataFrame:
    old = edges(spark, sf).where("match_id % 4 <> 0")
    matches = states(spark, sf).where("match_id % 5 <> 0").select("match_id", "state", F.lit(0).alias("discovery_count"))
    return frontier.add_discoveries(old, matches, edges(spark, sf), F.lit(None).cast("timestamp_ntz"))[2].select("match_id", "state", "discovery_count")


def _core(per_match: int, per_player: int, spark: SparkSession, sf: str) -> DataFrame:
    return graph.k_core(edges(spark, sf), per_match, per_player)


Q |= {"kcore_edges": partial(_core, 3, 5), "kcore_edges_dense": partial(_core, 5, 20)}


@query
def plan_report(spark: SparkSession, sf: str) -> DataFrame:
    return graph.plan_report(graph.k_core(edges(spark, sf), 3, 5))


@query
def greedy_topup(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    plan = frontier.set_plan(e.where("match_id % 10 = 0"))
    targets = frontier.fully_covered(e, _known(spark, sf), 2)
    return graph.top_up(e, plan, frontier.resolved(states(spark, sf)), targets, games=100)


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """(match_id, payload): the derived contests as nested JSON; by match_seq % 11, every way to be refused stands in some."""
    role = F.element_at(F.array(*map(F.lit, ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"])), F.col("pos_idx") + 1)
    bad = F.col("match_seq") % 11
    position = F.when((bad == 6) & (F.col("pos_idx") == 2), F.lit("")).when((bad == 7) & (F.col("pos_idx") == 1), F.lit("TOP")).otherwise(role)
    df = contests(spark, sf)
    challenges = F.struct(F.col("damage_per_minute").alias("damagePerMinute"), F.col("solo_kills").alias("soloKills"), F.col("vision_per_min").alias("visionScorePerMinute"), F.lit("n/a").alias("multikills"))
    p = F.struct("puuid", F.col("team_id").alias("teamId"), position.alias("teamPosition"), F.col("champion_id").alias("championId"), (F.col("win") == 1).alias("win"), "kills", "deaths", "assists", F.col("gold_earned").alias("goldEarned"), F.col("cs").alias("totalMinionsKilled"), F.lit(1).alias("neutralMinionsKilled"), F.col("dmg_champs").alias("totalDamageDealtToChampions"), F.col("vision_score").alias("visionScore"), (F.col("win") == 1).alias("firstBloodKill"), challenges.alias("challenges"))
    rows = df.groupBy("match_id", "match_seq", "game_start", "duration_s", "winner", "patch").agg(F.sort_array(F.collect_list(p)).alias("participants"))
    ms = (F.unix_micros(F.col("game_start").cast("timestamp")) / 1000).cast("long")
    teams = F.when(bad == 9, F.array().cast("array<struct<teamId: int, win: boolean>>")).otherwise(F.array(F.struct(F.lit(100).alias("teamId"), (F.col("winner") == 100).alias("win")), F.struct(F.lit(200).alias("teamId"), (F.col("winner") == 200).alias("win"))))
    info = F.struct(
        F.when(bad == 1, 400).otherwise(420).alias("queueId"), F.when(bad == 3, 300).when(bad == 8, F.col("duration_s") * 1000).otherwise(F.col("duration_s")).alias("gameDuration"),
        F.when(bad == 5, F.lit("15.1.2")).otherwise(F.concat("patch", F.lit(".704.1234"))).alias("gameVersion"), F.when(bad == 4, F.lit("Abort_TooFewPlayers")).otherwise(F.lit("GameComplete")).alias("endOfGameResult"),
        F.when(bad == 10, F.lit(0)).otherwise(ms).alias("gameStartTimestamp"), ms.alias("gameCreation"), F.lit("EUW1").alias("platformId"), teams.alias("teams"),
        F.when(bad == 2, F.slice("participants", 1, 9)).otherwise(F.col("participants")).alias("participants"),
    )
    return rows.select("match_id", F.to_json(F.struct(info.alias("info"))).alias("payload"))


@query
def validate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.validated(payloads(spark, sf), 420, (16, 1)).select("match_id", "patch", "reject_reason")


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.validated(payloads(spark, sf), 420, (16, 1)).where("reject_reason IS NULL")


@query
def flatten_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.flat_matches(_valid(spark, sf)).select("match_id", "queue_id", "patch", "game_version", "game_start", "duration_s", F.col("winner").cast("int").alias("winner"), "winner_inferred")


@query
def flatten_participants(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.flat_participants(_valid(spark, sf)).select("match_id", "puuid", F.col("team_id").cast("int").alias("team_id"), "position", "champion_id", "win", "kills", "gold_earned", "cs", "dmg_champs", "turret_kills", F.col("team_pos_idx").cast("int").alias("team_pos_idx"))


@query
def extras_projection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ingest.flat_extras(_valid(spark, sf)).select("match_id", "puuid", "damage_per_minute", "solo_kills", "vision_per_min", "multikills", "first_blood", "dragon_takedowns"))


@query
def participant_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.participant_ids(_valid(spark, sf))


@query
def parse_patches(spark: SparkSession, sf: str) -> DataFrame:
    version = F.expr("CASE event_id % 4 WHEN 0 THEN '15.' || CAST(event_id % 24 AS STRING) || '.704' WHEN 1 THEN '15' WHEN 2 THEN '' ELSE '16.x.1' END")
    df = table(spark, sf, "events").select("event_id", parse_patch(version).alias("patch"))
    n = patch_number(F.col("patch"))
    return df.select("event_id", "patch", n["major"].alias("major"), n["minor"].alias("minor"))


@query
def parse_targets(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN 'https://stats.example' ELSE 'https://other.example' END || '/profile/EUW1/some+name%20' || event_type || '-t' || CAST(user_id AS STRING) || '/overview' WHEN 1 THEN ' Name ' || event_type || '#AB' || CAST(user_id % 1000 AS STRING) WHEN 2 THEN 'no target' ELSE 'name#toolongtag1' END")
    return table(spark, sf, "events").select("event_id", parse_target(text, "stats.example").alias("t"), anonymous_id(F.col("user_id"), F.col("event_id")).alias("anonymous")).select("event_id", "t.*", "anonymous")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """(match_id, game_start, y, p, p_b): the label and two scores of each contest from smoothed win rates."""
    df = contests(spark, sf).withColumns({"n": over("count(*)", X.P), "w": over("sum(win)", X.P)})
    df = df.withColumn("wr", smoothed(F.col("w"), F.col("n"), 0.5, 10))
    p = F.lit(0.5) + X.difference(F.avg, "wr")
    return df.groupBy("match_id").agg(F.first("game_start").alias("game_start"), F.first((F.col("winner") == 100).cast("int")).alias("y"), F.round(p, 6).alias("p"), F.lit(0.5).alias("p_b"), F.first("seq").alias("seq"))


@query
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return mlops.time_split(_scored(spark, sf)).select("match_id", "part")


@query
def metrics_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mlops.metrics(_scored(spark, sf)))


@query
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mlops.auc(table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") / 100000).alias("p"))))


@query
def calibration_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mlops.calibration(_scored(spark, sf)))


@query
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mlops.ece(_scored(spark, sf)))


@query
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return mlops.paired_bootstrap(_scored(spark, sf).select("y", F.col("p").alias("p_a"), "p_b"))


def _small_matrix(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    from tenfold.sources.tables import staged

    frame = staged(X.team_differences(X.player_features(X.with_roles(contests(spark, sf), post_game=True))).drop("seq"), "features")
    return mlops.time_split(frame), [f"d_{f}_mean" for f in PLAYER_FEATURES]


@query
def logistic_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _small_matrix(spark, sf)
    model = mlops.LinearModel.fit(mlops.augmented(rows.where("part = 'train'").drop("part")), names)
    got = model.predict(rows.where("part = 'test'"))
    return mlops.metrics(got.join(rows.select("match_id", F.col("blue_win").alias("y")), "match_id"))


@query
def boosted_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of twenty rounds of boosting on the test part."""
    rows, names = _small_matrix(spark, sf)
    model, _ = mlops.fit_boosted(mlops.augmented(rows.where("part = 'train'").drop("part")), names, rounds=20)
    return mlops.metrics(model.predict(rows.where("part = 'test'")).join(rows.select("match_id", F.col("blue_win").alias("y")), "match_id"))


@query
def explain_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _small_matrix(spark, sf)
    return mlops.LinearModel.fit(rows.where("part = 'train'"), names).explain(rows.where("part = 'test'"))


@query
def snapshot_champ_role(spark: SparkSession, sf: str) -> DataFrame:
    return predict.snapshot(contests(spark, sf))["champ_role"]


@query
def snapshot_duration(spark: SparkSession, sf: str) -> DataFrame:
    return predict.snapshot(contests(spark, sf))["champ_duration"]


@query
def snapshot_roles(spark: SparkSession, sf: str) -> DataFrame:
    return predict.snapshot(contests(spark, sf))["role_champ"]


@query
def snapshot_meta(spark: SparkSession, sf: str) -> DataFrame:
    return predict.snapshot(contests(spark, sf))["meta"]


@query
def eligibility(spark: SparkSession, sf: str) -> DataFrame:
    live = contests(spark, sf).groupBy("match_id", "match_seq").agg(F.count("*").alias("c"))
    s = F.col("match_seq")
    live = live.select("match_id", F.when(s % 5 == 0, "KR").otherwise("EUW1").alias("platform"), F.when(s % 7 == 0, 400).otherwise(420).alias("queue_id"), F.when(s % 9 == 0, F.lit(8)).otherwise(F.col("c")).alias("n_participants"), F.when(s % 11 == 0, F.col("c")).otherwise(F.lit(1)).alias("n_anonymous"))
    live = live.withColumns({"platform": F.when(F.col("match_id").endswith("2"), None).otherwise(F.lower("platform")), "queue_id": F.when(F.col("match_id").endswith("4"), None).otherwise(F.col("queue_id"))})
    return live.select("match_id", predict.ineligible_reason(["EUW1"]).alias("reason"))


@query
def predict_one(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf)
    live = df.where(F.col("seq") == F.col("n_seq") - 1)
    return rounded(predict.predict(live, df))


@query
def predict_from_state(spark: SparkSession, sf: str) -> DataFrame:
    """The row of predict_one from the stored state: folded from two parts of the earlier contests, saved, and read back for the live contest's players."""
    df = contests(spark, sf)
    before, live = df.where(F.col("seq") < F.col("n_seq") - 1), df.where(F.col("seq") == F.col("n_seq") - 1)
    folder = new_path(spark, "state")
    state.save(state.delta(before.where(F.col("seq") < F.floor(F.col("n_seq") / 2))), f"{folder}/half")
    state.save(state.fold(state.load(spark, f"{folder}/half"), before.where(F.col("seq") >= F.floor(F.col("n_seq") / 2))), f"{folder}/whole")
    return rounded(state.live_matrix(live, state.load(spark, f"{folder}/whole")))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return Q["feature_matrix"](spark, sf)


__all__ = ["Q", "asof_sums", "before", "epoch_seconds", "flagship"]
