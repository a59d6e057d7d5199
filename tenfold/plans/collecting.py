"""Registered queries on stored tables, collecting, and training steps; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.operators import features as X
from tenfold.operators import frontier, graph, history, ingest
from tenfold.operators.causal import over
from tenfold.schemas import TRAITS
from tenfold.sources.fixtures import contests, edges, states, table
from tenfold.sources.tables import gunzipped, gzipped, insert_new, new_path, payload_of, read_table, staged, unread_payloads

from . import catalog, mlops, predict
from .catalog import ID, Q, query, rounded

NOW = "2026-01-01"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# -- stored tables


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return staged(catalog._valid(spark, sf), "valid")


@query
def joined_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stored(spark, sf)
    extras = ingest.flat_extras(rows.where("match_id NOT LIKE '%3'"))
    got = history.joined_history(ingest.flat_matches(rows).drop("winner_inferred"), ingest.flat_participants(rows), extras)
    return rounded(got.select(*ID, "seq", "patch", "duration_s", "team_id", "win", "pos_idx", "champion_id", "damage_per_minute", "solo_kills"))


@query
def stored_inserts(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping batches appended to one table, and read back."""
    rows, folder = ingest.flat_participants(_stored(spark, sf)), new_path(spark, "store")
    first = insert_new(rows.where("match_id NOT LIKE '%5'"), folder, "participants", ID)
    second = insert_new(rows, folder, "participants", ID)
    again = insert_new(rows, folder, "participants", ID)
    got = read_table(spark, folder, "participants")
    return got.agg(F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"), F.sum("kills").alias("kills")).select("n", "matches", "kills", F.lit(first).cast("long").alias("first"), F.lit(second).cast("long").alias("second"), F.lit(again).cast("long").alias("again"))


@query
def unread(spark: SparkSession, sf: str) -> DataFrame:
    raw = catalog.payloads(spark, sf)
    return unread_payloads(raw, raw.where("match_id LIKE '%7' OR match_id LIKE '%8'")).select("match_id")


@query
def payload_lookup(spark: SparkSession, sf: str) -> DataFrame:
    got = ingest.parsed(payload_of(staged(catalog.payloads(spark, sf), "payloads"), "M_00000007"))
    return got.select("match_id", "info.queueId", F.size("info.participants").alias("n"))


@query
def gzip_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads through gzip blobs, of which some are cut off."""
    blobs = gzipped(catalog.payloads(spark, sf), "payload").withColumn("payload", F.when(F.col("match_id").endswith("9"), F.expr("substr(payload, 1, 20)")).otherwise(F.col("payload")))
    got = ingest.parsed(gunzipped(blobs, "payload"))
    return got.select("match_id", F.col("info.queueId").alias("queue_id"), F.when(F.col("info").isNotNull(), F.size("info.participants")).alias("n"))


# -- collecting


@query
def pending_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.pending_histogram(catalog._matches(spark, sf))


@query
def pending_covered(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.pending(catalog._matches(spark, sf), 5).select("match_id", "discovery_count")


@query
def next_by_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.next_pending(catalog._matches(spark, sf), None, 50).select("match_id", "discovery_count")


@query
def resolved_matches(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.resolved(states(spark, sf)).select("match_id", "state")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey AS STRING) END AS puuid", "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS tier", "'I' AS rank", "CAST(c_nationkey AS INT) AS leaguePoints", "CAST(c_custkey % 9 AS INT) AS wins", "CAST(c_custkey % 8 AS INT) AS losses")


@query
def added_players(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.players(_entries(spark, sf), "seed", _now()).select("puuid", "tier", "division", "lp", "source", "n_match_ids")


@query
def rank_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.rank_snapshots(_entries(spark, sf), "SOLO", _now()).drop("observed_at")


@query
def marked_processed(spark: SparkSession, sf: str) -> DataFrame:
    players = frontier.players(_entries(spark, sf), "seed", _now())
    done = players.where("lp < 5").select("puuid", F.col("lp").alias("n_match_ids"))
    return frontier.processed(players, done, _now()).select("puuid", "n_match_ids", F.col("processed_at").isNotNull().alias("done"))


@query
def extended_plan(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    plan = frontier.prioritised(frontier.set_plan(e.where("match_id % 4 = 0")), e, catalog._known(spark, sf))
    return frontier.extend_plan(plan, e.where("match_id % 3 = 0"))


@query
def migrated_matches(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.migrated(states(spark, sf).select("match_id", F.nullif("attempts", F.lit(3)).alias("attempts"))).select("match_id", "attempts", "discovery_count")


@query
def failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    failed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS match_id")
    rows = states(spark, sf).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    return frontier.failure_counts(frontier.after_failures(rows, failed, _now()), failed)


@query
def drained_states(spark: SparkSession, sf: str) -> DataFrame:
    """States after a batch in which some matches were not found and some requests failed."""
    seq = F.expr("cast(substr(match_id, 3) as int)")
    status = F.when(seq % 17 == 0, 404).when(seq % 19 == 0, 503).otherwise(200)
    got = ingest.answered(catalog.payloads(spark, sf).withColumn("status", status).withColumn("payload", F.when(F.col("status") == 200, F.when(seq % 23 == 0, F.lit("{broken")).otherwise(F.col("payload")))), 420, (16, 1))
    before = got.select("match_id", F.lit("pending").alias("state"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"), (seq % 4).alias("attempts"))
    return ingest.states_after(before, got, _now()).select("match_id", "state", "reason", "attempts", F.col("resolved_at").isNotNull().alias("done"))


@query
def post_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.post_counts(e, frontier.set_plan(e.where("match_id % 10 = 0")), e.select("puuid").distinct())


@query
def topup_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    got = graph.candidates(e, frontier.set_plan(e.where("match_id % 10 = 0")), frontier.resolved(states(spark, sf)), catalog._known(spark, sf))
    return got.select("match_id", F.size("who").alias("n"), F.array_join(F.transform("who", lambda x: x.cast("string")), ",").alias("who"))


@query
def fully_processed(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf)
    players = df.select("puuid").distinct().withColumn("processed_at", F.when(F.expr("cast(substr(puuid, 3) as int) % 16 <> 3"), _now()))
    return frontier.fully_processed(df.select(*ID), players)


@query
def players_history(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf)
    live = staged(df.where("seq = n_seq - 1"), "live")
    return history.history_of(df, live, live.first().match_id).select(*ID)


@query
def history_depth(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf)
    return history.depth(df.where("seq % 50 = 0"), df)


@query
def missing_history(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf)
    stored = df.where("seq % 3 = 0")
    depth = history.depth(stored, df)
    most = depth.agg(F.max("games")).first()[0] + 5
    return predict.missing_history(depth, df.select("puuid", "match_id", (F.col("n_seq") - F.col("seq")).alias("ord")), stored.select("match_id").distinct(), most)


@query
def live_names(spark: SparkSession, sf: str) -> DataFrame:
    """Players of live games and what is shown of them; every seventh is hidden."""
    p = F.struct(F.when(F.col("k7") != 0, F.col("puuid")).alias("puuid"), F.col("champion_id").alias("championId"), F.col("team_id").alias("teamId"), F.when(F.col("k7") % 2 == 0, F.concat(F.lit("n"), "puuid")).alias("riotId"), F.concat(F.lit("s"), "puuid").alias("summonerName"))
    games = contests(spark, sf).withColumn("k7", F.expr("cast(substr(puuid, 3) as int) % 7")).groupBy("match_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("puuid", p.alias("p")))), lambda x: x.p).alias("participants"))
    players = predict.live_players(games.select(F.col("match_seq").alias("game_id"), F.lit("euw1").alias("platform"), "participants"))
    return predict.with_names(players.select("match_id", "puuid", "team_id", "champion_id"), players)


# -- training


@query
def snapshot_role_traits(spark: SparkSession, sf: str) -> DataFrame:
    got = predict.snapshot(contests(spark, sf))["role_traits"]
    return rounded(got.select("pos_idx", *[f"{f}_{t}" for t in TRAITS for f in ("sum", "count")]))


@query
def snapshot_reloaded(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "snapshot")
    predict.save_snapshot(predict.snapshot(contests(spark, sf)), folder)
    return predict.load_snapshot(spark, folder)["champ_role"]


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    df = contests(spark, sf).withColumn("n", over("count(*)", X.P))
    side = lambda t: F.count_if((F.col("team_id") == t) & (F.col("n") >= 40))
    return df.groupBy("match_id").agg(side(100).alias("blue_coverage"), side(200).alias("red_coverage"))


@query
def filter_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return mlops.covered(_coverage(spark, sf), 3)


@query
def feature_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return mlops.save_features(_coverage(spark, sf), new_path(spark, "features"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    got = catalog._scored(spark, sf).withColumnRenamed("y", "blue_win")
    patches = contests(spark, sf).select("match_id", "patch").distinct()
    return mlops.time_split(got.join(patches, "match_id").select("match_id", "game_start", "patch", "blue_win", F.col("p").alias("d_p")))


@query
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mlops.split_summary(_parts(spark, sf)))


@query
def constant_baseline(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged(_parts(spark, sf), "parts")
    return rounded(mlops.constant_baseline(rows.where("part = 'train'"), rows.where("part = 'test'")))


@query
def augmented_train(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mlops.augmented(_parts(spark, sf).where("part = 'train'").drop("part")).select("match_id", "blue_win", "d_p"))


@query
def aligned_features(spark: SparkSession, sf: str) -> DataFrame:
    """A model's columns by name: one that is there, one that is not."""
    frame = _parts(spark, sf).drop("part")
    return rounded(mlops.aligned(frame, [*mlops.feature_names(frame), "d_other"]).drop("game_start"))


FIXED = mlops.LinearModel({"d_winrate_mean": (0.0, 0.01, 0.2), "d_games_mean": (0.0, 0.0, 10.0)}, [0.7, -0.4], 0.1)


@query
def predict_scored(spark: SparkSession, sf: str) -> DataFrame:
    """The last contest as a live one, scored by a model of fixed weights."""
    df = contests(spark, sf)
    return rounded(predict.predict(df.where("seq = n_seq - 1"), df, FIXED).select("match_id", "p"), 4)


@query
def explanation(spark: SparkSession, sf: str) -> DataFrame:
    """The two largest contributions of a model of fixed weights to each contest."""
    model = mlops.LinearModel({"d_p": (0.0, 0.01, 0.05), "blue_coverage": (0.0, 2.5, 1.5), "red_coverage": (0.0, 2.0, 2.0)}, [0.3, 0.2, -0.1], 0.0)
    frame = _parts(spark, sf).drop("part").join(_coverage(spark, sf), "match_id")
    return rounded(model.explain(frame, 2), 4)


__all__ = ["Q"]
