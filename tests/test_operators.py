"""Properties and small cases of the contest operators."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tenfold.functions.scalars import parse_limits
from tenfold.operators import causal, frontier, graph, ingest
from tenfold.operators import features as X
from tenfold.plans import catalog, mlops, predict
from tenfold.sources import tables
from tenfold.sources.fixtures import contests

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return contests(spark, SF).where("seq < 30")


def test_prior_sums_blocks_agree(rows):
    one = causal.prior_sums(rows, ["champion_id"], {"n": "1", "w": "win"}).select("match_id", "puuid", "n", "w")
    many = causal.prior_sums(rows, ["champion_id"], {"n": "1", "w": "win"}, block=3).select("match_id", "puuid", "n", "w")
    assert sorted(one.collect()) == sorted(many.collect())


def test_running_mean_blocks_agree(rows):
    order = ["seq", "team_id", "pos_idx", "puuid"]
    one, many = (causal.running_mean(rows, "pos_idx", order, ["solo_kills"], b).select("match_id", "puuid", F.round("solo_kills_mean", 9).alias("m")).collect() for b in (1000, 4))
    assert sorted(one, key=str) == sorted(many, key=str)


def test_later_contests_change_nothing(rows):
    early = X.team_differences(X.player_features(X.with_roles(rows.where("seq < 20"), True)))
    late = X.team_differences(X.player_features(X.with_roles(rows, True))).where("seq < 20")
    assert sorted(early.collect(), key=str) == sorted(late.collect(), key=str)


def test_roles_are_permutations(rows):
    got = X.assigned_roles(rows).join(rows.select("match_id", "puuid", "team_id"), ["match_id", "puuid"]).groupBy("match_id", "team_id").agg(F.sort_array(F.collect_list("role")).alias("r"))
    assert {tuple(r.r) for r in got.collect()} == {(0, 1, 2, 3, 4)}


def test_side_swap_is_its_own_inverse(spark):
    frame = spark.createDataFrame([("a", 1, 2.0, -3.0, 4, 5)], "match_id string, blue_win int, d_x double, x_y double, blue_coverage int, red_coverage int")
    assert X.side_swapped(frame).where("match_id = 'a_swap'").first()[1:] == (0, -2.0, 3.0, 5, 4)


def test_insert_new_twice_adds_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 3)], "match_id string, ord int")
    folder = f"file://{tmp_path}"
    assert tables.insert_new(batch.where("match_id IS NOT NULL"), folder, "x", ["match_id"], ["ord"]) == 2
    assert tables.insert_new(batch.where("match_id IS NOT NULL"), folder, "x", ["match_id"], ["ord"]) == 0
    assert sorted(map(tuple, tables.read_table(spark, folder, "x", batch.schema).collect())) == [("a", 1), ("b", 1)]


def test_ordinal_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert tables.ordinal(df, ["k"], "i", one_task=10).where("i <> k").count() == 0


def test_k_core_needs_many_rounds_or_vanishes(spark):
    chain = spark.createDataFrame([(m, p) for m in range(12) for p in (m, m + 1)], "match_id long, puuid long")
    assert graph.k_core(chain, 2, 2).count() == 0
    square = spark.createDataFrame([(m, p) for m in range(3) for p in range(3)], "match_id long, puuid long")
    assert graph.k_core(chain.withColumn("match_id", F.col("match_id") + 10).union(square), 3, 3).count() == 9


def test_reject_order_and_corrupt(spark):
    raw = spark.createDataFrame([("bad", "{no json"), ("none", None), ("empty", '{"info": {}}')], "match_id string, payload string")
    got = {r.match_id: r.reject_reason for r in ingest.validated(raw).collect()}
    assert got == {"bad": "corrupt", "none": "corrupt", "empty": "queue=None"}


def test_order_of_reasons(spark):
    """A payload that fails every rule; each is put right in turn, and the next one shows."""
    person = lambda i, position: {"puuid": f"p{i}", "teamId": 100 + 100 * (i // 5), "teamPosition": position}
    info = {"queueId": 400, "gameDuration": 300, "gameVersion": "15.1.1", "endOfGameResult": "Abort", "participants": [person(i, "") for i in range(9)]}
    rows, want = [], []
    roles = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]
    steps = [("queue=400", {}), ("participants=9", {"queueId": 420}), ("too_short", {"participants": [person(i, "") for i in range(10)]}), ("Abort", {"gameDuration": 900}), ("patch=15.1", {"endOfGameResult": "GameComplete"}), ("missing_position", {"gameVersion": "16.1.1"}), ("duplicate_position", {"participants": [person(i, "TOP") for i in range(10)]}), (None, {"participants": [person(i, roles[i % 5]) for i in range(10)]})]
    for k, (reason, change) in enumerate(steps):
        info = info | change
        rows.append((f"m{k}", json.dumps({"info": info})))
        want.append(reason)
    got = {r.match_id: r.reject_reason for r in ingest.validated(spark.createDataFrame(rows, "match_id string, payload string"), 420, (16, 1)).collect()}
    assert [got[f"m{k}"] for k in range(len(want))] == want


def test_gunzip(spark):
    df = spark.createDataFrame([(gzip.compress(b"{}"),), (b"junk",), (None,)], "payload binary")
    assert [r[0] for r in tables.gunzipped(df, "payload").collect()] == ["{}", None, None]


def test_landing_source(spark, tmp_path):
    (tmp_path / "M_1.json").write_text("{}")
    (tmp_path / "M_2.json.gz").write_bytes(gzip.compress(b'{"a": 1}'))
    spark.dataSource.register(tables.Landing)
    assert sorted(map(tuple, spark.read.format("landing").option("path", str(tmp_path)).load().collect())) == [("M_1", "{}"), ("M_2", '{"a": 1}')]


def test_metrics_of_one_class(spark):
    got = mlops.metrics(spark.createDataFrame([(1, 0.5), (1, 1.0)], "y int, p double")).first()
    assert got.auc is None and got.accuracy == 1.0


def test_bootstrap_tells_the_better(spark):
    rng = random.Random(1)
    rows = [(y, 0.5 + (0.2 if y else -0.2) * (0.5 + rng.random() / 2), 0.5) for y in (rng.randint(0, 1) for _ in range(300))]
    got = mlops.paired_bootstrap(spark.createDataFrame(rows, "y int, p_a double, p_b double"), draws=200).first()
    assert got.ci_low > 0 and got.p_a_better == 1.0 and got.ci_low < got.mean_gain < got.ci_high + 1e-9


def test_linear_model_round_trip(spark, tmp_path):
    rng = random.Random(2)
    data = [(f"m{i}", i % 2, rng.gauss(i % 2, 1.0), None) for i in range(200)]
    frame = spark.createDataFrame(data, "match_id string, blue_win int, d_a double, d_b double")
    model = mlops.LinearModel.fit(frame, ["d_a", "d_b"])
    model.save(spark, f"file://{tmp_path}/model")
    again = mlops.LinearModel.load(spark, f"file://{tmp_path}/model")
    assert again.coefficients == model.coefficients and model.coefficients[0] > 0 and model.coefficients[1] == 0
    assert model.explain(frame.limit(3), top=1).where("feature = 'd_a'").count() == 3


def test_retry_counts(spark):
    rows = spark.createDataFrame([("a", "pending", 3, None), ("b", "pending", 0, None)], "match_id string, state string, attempts int, resolved_at timestamp_ntz")
    failed = rows.select("match_id")
    after = frontier.after_failures(rows, failed, F.lit("2026-01-01").cast("timestamp_ntz"))
    assert tuple(frontier.failure_counts(after, failed).first()) == (1, 1)


def test_predict_is_pure(rows):
    live = rows.where("seq = 29")
    one = catalog.rounded(predict.predict(live, rows)).collect()
    assert one == catalog.rounded(predict.predict(live, rows)).collect() and len(one) == 1


def test_condensed_writes_give_the_same_sums(rows):
    writes = rows.withColumn("champion_id", F.when(F.col("champion_id") != 3, F.col("champion_id")))
    reads = writes.where("seq IN (0, 13, 14, 29)").select("champion_id", "seq", "match_id", "puuid")
    few = causal.condensed(writes, reads, ["champion_id", "pos_idx"], {"n": "1", "w": "win"}, block=5)
    assert few.where("seq % 5 > 0").select("seq").distinct().count() == 12 and few.where("seq = 5").agg(F.sum("n")).first()[0] == 50
    want = causal.asof_sums(writes, reads, ["champion_id"], {"n": "1", "w": "win"}, block=5)
    assert sorted(causal.asof_sums(few, reads, ["champion_id"], {"n": "n", "w": "w"}, block=5).collect(), key=str) == sorted(want.collect(), key=str)


def test_live_rows_are_those_of_the_matrix(rows):
    """Contests between others, of which one comes after another, and champions and traits that are not known."""
    odd = tables.staged(rows.withColumns({"champion_id": F.when(F.col("champion_id") % 4 > 0, F.col("champion_id")), "solo_kills": F.when(F.col("seq") > 9, F.col("solo_kills"))}), "odd")
    live = odd.where("seq IN (0, 14, 15, 27)")
    want = catalog.rounded(X.feature_matrix(odd, 2)).join(live.select("match_id").distinct(), "match_id", "left_semi")
    got = catalog.rounded(predict.predict(live, odd, min_history=2))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 4


def _shuffled(spark):
    """Rows that each stage has written for a shuffle, by the stage's number."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {x.stageId(): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}


def test_serving_moves_its_own_rows_only(spark, monkeypatch):
    """No table that is written holds the history, and no shuffle but that of the traits."""
    written, history = [], contests(spark, SF)

    def counted(df, name):
        out = tables.staged(df, name)
        written.append(out.count())
        return out

    for module in (X, predict):
        monkeypatch.setattr(module, "staged", counted, raising=False)
    n, before = history.count(), _shuffled(spark)
    predict.predict(history.where("seq = 99"), history).collect()
    moved = sorted(rows for stage, rows in _shuffled(spark).items() if stage not in before)
    assert n == 1000 and max(written) < n / 2 and moved[-1] == n and moved[-2] < n / 2


def test_limits():
    assert parse_limits("20:1,100:120") == [(20, 1), (100, 120)]


def test_streaming_twin(spark, rows, tmp_path):
    from tenfold.streaming.prior import prior_form

    source = f"{tmp_path}/in"
    rows.select("match_id", "puuid", "seq", "win").write.parquet(source)
    stream = spark.readStream.schema("match_id string, puuid string, seq long, win int").parquet(source)
    q = prior_form(stream).writeStream.format("memory").queryName("twin").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = rows.select("match_id", "puuid", causal.over("count(*)", X.P).alias("games"), causal.over("sum(win)", X.P).alias("wins"))
    assert sorted(map(tuple, spark.sql("SELECT match_id, puuid, games, wins FROM twin").collect())) == sorted(map(tuple, want.collect()))
