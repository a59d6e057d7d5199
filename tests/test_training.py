"""Models, comparison and calibration by properties and numpy twins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenfold.plans import mlops, training


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        p = 1 / (1 + math.exp(-1.5 * a))
        rows.append((f"M{i:04}", i, f"16.{1 + i // 450}", int(rng.random() < p), a, None if i % 9 == 0 else b, rng.randint(0, 5), rng.randint(0, 5)))
    return spark.createDataFrame(rows, "match_id string, game_start int, patch string, blue_win int, d_a double, d_b double, blue_coverage int, red_coverage int").withColumn("game_start", F.timestamp_seconds("game_start"))


NAMES = ["d_a", "d_b"]


def test_logistic_against_numpy(frame):
    model = mlops.LinearModel.fit(frame, NAMES, c=1.0)
    rows = frame.orderBy("match_id").collect()
    x = np.array([[r.d_a, np.nan if r.d_b is None else r.d_b] for r in rows], float)
    for j, n in enumerate(NAMES):
        x[np.isnan(x[:, j]), j] = model.stats[n][0]
    x = (x - x.mean(0)) / x.std(0)
    y, w = np.array([r.blue_win for r in rows]), np.zeros(3)
    for _ in range(60):  # Newton steps on the penalised loss; the intercept has no penalty
        z = np.c_[x, np.ones(len(x))]
        p = 1 / (1 + np.exp(-z @ w))
        penalty = np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-4)
    got = {r.match_id: r.p for r in model.predict(frame).collect()}
    assert np.allclose([got[r.match_id] for r in rows], 1 / (1 + np.exp(-np.c_[x, np.ones(len(x))] @ w)), atol=1e-4)
    top = {(r.match_id, r["rank"]): (r.feature, r.effect, r.favours) for r in model.explain(frame, 2).collect()}
    for r, row in list(zip(rows, x, strict=True))[:50]:
        effects = sorted(zip(NAMES, row * w[:2], strict=True), key=lambda e: -abs(e[1]))
        assert [top[r.match_id, k][0] for k in (0, 1)] == [n for n, _ in effects]
        assert all(abs(top[r.match_id, k][1] - e) < 1e-3 and top[r.match_id, k][2] == ("blue" if e > 0 else "red") for k, (_, e) in enumerate(effects))


def test_bootstrap_bounds_and_moments(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.7), 0.7, 0.5) for _ in range(600)]
    got = mlops.paired_bootstrap(spark.createDataFrame(rows, "y int, p_a double, p_b double"), draws=1000).first()
    gains = np.array([-math.log(0.5) + (math.log(0.7) if y else math.log(0.3)) for y, _, _ in rows])
    assert abs(got.mean_gain - gains.mean()) < 1e-9 and got.ci_low < got.mean_gain < got.ci_high
    assert abs((got.ci_high - got.ci_low) / (2 * 1.96 * gains.std() / math.sqrt(len(gains))) - 1) < 0.15 and got.p_a_better > 0.99
    same = mlops.paired_bootstrap(spark.createDataFrame([(1, 0.6, 0.6)] * 50, "y int, p_a double, p_b double"), draws=100).first()
    assert same.mean_gain == 0 and same.ci_low == same.ci_high == 0 and same.p_a_better == 0


def test_calibrator_is_kept_only_if_it_helps(spark):
    rng = random.Random(4)
    ps = [rng.random() for _ in range(1200)]
    honest = spark.createDataFrame([(f"m{i}", int(rng.random() < 0.25 + p / 2), 0.25 + p / 2) for i, p in enumerate(ps)], "match_id string, y int, p double")
    boastful = spark.createDataFrame([(f"m{i}", int(rng.random() < 0.25 + p / 2), 0.01 + 0.98 * p) for i, p in enumerate(ps)], "match_id string, y int, p double")
    model, info = mlops.calibrator(boastful)
    assert model is not None and info["applied"] and info["val_log_loss_calibrated"] < info["val_log_loss_raw"]
    after = mlops.calibrated(boastful, model)
    assert mlops.ece(after).first()[0] < mlops.ece(boastful).first()[0] and after.where("p < 0.01 OR p > 0.99").count() == 0
    kept, info = mlops.calibrator(honest)
    assert (kept is not None) == (info["val_log_loss_calibrated"] < info["val_log_loss_raw"])
    assert mlops.calibrator(honest.limit(100)) == (None, {"applied": False, "reason": "val_too_small"}) and mlops.calibrated(honest, None) is honest


def test_model_selection():
    assert mlops.chosen(0.001) == "boosted" and mlops.chosen(0.0) == "logistic" and mlops.chosen(-0.1) == "logistic"


def test_training_as_a_whole(spark, frame, tmp_path):
    model, results = training.train(frame, NAMES, rounds=10)
    assert results["logistic"]["log_loss"] < results["baseline"]["log_loss"] and results["boosted"]["log_loss"] < results["baseline"]["log_loss"]
    assert abs(results["baseline"]["log_loss"] - math.log(2)) < 1e-9  # mirrored rows are half won
    assert model.name == mlops.chosen(results["boosted_vs_logistic"]["ci_low"]) and {r["part"] for r in results["split"]} == {"train", "val", "test"}
    assert abs(sum(results["top_features"].values()) - 1) < 1e-9 and next(iter(results["top_features"])) == "d_a"
    model.save(spark, f"file://{tmp_path}/model", results)
    again, loaded = training.Predictor.load(spark, f"file://{tmp_path}/model")
    one, two = ({r.match_id: r.p for r in m.predict(frame).collect()} for m in (model, again))
    assert one == two and all(0.01 <= p <= 0.99 for p in one.values()) and loaded["logistic"]["log_loss"] == results["logistic"]["log_loss"]
    boosted = training.Predictor("boosted", NAMES, None, mlops.fit_boosted(frame, NAMES, 3)[0])
    boosted.save(spark, f"file://{tmp_path}/boosted", {})
    assert training.Predictor.load(spark, f"file://{tmp_path}/boosted")[0].predict(frame).count() == frame.count()


def test_coverage_filter(frame):
    assert mlops.covered(frame, 0) is frame and mlops.covered(frame, 3).where("blue_coverage < 3 OR red_coverage < 3").count() == 0
    assert [r.blue_coverage for r in mlops.coverage_rows(frame, 4).collect()] == [0, 1, 2, 3]
    assert mlops.aligned(frame, ["d_b", "d_new"]).columns == ["match_id", "game_start", "patch", "blue_win", "d_b", "d_new"]
    assert mlops.feature_names(frame) == ["d_a", "d_b", "blue_coverage", "red_coverage"]


def test_medians_are_exact(spark):
    """Against numpy: odd and even counts, nulls, NaN, ties of most rows, extreme values, one value, none."""
    rng = random.Random(7)
    n = 3001
    cols = {
        "odd": [rng.gauss(0, 1) for _ in range(n)], "even": [rng.gauss(0, 1) if i else None for i in range(n)], "ties": [float(rng.choice([1, 1, 1, 2, 3])) for _ in range(n)],
        "halves": [float(i % 2) if i else None for i in range(n)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 307) for _ in range(n)], "nan": [float("nan") if i % 3 else float(i) for i in range(n)],
        "one": [5.0 if i == 7 else None for i in range(n)], "none": [None] * n, "int": [float(rng.randrange(10**9)) for _ in range(n)],
    }
    frame = spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} double" for c in cols)).repartition(3)
    for parts, few in ((1024, 1000), (16, 50)):
        got = mlops.medians(frame, list(cols), parts, few)
        for c, values in cols.items():
            kept = [v for v in values if v is not None and not math.isnan(v)]
            assert got[c] == (float(np.median(kept)) if kept else None), c
    assert mlops.medians(frame.limit(0), ["odd"]) == {"odd": None}
