"""Training as a whole: baseline, two models, comparison, calibration, artefacts."""

from __future__ import annotations

import json

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.sources.tables import staged

from . import mlops
from .boosting import Boosted


class Predictor:
    """A chosen model with its calibrator."""

    def __init__(self, name: str, features: list[str], linear: mlops.LinearModel | None = None, boosted: Boosted | None = None, isotonic: IsotonicRegressionModel | None = None):
        self.name, self.features, self.linear, self.boosted, self.isotonic = name, features, linear, boosted, isotonic

    def raw(self, frame: DataFrame) -> DataFrame:
        if self.name == "logistic":
            return self.linear.predict(frame)
        return self.boosted.predict(frame)

    def predict(self, frame: DataFrame) -> DataFrame:
        """(match_id, p): calibrated and within [0.01, 0.99]."""
        return mlops.calibrated(self.raw(frame), self.isotonic).select("match_id", F.least(F.greatest("p", F.lit(0.01)), F.lit(0.99)).alias("p"))

    def save(self, spark: SparkSession, folder: str, results: dict) -> None:
        """The parts of the model, then the side file that names them and holds the results."""
        if self.linear:
            self.linear.save(spark, f"{folder}/linear")
        if self.boosted:
            self.boosted.save(spark, f"{folder}/boosted")
        if self.isotonic:
            self.isotonic.write().overwrite().save(f"{folder}/isotonic")
        side = {"model": self.name, "features": self.features, "linear": bool(self.linear), "boosted": bool(self.boosted), "isotonic": bool(self.isotonic), "results": results}
        spark.createDataFrame([(json.dumps(side, default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> tuple[Predictor, dict]:
        side = json.loads(spark.read.text(f"{folder}/meta").first()[0])
        linear = mlops.LinearModel.load(spark, f"{folder}/linear") if side["linear"] else None
        boosted = Boosted.load(spark, f"{folder}/boosted") if side["boosted"] else None
        isotonic = IsotonicRegressionModel.load(f"{folder}/isotonic") if side["isotonic"] else None
        return cls(side["model"], side["features"], linear, boosted, isotonic), side["results"]


def train(frame: DataFrame, names: list[str] | None = None, min_coverage: int = 0, rounds: int = 600, top: int = 15) -> tuple[Predictor, dict]:
    """The model and its results from a feature table: a logistic one unless boosting is surely better on the test part.

    Validation and test rows stay as they are; only training rows are mirrored.  The results hold one row
    of figures for each model, the comparison, the calibration and the top features by importance.
    """
    rows = staged(mlops.time_split(frame, min_coverage=min_coverage), "split")
    part = lambda p: rows.where(F.col("part") == p).drop("part")
    names = names or [c for c in mlops.feature_names(frame) if c != "part"]
    mirrored, label = mlops.augmented(part("train")), rows.select("match_id", F.col("blue_win").alias("y"))
    row = lambda df: df.first().asDict()
    results = {"split": [r.asDict() for r in mlops.split_summary(rows).collect()], "baseline": row(mlops.constant_baseline(mirrored, part("test")))}

    linear = mlops.LinearModel.fit(mirrored, names)
    model, importance = mlops.fit_boosted(mirrored, names, rounds)
    models = {"logistic": Predictor("logistic", names, linear), "boosted": Predictor("boosted", names, None, model)}
    scored = {k: staged(m.raw(part("test")).join(label, "match_id"), f"scores-{k}") for k, m in models.items()}
    results |= {k: row(mlops.metrics(s)) for k, s in scored.items()}
    both = scored["boosted"].select("match_id", "y", F.col("p").alias("p_a")).join(scored["logistic"].select("match_id", F.col("p").alias("p_b")), "match_id")
    results["boosted_vs_logistic"] = versus = row(mlops.paired_bootstrap(both))
    results["top_features"] = dict(sorted(importance.items(), key=lambda x: -x[1])[:top])

    best = models[mlops.chosen(versus["ci_low"])]
    best.isotonic, results["calibration"] = mlops.calibrator(best.raw(part("val")).join(label, "match_id"))
    before, after = scored[best.name], mlops.calibrated(scored[best.name], best.isotonic)
    results |= {"calibrated": row(mlops.metrics(after)), "ece_before": mlops.ece(before).first()[0], "ece_after": mlops.ece(after).first()[0], "calibration_table": [r.asDict() for r in mlops.calibration(after).orderBy("bin").collect()]}
    return best, results
