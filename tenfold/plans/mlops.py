"""Split, fit, evaluate, calibrate, compare, explain."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenfold.operators.features import side_swapped
from tenfold.sources.tables import ordinal

from .boosting import Boosted, Settings

META = ["match_id", "game_start", "patch", "blue_win"]
EPS = 1e-15


def feature_names(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in META]


def aligned(frame: DataFrame, names: list[str]) -> DataFrame:
    """The model's columns by name; absent ones are null."""
    return frame.select(*[c for c in META if c in frame.columns], *[F.col(c).cast("double") if c in frame.columns else F.lit(None).cast("double").alias(c) for c in names])


def covered(frame: DataFrame, least: int) -> DataFrame:
    return frame if least <= 0 else frame.where((F.col("blue_coverage") >= least) & (F.col("red_coverage") >= least))


def time_split(frame: DataFrame, test: float = 0.2, val: float = 0.1, min_coverage: int = 0) -> DataFrame:
    """Adds part: train, val, test by place in time (ties by match_id)."""
    rows = ordinal(covered(frame, min_coverage), ["game_start", "match_id"], "_i")
    n = rows.count()
    n_test, n_val = max(1, int(n * test)), max(1, int(n * val))
    if n < 50 or n - n_test - n_val < 20:
        raise ValueError(f"{n} rows are too few to split")
    part = F.when(F.col("_i") < n - n_test - n_val, "train").when(F.col("_i") < n - n_test, "val").otherwise("test")
    return rows.withColumn("part", part).drop("_i")


def split_summary(rows: DataFrame, label: str = "blue_win") -> DataFrame:
    """(part, n, first_start, last_start, label_rate, patches) of rows with part; patches are the different ones, sorted and joined by commas."""
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min("game_start").alias("first_start"), F.max("game_start").alias("last_start"), F.avg(F.col(label).cast("double")).alias("label_rate"), F.array_join(F.array_sort(F.collect_set("patch")), ",").alias("patches"))


def coverage_rows(frame: DataFrame, most: int = 12) -> DataFrame:
    """(blue_coverage, n): rows of the feature table at each coverage, the lowest first."""
    return frame.groupBy("blue_coverage").agg(F.count("*").alias("n")).orderBy("blue_coverage").limit(most)


def save_features(frame: DataFrame, path: str) -> DataFrame:
    """Write the feature table; returns its coverage_rows."""
    frame.write.mode("overwrite").parquet(path)
    return coverage_rows(frame.sparkSession.read.parquet(path))


def constant_baseline(train: DataFrame, test: DataFrame, label: str = "blue_win") -> DataFrame:
    """The metrics on test of the mean label of train as the score of all rows."""
    mean = train.agg(F.avg(F.col(label).cast("double")).alias("p"))
    return metrics(test.select(F.col(label).alias("y")).crossJoin(F.broadcast(mean)))  # one row


def augmented(train: DataFrame) -> DataFrame:
    return side_swapped(train)


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def loss(y: Column, p: Column) -> Column:
    return -(y * F.ln(clipped(p)) + (1 - y) * F.ln(1 - clipped(p)))


def metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(n, log_loss, brier, accuracy, auc); auc by mid ranks from counts of equal scores, null for one class."""
    y_, p_ = F.col(y), F.col(p)
    basic = df.agg(F.count("*").alias("n"), F.avg(loss(y_, p_)).alias("log_loss"), F.avg((p_ - y_) ** 2).alias("brier"), F.avg(((p_ >= 0.5).cast("int") == y_).cast("double")).alias("accuracy"))
    return basic.crossJoin(auc(df, y, p))


def auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row. The different scores are summed first; the ranks are running sums over blocks of scores."""
    tied = df.groupBy(F.col(p).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    at = tied.withColumn("b", F.floor(F.col("s") * 1024))
    blocks = at.groupBy("b").agg(F.sum("n").alias("bn"))
    before = F.coalesce(F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("b", before.alias("o"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = at.withColumn("i", inside).join(offsets, "b").withColumn("rank", F.col("o") + F.col("i") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("pos"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("neg"))
    return sums.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc"))


def calibration(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """(bin, n, predicted, actual, gap); bins without rows are left out."""
    number = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("actual")).withColumn("gap", F.col("actual") - F.col("predicted"))


def ece(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    return calibration(df, bins, y, p).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def paired_bootstrap(df: DataFrame, draws: int = 2000, seed: int = 0, y: str = "y", a: str = "p_a", b: str = "p_b") -> DataFrame:
    """(mean_gain, ci_low, ci_high, p_a_better): A's lower loss, resampled.

    A draw of n rows is a vector of Poisson counts, kept as partial sums of each partition,
    so no row leaves its task and every draw sees all rows.
    """
    gains = df.select((loss(F.col(y), F.col(b)) - loss(F.col(y), F.col(a))).alias("g"), F.xxhash64(y, a, b).alias("h"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(draws), np.zeros(draws)
        for pdf in batches:
            for low in range(0, len(pdf), 512):
                part = pdf.iloc[low : low + 512]
                rng = np.random.default_rng([seed, int(part.h.sum()) & 0xFFFFFFFFFFFFFFFF, low, len(part)])
                k = rng.poisson(1.0, (draws, len(part)))
                total += k @ part.g.to_numpy()
                weight += k.sum(1)
        yield pd.DataFrame({"draw": np.arange(draws), "g": total, "n": weight})

    means = gains.mapInPandas(sums, "draw int, g double, n double").groupBy("draw").agg((F.sum("g") / F.greatest(F.sum("n"), F.lit(1.0))).alias("m"))
    edges = means.agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"), F.avg((F.col("m") > 0).cast("double")).alias("p_a_better"))
    return gains.agg(F.avg("g").alias("mean_gain")).crossJoin(edges)


def medians(frame: DataFrame, names: list[str], parts: int = 1024, few: int = 1000) -> dict[str, float | None]:
    """The exact median of each column, nulls and NaN left out; of an even number of values the mean of the middle two. None if there is no value.

    All columns at once, by selection: the range of each is cut into ``parts``, the part with the
    wanted rank is taken with the least and greatest value in it, and so on until it holds one
    value or a ``few``, which are then looked at.  Nothing is sorted as a whole; the driver sees
    ``parts`` counts a column and pass.
    """
    spark = frame.sparkSession
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    each = frame.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(c).alias("x")) for i, c in enumerate(names)])).alias("e")).select("e.*").where("x IS NOT NULL")
    whole = each.groupBy("i").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    found: dict[tuple[int, int], float] = {}
    # (column, rank): (least value, greatest value, values, values before them)
    open_ = {(r.i, k): (r.low, r.high, r.n, 0) for r in whole for k in {(r.n - 1) // 2, r.n // 2}}
    while open_:
        found |= {key: low for key, (low, high, *_) in open_.items() if low == high}
        open_ = {key: v for key, v in open_.items() if key not in found}
        last = {key: v for key, v in open_.items() if v[2] <= few}
        if not open_:
            break
        ranges = spark.createDataFrame([(i, k, float(v[0]), float(v[1])) for (i, k), v in open_.items()], "i int, k long, low double, high double")
        inside = each.join(F.broadcast(ranges), "i").where("x BETWEEN low AND high")  # two ranges a column at most
        if len(last) == len(open_):
            for r in inside.groupBy("i", "k").agg(F.sort_array(F.collect_list("x")).alias("v")).collect():
                found[r.i, r.k] = r.v[r.k - open_[r.i, r.k][3]]
            break
        # halves first, as the difference of two doubles may overflow
        part = F.least(F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * parts), F.lit(parts - 1))
        counted = inside.groupBy("i", "k", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        ahead = {key: v[3] for key, v in open_.items()}
        for r in sorted(counted, key=lambda r: (r.i, r.k, r.part)):
            key = (r.i, r.k)
            if ahead[key] <= r.k < ahead[key] + r.n:
                open_[key] = (r.low, r.high, r.n, ahead[key])
            ahead[key] += r.n
    size = {r.i: r.n for r in whole}
    return {c: (found[i, (size[i] - 1) // 2] / 2 + found[i, size[i] // 2] / 2) if i in size else None for i, c in enumerate(names)}


def moments(train: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean, population deviation) by name after the median is put in for nulls; a column of nulls is constant 0."""
    med = medians(train, names)
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(med[c] or 0.0))) for c in names]
    got = train.agg(*[f(x).alias(f"{t}{i}") for i, x in enumerate(filled) for t, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (float(med[c] or 0.0), float(got[f"m{i}"]), float(got[f"s{i}"]) or 1.0) for i, c in enumerate(names)}


def standardised(frame: DataFrame, stats: dict[str, tuple[float, float, float]]) -> DataFrame:
    return frame.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(mu)) / F.lit(sd) for c, (m, mu, sd) in stats.items()})


class LinearModel:
    """Median impute, standardise, L2 logistic; columns are carried by name."""

    def __init__(self, stats: dict, coefficients: list[float], intercept: float):
        self.stats, self.coefficients, self.intercept = stats, coefficients, intercept

    @property
    def names(self) -> list[str]:
        return list(self.stats)

    @classmethod
    def fit(cls, train: DataFrame, names: list[str], c: float = 1.0, label: str = "blue_win") -> LinearModel:
        stats = moments(train, names)
        rows = VectorAssembler(inputCols=names, outputCol="x").transform(standardised(train, stats).withColumn("y", F.col(label).cast("double"))).select("x", "y").cache()
        try:
            m = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (c * rows.count()), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=2000).fit(rows)
        finally:
            rows.unpersist()
        return cls(stats, [float(v) for v in m.coefficients], float(m.intercept))

    def contributions(self, frame: DataFrame) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("feature"), (F.col(n) * F.lit(w)).alias("effect")) for n, w in zip(self.names, self.coefficients, strict=True)])

    def predict(self, frame: DataFrame) -> DataFrame:
        """Adds p."""
        z = standardised(aligned(frame, self.names), self.stats)
        score = sum((F.col(n) * F.lit(w) for n, w in zip(self.names, self.coefficients, strict=True)), F.lit(self.intercept))
        return z.withColumn("p", 1 / (1 + F.exp(-score))).select("match_id", "p")

    def explain(self, frame: DataFrame, top: int = 6) -> DataFrame:
        """(match_id, rank, feature, effect, favours): the largest contributions, not rounded."""
        z = standardised(aligned(frame, self.names), self.stats).select("match_id", self.contributions(frame).alias("c"))
        best = F.slice(F.sort_array(F.transform("c", lambda x: F.struct(F.abs(x.effect).alias("size"), x.feature.alias("feature"), x.effect.alias("effect"))), asc=False), 1, top)
        return z.select("match_id", F.posexplode(best).alias("rank", "x")).select("match_id", "rank", "x.feature", "x.effect", F.when(F.col("x.effect") > 0, "blue").otherwise("red").alias("favours"))

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(json.dumps({"stats": self.stats, "coefficients": self.coefficients, "intercept": self.intercept}),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> LinearModel:
        d = json.loads(spark.read.text(path).first()[0])
        return cls({k: tuple(v) for k, v in d["stats"].items()}, d["coefficients"], d["intercept"])


def fit_boosted(train: DataFrame, names: list[str], rounds: int = 600, label: str = "blue_win", seed: int = 0) -> tuple[Boosted, dict[str, float]]:
    """Boosted trees with at least 40 rows, or one in 200, in a leaf; and each column's importance."""
    model = Boosted.fit(train, names, label, Settings(rounds=rounds, least_rows=max(40, train.count() // 200), seed=seed))
    return model, model.importance()


def _bounded(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))


def calibrator(df: DataFrame, folds: int = 4, least: int = 200) -> tuple[IsotonicRegressionModel | None, dict]:
    """An isotonic model of (match_id, y, p) if it lowers the cross-validated log loss, else None; and what decided. Folds go by a hash of the id."""
    if df.count() < least:
        return None, {"applied": False, "reason": "val_too_small"}
    fold, rows = F.pmod(F.xxhash64("match_id"), F.lit(folds)), df.withColumn("y", F.col("y").cast("double"))
    fit = lambda x: IsotonicRegression(featuresCol="p", labelCol="y").fit(x)
    parts = [fit(rows.where(fold != k)).transform(rows.where(fold == k)) for k in range(folds)]
    joined = parts[0]
    for x in parts[1:]:
        joined = joined.unionByName(x)
    got = joined.agg(F.avg(loss(F.col("y"), F.col("p"))).alias("raw"), F.avg(loss(F.col("y"), _bounded(F.col("prediction")))).alias("fitted")).first()
    better = got.fitted < got.raw
    return fit(rows) if better else None, {"applied": better, "val_log_loss_raw": got.raw, "val_log_loss_calibrated": got.fitted}


def calibrated(scored: DataFrame, model: IsotonicRegressionModel | None) -> DataFrame:
    """p by the calibrator if there is one; other columns stay."""
    if model is None:
        return scored
    return model.transform(scored).withColumn("p", _bounded(F.col("prediction"))).drop("prediction")


def chosen(ci_low: float) -> str:
    """Boosting only if it is better for sure."""
    return "boosted" if ci_low > 0 else "logistic"
