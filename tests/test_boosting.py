"""Boosting over Spark against a plain program that holds all rows in one array."""

import math
import random

import numpy as np
import pytest

from tenfold.plans import boosting
from tenfold.plans.boosting import Boosted, Settings

NAMES = ["a", "b", "c", "d", "empty"]


@pytest.fixture(scope="module")
def rows():
    """Missing values that tell something, a column of few values, one of nulls only, ties."""
    rng = random.Random(11)
    out = []
    for i in range(1500):
        a, b, c, d = rng.gauss(0, 1), rng.random(), float(rng.randrange(4)), rng.gauss(0, 1)
        z = 1.5 * a - (2 if b > 0.7 else 0) + (1 if c == 2 else 0)
        missing = rng.random() < 0.2
        y = int(rng.random() < 1 / (1 + math.exp(-z - (1.5 if missing else 0))))
        out.append((f"m{i}", None if missing else a, b, c, None if rng.random() < 0.1 else d, None, y))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "match_id string, a double, b double, c double, d double, empty double, blue_win int").repartition(3)


def plain(bins, y, hashes, s):
    """Trees by the best leaf first, one split after another, each from all rows; and the margins."""
    mean = y.mean()
    margin, trees = np.full(len(y), math.log(mean / (1 - mean))), []
    t = lambda g: math.copysign(max(abs(g) - s.l1, 0), g)
    for number in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, bag = p - y, p * (1 - p), boosting.in_bag(hashes, s.seed, number, s.row_share)
        columns = boosting.columns_of(bins.shape[1], s, number)

        def cut(mask):
            best = (0.0, None)
            for c in columns:
                b = bins[:, c]
                for missing_left in (False, True) if (mask & (b == 0)).any() else (False,):
                    for at in range(1, 256):
                        left = mask & np.where(b == 0, missing_left, b <= at)  # noqa: B023
                        right = mask & ~left
                        if min(left.sum(), right.sum()) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_hessian:
                            continue
                        gain = sum(sign * t(g[x].sum()) ** 2 / (h[x].sum() + s.l2) for sign, x in ((1, left), (1, right), (-1, mask)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (c, at, missing_left))
            return best

        leaves, cuts = {0: bag}, {}
        found = {0: cut(bag)}
        while len(leaves) < s.leaves:
            node = max(leaves, key=lambda x: (found[x][0], -x))
            if found[node][1] is None:
                break
            c, at, missing_left = cuts[node] = found[node][1]
            mask = leaves.pop(node)
            left = np.where(bins[:, c] == 0, missing_left, bins[:, c] <= at)
            for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
                leaves[child] = mask & side
                found[child] = cut(leaves[child])
        values = {k: -s.rate * t(g[m].sum()) / (h[m].sum() + s.l2) for k, m in leaves.items()}
        tree = boosting.Tree(cuts, values)
        trees.append(tree)
        margin = margin + tree.scores(bins)
    return trees, margin


def test_trees_equal_a_plain_program(spark, frame, rows, monkeypatch):
    monkeypatch.setattr(boosting, "EVERY", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    monkeypatch.setattr(boosting, "TASK_ROWS", 500)
    monkeypatch.setattr(boosting, "quantile_edges", lambda train, names: [[-1.5, -0.5, 0.0, 0.3, 0.9, 2.0], [0.1 * k for k in range(1, 10)], [0.0, 1.0, 2.0], [-1.0, 0.0, 1.0], []])
    s = Settings(rounds=5, rate=0.3, leaves=6, least_rows=25)
    got = Boosted.fit(frame, NAMES, settings=s)
    values = np.array([[np.nan if v is None else v for v in r[1:6]] for r in rows], float)
    hashes = {r.match_id: r.h for r in frame.selectExpr("match_id", "xxhash64(match_id) AS h").collect()}
    bins = boosting.binned(values, got.edges)
    want, margin = plain(bins, np.array([r[6] for r in rows], float), np.array([hashes[r[0]] for r in rows], np.int64), s)
    for a, b in zip(got.trees, want, strict=True):
        assert a.cuts == b.cuts and a.values.keys() == b.values.keys() and all(abs(a.values[k] - b.values[k]) < 1e-9 for k in a.values)
    assert any(missing_left for t in got.trees for _, _, missing_left in t.cuts.values()) and max(len(t.values) for t in got.trees) == 6
    p = {r.match_id: r.p for r in got.predict(frame).collect()}
    assert all(abs(p[r[0]] - 1 / (1 + math.exp(-m))) < 1e-9 for r, m in zip(rows, margin, strict=True))
    # columns by name: another order, one absent
    other = frame.select("match_id", "c", "b", "a", "d")
    assert {r.match_id: round(r.p, 9) for r in got.predict(other).collect()} == {k: round(v, 9) for k, v in p.items()}


def test_quantile_edges_and_bins(spark):
    d = spark.createDataFrame([(f"m{i}", float(i % 1000), None if i % 3 else 1.0, None) for i in range(5000)], "match_id string, a double, b double, c double")
    edges = boosting.quantile_edges(d, ["a", "b", "c"])
    assert 240 <= len(edges[0]) <= 254 and edges[1] == [1.0] and edges[2] == []
    got = boosting.binned(np.array([[np.nan, 1.0, np.nan], [-5.0, 0.5, 3.0], [1e9, 2.0, np.nan]]), edges)
    assert got[:, 0].tolist() == [0, 1, len(edges[0]) + 1] and got[:, 1].tolist() == [1, 1, 2] and got[:, 2].tolist() == [0, 1, 0]


def test_boosting_learns_and_is_stored(spark, frame, tmp_path):
    model = Boosted.fit(frame, NAMES, settings=Settings(rounds=30, rate=0.1, least_rows=40))
    loss = lambda rows: -sum(math.log(r.p if r.blue_win else 1 - r.p) for r in rows) / len(rows)
    rows = model.predict(frame).join(frame, "match_id").collect()
    mean = sum(r.blue_win for r in rows) / len(rows)
    assert loss(rows) < 0.85 * -(mean * math.log(mean) + (1 - mean) * math.log(1 - mean))
    share = model.importance()
    assert abs(sum(share.values()) - 1) < 1e-9 and max(share, key=share.get) == "a" and share["empty"] == 0
    model.save(spark, f"file://{tmp_path}/m")
    again = Boosted.load(spark, f"file://{tmp_path}/m")
    assert {r.match_id: r.p for r in again.predict(frame).collect()} == {r.match_id: r.p for r in rows}


def test_one_class_and_few_rows(spark, frame):
    none = Boosted.fit(frame.limit(10), NAMES, settings=Settings(rounds=2))
    assert all(t.cuts == {} for t in none.trees) and none.predict(frame.limit(3)).count() == 3
    won = Boosted.fit(frame.where("blue_win = 1"), NAMES, settings=Settings(rounds=2))
    assert won.predict(frame).where("p < 0.99").count() == 0
