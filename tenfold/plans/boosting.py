"""Boosted trees by histograms.

Training rows become blocks of binned columns, each block one row of a written table, with
labels and scores beside.  For a batch of tree nodes each task sums gradients, hessians and
rows by node, column and bin over its blocks; the sums of all tasks meet by node and column,
where the best cut is found, so that only one line for each node and column reaches the
driver.  Trees grow by the best leaf first; nodes that may be wanted next are looked at in
the same pass.  Trees are small and go out with the tasks: no round joins anything, and
scores are written anew once in a number of rounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.sources.tables import staged

#: Bins of a column, the first for missing values; rows of a block; rounds after which scores are written; columns whose histograms meet in one group, some 100 kB of each task; rows from which a task is worth its start.
BINS, BLOCK_ROWS, EVERY, TOGETHER, TASK_ROWS = 256, 8192, 25, 16, 1 << 16
BLOCK = "rows long, bins binary, y binary, margin binary, hash binary"
CUT = "node long, feature int, gain double, cut int, missing_left boolean, g double, h double, n double, gl double, hl double, nl double"


@dataclass(frozen=True)
class Settings:
    """The regularisation of the boosted model; the defaults are fixed values of the training recipe."""

    rounds: int = 600
    rate: float = 0.03
    leaves: int = 15
    least_rows: int = 40
    row_share: float = 0.8
    column_share: float = 0.7
    l1: float = 0.5
    l2: float = 5.0
    least_hessian: float = 1e-3
    seed: int = 0


@dataclass
class Tree:
    """Nodes by number, 0 the root, 2k + 1 and 2k + 2 the children of k: cuts (column, last bin to the left, whether missing goes left), values of leaves."""

    cuts: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of bins."""
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.cuts):  # a parent has a lesser number than its children
            here = np.flatnonzero(at == node)
            if len(here):
                column, cut, missing_left = self.cuts[node]
                b = bins[here, column]
                at[here] = 2 * node + np.where(np.where(b == 0, missing_left, b <= cut), 1, 2)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        leaves = self.leaf_of(bins)
        out = np.zeros(len(bins))
        for node, value in self.values.items():
            out[leaves == node] = value
        return out


def quantile_edges(frame: DataFrame, names: list[str], bins: int = BINS, accuracy: int = 20_000) -> list[list[float]]:
    """For each column the values that its bins end with, from a quantile sketch of all columns in one pass; a column of nulls has none."""
    at = [k / (bins - 2) for k in range(1, bins - 2)]
    got = frame.agg(*[F.percentile_approx(F.col(c).cast("double"), at, accuracy).alias(f"q{i}") for i, c in enumerate(names)]).first()
    return [sorted(set(got[f"q{i}"] or [])) for i in range(len(names))]


def binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin 0 for missing values, else 1 and the number of edges below the value."""
    out = np.zeros(values.shape, np.uint8)
    for j, e in enumerate(edges):
        v = values[:, j]
        out[:, j] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.asarray(e), v, "left"))
    return out


def in_bag(hashes: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Which rows a round takes; by the row's hash, whatever block it lies in."""
    x = hashes.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (seed * 1_000_003 + number + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53 < share


def columns_of(count: int, s: Settings, number: int) -> list[int]:
    """The columns that a round may cut."""
    some = max(1, round(count * s.column_share))
    return sorted(np.random.default_rng([s.seed, number]).choice(count, some, replace=False).tolist())


def thresholded(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_cut(hist: np.ndarray, s: Settings) -> tuple[float, int, bool, np.ndarray, np.ndarray]:
    """(gain, cut, missing_left, sums, sums to the left) of a histogram (gradient, hessian, rows) by bin; a gain of 0 is none. Ties go to the least cut, with missing to the right."""
    score = lambda x: thresholded(x[0], s.l1) ** 2 / (x[1] + s.l2)
    whole, missing = hist.sum(1), hist[:, :1]
    base, found = score(whole), (0.0, 0, False, whole, np.zeros(3))
    for missing_left in (False, True) if missing[2, 0] else (False,):
        left = np.cumsum(hist[:, 1:], 1) + (missing if missing_left else 0)
        right = whole[:, None] - left
        fits = (np.minimum(left[2], right[2]) >= s.least_rows) & (np.minimum(left[1], right[1]) >= s.least_hessian)
        gain = np.where(fits, score(left) + score(right) - base, 0.0)
        k = int(gain.argmax())
        if gain[k] > found[0] + 1e-12:
            found = (float(gain[k]), k + 1, missing_left, whole, left[:, k])
    return found


def leaf_value(g: float, h: float, s: Settings) -> float:
    return float(-s.rate * thresholded(g, s.l1) / (h + s.l2))


def _blocks(frame: DataFrame, names: list[str], edges: list[list[float]], label: str, start: float) -> DataFrame:
    """The written table of blocks."""
    rows = frame.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)], F.col(label).cast("double").alias("y"), F.xxhash64("match_id").alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[low : low + BLOCK_ROWS]
                bins = binned(part.iloc[:, : len(names)].to_numpy(float), edges)
                yield pd.DataFrame({"rows": [len(part)], "bins": [bins.tobytes()], "y": [part.y.to_numpy(float).tobytes()], "margin": [np.full(len(part), start).tobytes()], "hash": [part.h.to_numpy(np.int64).tobytes()]})

    return staged(rows.mapInPandas(run, BLOCK), "boost-blocks")


def _opened(pdf: pd.DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for r in pdf.itertuples(index=False):
        yield np.frombuffer(r.bins, np.uint8).reshape(r.rows, width), np.frombuffer(r.y), np.frombuffer(r.margin), np.frombuffer(r.hash, np.int64)


def _cuts(blocks: DataFrame, width: int, trees: list[Tree], known: Tree, nodes: list[int], columns: list[int], number: int, s: Settings) -> dict[int, tuple]:
    """The best cut of each node of the growing tree: node -> (gain, column, cut, missing_left, sums, sums to the left). ``trees`` are those not yet in the margins."""
    wanted = np.array(nodes)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(nodes), len(columns), 3, BINS))
        offset = np.arange(len(columns)) * BINS
        for pdf in batches:
            for bins, y, margin, hashes in _opened(pdf, width):
                bag = in_bag(hashes, s.seed, number, s.row_share)
                bins, y = bins[bag], y[bag]
                p = 1 / (1 + np.exp(-(margin[bag] + sum((t.scores(bins) for t in trees), np.zeros(len(bins))))))
                at = known.leaf_of(bins)
                for k, node in enumerate(wanted):
                    here = at == node
                    if here.any():
                        flat = (bins[here][:, columns] + offset).ravel()
                        for j, v in enumerate((p[here] - y[here], p[here] * (1 - p[here]), np.ones(int(here.sum())))):
                            total[k, :, j] += np.bincount(flat, np.repeat(v, len(columns)), len(columns) * BINS).reshape(len(columns), BINS)
        keys = [(k, low) for k in range(len(nodes)) for low in range(0, len(columns), TOGETHER)]
        yield pd.DataFrame({"node": [nodes[k] for k, _ in keys], "first": [low for _, low in keys], "hist": [total[k, low : low + TOGETHER].tobytes() for k, low in keys]})

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hists = np.sum([np.frombuffer(x) for x in sorted(pdf["hist"])], 0).reshape(-1, 3, BINS)
        node, first = key
        out = []
        for column, hist in zip(columns[first : first + TOGETHER], hists, strict=True):
            gain, cut, missing_left, (g, h, n), (gl, hl, nl) = best_cut(hist, s)
            out.append((node, column, gain, cut, missing_left, g, h, n, gl, hl, nl))
        return pd.DataFrame(out, columns=[x.split()[0] for x in CUT.split(", ")])

    found = blocks.mapInPandas(sums, "node long, first int, hist binary").groupBy("node", "first").applyInPandas(best, CUT).collect()
    out: dict[int, tuple] = {}
    for r in sorted(found, key=lambda r: (r.node, -r.gain, r.feature)):  # at most a line for each node and column
        out.setdefault(r.node, (r.gain, r.feature, r.cut, r.missing_left, (r.g, r.h, r.n), (r.gl, r.hl, r.nl)))
    return out


def grow(look, s: Settings) -> Tree:
    """A tree by the best leaf first. ``look(known, nodes)`` gives the best cuts of nodes, where ``known`` has the cuts above them."""
    known, cuts = Tree(), look(Tree(), [0])
    while True:
        leaves, taken = [0], []
        while len(leaves) < s.leaves and all(x in cuts for x in leaves):
            best = max(leaves, key=lambda x: (cuts[x][0], -x))
            if cuts[best][0] <= 0:
                break
            taken.append(best)
            leaves = [x for x in leaves if x != best] + [2 * best + 1, 2 * best + 2]
        if len(leaves) >= s.leaves or all(x in cuts for x in leaves):
            break
        # look at the children of other good leaves too, as many as may still be cut
        others = sorted((x for x in leaves if x in cuts and cuts[x][0] > 0), key=lambda x: -cuts[x][0])[: s.leaves - len(leaves)]
        for x in [*taken, *others]:
            known.cuts[x] = cuts[x][1:4]
        nodes = [c for x in [*taken, *others] for c in (2 * x + 1, 2 * x + 2) if c not in cuts]
        cuts |= look(known, nodes)
    out = Tree(cuts={x: cuts[x][1:4] for x in taken}, gains={x: cuts[x][0] for x in taken})
    for x in leaves:
        up = (x - 1) // 2
        g, h = cuts[x][4][:2] if x in cuts else (np.array(cuts[up][5]) if x % 2 else np.array(cuts[up][4]) - np.array(cuts[up][5]))[:2]
        out.values[x] = leaf_value(g, h, s)
    return out


class Boosted:
    """Trees over binned columns; a missing value or column goes the way that training found better."""

    def __init__(self, names: list[str], edges: list[list[float]], start: float, trees: list[Tree]):
        self.names, self.edges, self.start, self.trees = names, edges, start, trees

    @classmethod
    def fit(cls, train: DataFrame, names: list[str], label: str = "blue_win", settings: Settings | None = None) -> Boosted:
        """``train`` has match_id, which deals the rows of a round by its hash."""
        s = settings or Settings()
        edges = quantile_edges(train, names)
        mean = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
        mean = min(max(mean if mean is not None else 0.5, 1e-6), 1 - 1e-6)
        start = float(np.log(mean / (1 - mean)))
        blocks, trees, pending = _blocks(train, names, edges, label, start), [], []
        tasks = -(-(blocks.agg(F.sum("rows")).first()[0] or 1) // TASK_ROWS)
        blocks = blocks.coalesce(tasks)
        for number in range(s.rounds):
            if len(pending) == EVERY:
                blocks, pending = _with_margins(blocks, len(names), pending).coalesce(tasks), []
            columns = columns_of(len(names), s, number)
            tree = grow(lambda known, nodes: _cuts(blocks, len(names), pending, known, nodes, columns, number, s), s)  # noqa: B023
            trees.append(tree)
            pending.append(tree)
        return cls(names, edges, start, trees)

    def importance(self) -> dict[str, float]:
        """Each column's share of all gains."""
        out = dict.fromkeys(self.names, 0.0)
        for t in self.trees:
            for node, (column, *_) in t.cuts.items():
                out[self.names[column]] += t.gains[node]
        total = sum(out.values()) or 1.0
        return {k: v / total for k, v in out.items()}

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.edges)
        return self.start + sum((t.scores(bins) for t in self.trees), np.zeros(len(bins)))

    def predict(self, frame: DataFrame) -> DataFrame:
        """(match_id, p); absent columns are missing."""
        rows = frame.select("match_id", *[(F.col(c).cast("double") if c in frame.columns else F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(self.names)])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"match_id": pdf.match_id, "p": 1 / (1 + np.exp(-self.margins(pdf.iloc[:, 1:].to_numpy(float))))})

        return rows.mapInPandas(run, "match_id string, p double")

    def save(self, spark: SparkSession, path: str) -> None:
        trees = [{"cuts": [[k, *map(int, c)] for k, c in t.cuts.items()], "values": list(t.values.items()), "gains": list(t.gains.items())} for t in self.trees]
        text = json.dumps({"names": self.names, "edges": self.edges, "start": self.start, "trees": trees})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        d = json.loads(spark.read.text(path).first()[0])
        trees = [Tree({k: (c, b, bool(m)) for k, c, b, m in t["cuts"]}, dict(map(tuple, t["values"])), dict(map(tuple, t["gains"]))) for t in d["trees"]]
        return cls(d["names"], d["edges"], d["start"], trees)


def _with_margins(blocks: DataFrame, width: int, trees: list[Tree]) -> DataFrame:
    """The blocks with the trees' scores added to the margins, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            margins = [(margin + sum((t.scores(bins) for t in trees), np.zeros(len(bins)))).tobytes() for bins, _, margin, _ in _opened(pdf, width)]
            yield pdf.assign(margin=margins)

    return staged(blocks.mapInPandas(run, BLOCK), "boost-blocks")
