"""Language by a byte convolutional network.

Filters of several widths over embedded bytes, the maximum of each over a window, and a
softmax.  Trained in numpy on windows of a bounded sample; for prediction the embedding is
folded into tables by byte and by pair of bytes, so that a filter costs look-ups and sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a window; widths and filters of each; size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 8, 8
#: The sample: documents of each language (about), windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 800, 4
STEPS, BATCH, RATE = 400, 96, 0.01
#: Windows that a task scores at once.
WINDOWS_AT_ONCE = 1024
ALNUM = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    labels: list[str]
    pair: np.ndarray  # 65536 x 3F: what the pair at a place adds to the three widths
    third: np.ndarray  # 256 x F: what the byte two places on adds to width 3
    pair2: np.ndarray  # 65536 x F: what the pair two places on adds to width 4
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of windows (n, WINDOW) of bytes."""
        wide = x.astype(np.int32)
        pairs = wide[:, :-1] * 256 + wide[:, 1:]
        places = WINDOW - max(WIDTHS) + 1
        act = self.pair[pairs[:, :places]]
        act[:, :, FILTERS : 2 * FILTERS] += self.third[x[:, 2 : 2 + places]]
        act[:, :, 2 * FILTERS :] += self.pair2[pairs[:, 2 : 2 + places]]
        pooled = np.maximum(act.max(1) + self.bias, 0)
        return pooled @ self.weights + self.offset


def has_letter(text: str) -> bool:
    """Fractions, superscripts and the like count as word characters to a pattern, but are no letters."""
    return any(found.group().isalpha() for found in ALNUM.finditer(text))


def windows(text: str) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, the last filled up with zeros."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros((max(1, -(-len(data) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(data)] = data
    return out


def fit(x: np.ndarray, y: np.ndarray, labels: list[str], seed: int = 0) -> Model:
    return folded(parameters(x, y, labels, seed), labels)


def parameters(x: np.ndarray, y: np.ndarray, labels: list[str], seed: int = 0) -> dict[str, np.ndarray]:
    """Embedding E, kernels K2 to K4 with biases b, output W with c: by Adam on the cross entropy of windows; languages are drawn alike often."""
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.3, (256, EMBEDDING)), "W": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "c": np.zeros(len(labels)), "b": np.zeros(len(WIDTHS) * FILTERS)}
    p |= {f"K{w}": rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    share = 1 / np.bincount(y, minlength=len(labels))[y]
    share /= share.sum()
    places, rows = WINDOW - max(WIDTHS) + 1, np.arange(BATCH)[:, None]
    for step in range(1, STEPS + 1):
        pick = rng.choice(len(x), BATCH, p=share)
        xb, emb = x[pick], p["E"][x[pick]]
        pooled, best = [], []
        for w in WIDTHS:
            act = sum(emb[:, j : j + places] @ p[f"K{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w))
            best.append(act.argmax(1))
            pooled.append(np.take_along_axis(act, best[-1][:, None], 1)[:, 0])
        raw = np.concatenate(pooled, 1) + p["b"]
        z = np.maximum(raw, 0)
        s = z @ p["W"] + p["c"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        s[rows[:, 0], y[pick]] -= 1
        s /= BATCH
        g = {"W": z.T @ s, "c": s.sum(0), "E": np.zeros_like(p["E"])}
        back = (s @ p["W"].T) * (raw > 0)
        g["b"] = back.sum(0)
        for k, w in enumerate(WIDTHS):
            part, at = back[:, k * FILTERS : (k + 1) * FILTERS], best[k]
            patch = emb[rows[:, :, None], at[:, :, None] + np.arange(w)].reshape(BATCH, FILTERS, -1)
            g[f"K{w}"] = np.einsum("nf,nfd->df", part, patch)
            to_emb = (part[:, :, None] * p[f"K{w}"].T[None]).reshape(-1, EMBEDDING)
            np.add.at(g["E"], xb[rows[:, :, None], at[:, :, None] + np.arange(w)].reshape(-1), to_emb)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def folded(p: dict[str, np.ndarray], labels: list[str]) -> Model:
    """The embedding and the kernels as tables by byte and by pair of bytes."""
    table = {(w, j): p["E"] @ p[f"K{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for w in WIDTHS for j in range(w)}
    pairs = lambda w, j: (table[w, j][:, None] + table[w, j + 1][None]).reshape(65536, FILTERS)
    return Model(labels, np.concatenate([pairs(w, 0) for w in WIDTHS], 1).astype(np.float32), table[3, 2].astype(np.float32), pairs(4, 2).astype(np.float32), p["b"], p["W"], p["c"])


def sample(docs: DataFrame, label: str = "lang") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, their label numbers and the labels. Each label's share of rows is set so that about SAMPLE_DOCS are expected, and twice
    as many are taken at most; rows are chosen by a hash of the text. The labels are as few as there are languages and are broadcast."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).cast("string").alias("y"), F.col("text").cast("string").alias("text"))
    counts = known.groupBy("y").agg(F.count("*").alias("n"))
    chosen = known.join(F.broadcast(counts), "y").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(1_000_000 * SAMPLE_DOCS) / F.col("n"))
    nth = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("text"), "text"))
    chosen = chosen.select("y", "text", nth.alias("nth")).where(F.col("nth") <= 2 * SAMPLE_DOCS).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, x = [], []
            for label_of, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if has_letter(text):
                    rows = windows(text)
                    for k in np.unique(np.linspace(0, len(rows) - 1, SAMPLE_WINDOWS).astype(int)):
                        y.append(label_of)
                        x.append(rows[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(x, pa.binary())], ["y", "x"])

    rows = chosen.mapInArrow(run, "y string, x binary").toArrow().sort_by([("y", "ascending"), ("x", "ascending")])
    labels = sorted(set(rows.column("y").to_pylist()))
    number = {k: i for i, k in enumerate(labels)}
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return x, np.array([number[k] for k in rows.column("y").to_pylist()], int), labels


def train(docs: DataFrame, label: str = "lang") -> Model | None:
    """A model of the labelled rows of docs; None if there are none."""
    x, y, labels = sample(docs, label)
    return fit(x, y, labels) if labels else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score): each whole text's windows are scored, and their mean decides.

    A text that is null or has no letter, or any text without a model, is "und" with score 0.
    Equal rows get equal results; a null doc_id stays null; other columns are left out; an
    empty table gives no rows.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = share.value

        def scored(texts: list[str | None]) -> tuple[list[str], list[float]]:
            rows = [windows(t) if net and t and has_letter(t) else None for t in texts]
            known = [r for r in rows if r is not None]
            if not known:
                return ["und"] * len(texts), [0.0] * len(texts)
            x = np.concatenate(known)
            out = np.concatenate([net.logits(x[k : k + WINDOWS_AT_ONCE]) for k in range(0, len(x), WINDOWS_AT_ONCE)])
            sizes = np.array([len(r) for r in known])
            mean = np.add.reduceat(out, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
            soft = np.exp(mean - mean.max(1, keepdims=True))
            soft /= soft.sum(1, keepdims=True)
            best = iter(zip(soft.argmax(1), soft.max(1), strict=True))
            found = [("und", 0.0) if r is None else (net.labels[(b := next(best))[0]], float(b[1])) for r in rows]
            return [f[0] for f in found], [f[1] for f in found]

        for batch in batches:
            texts, names, scores, held, size = batch.column(1), [], [], [], 0
            for text in texts:
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size >= WINDOWS_AT_ONCE * WINDOW:
                    n, s = scored(held)
                    names, scores, held, size = names + n, scores + s, [], 0
            n, s = scored(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names + n, pa.string()), pa.array(scores + s, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
