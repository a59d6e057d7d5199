"""Repeated byte strings by suffix arrays.

Each place of a text starts a window of LENGTH bytes; a window belongs to the least hash of
its K-byte strings (its anchor), so equal windows have equal anchors wherever they stand.
Runs of windows with one anchor are the unit that is dealt out.  Anchors that occur once
cannot repeat; runs that are equal as a whole, by a cryptographic hash of 16 bytes, repeat as
a whole; one text of each different run goes to its anchor's task, where suffix arrays are
built in two stages (suffixes smaller than their successors are sorted, the others are
induced by scanning the buckets) and common prefixes of neighbours tell which windows repeat.

A task must not gather an anchor with very many different runs.  Such runs are cut into parts
by the place of the anchor in the window, and dealt by the bytes that all windows of a part
have in common; the parts that share them are few and go to suffix arrays like any runs.  If
they are still many they are cut again, in the end to single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, row_key, staged
from .hashing import mix, powers, prefixes

LENGTH, K = 200, 40
#: Windows of a run at most; bytes of a text hashed at once; bytes of a suffix array; different runs of an anchor that one task takes.
RUN, AT_ONCE, BLOCK_BYTES, RUNS_AT_ONCE = 512, 1 << 20, 192 << 10, 2048
#: Places of the anchor in the window that share a part of a run, as runs are cut again and again.
STEPS = (16, 4, 1)
SPAN = LENGTH - K + 1


def kept_low(h: np.ndarray) -> np.ndarray:
    """Minima over each SPAN neighbours."""
    n = len(h) - SPAN + 1
    padded = np.full(-(-len(h) // SPAN) * SPAN, np.uint64((1 << 64) - 1))
    padded[: len(h)] = h
    rows = padded.reshape(-1, SPAN)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[SPAN - 1 : SPAN - 1 + n])


def _hashes(a: np.ndarray) -> np.ndarray:
    """Of each string of K bytes."""
    p, (_, down) = prefixes(a), powers(len(a) + 1)
    return mix((p[K:] - p[:-K]) * down[: len(a) - K + 1])


def runs(data: bytes) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, hash of the run's bytes, start, windows, whether the anchor stands there twice), for parts of a text."""
    whole = np.frombuffer(data, np.uint8)
    for low in range(0, max(0, len(whole) - LENGTH + 1), AT_ONCE):
        h = _hashes(whole[low : low + AT_ONCE + LENGTH - 1])
        m = kept_low(h)
        cut = np.flatnonzero(m[1:] != m[:-1]) + 1
        start = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([start, [len(m)]]))
        if size.max() > RUN:
            parts = -(-size // RUN)
            first = np.repeat(start, parts)
            nth = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
            start, size = first + nth * RUN, np.minimum(RUN, np.repeat(size, parts) - nth * RUN)
        value, end = m[start], start + size
        digest = [hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip((start + low).tolist(), (end + low + LENGTH - 1).tolist(), strict=True)]
        same = np.concatenate([[0], np.cumsum(h[: len(m)] == m)])
        times = same[end] - same[start]
        for k in range(0, len(start), 4096):
            tail = end[k : k + 4096, None] + np.arange(SPAN - 1)
            times[k : k + 4096] += (h[tail] == value[k : k + 4096, None]).sum(1)
        yield value.view(np.int64), digest, start + low, size, times > 1


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than its successor; the end of the text is the smallest of all."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    step = np.append(step, -1)
    known = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` bytes, in two stages."""
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    small = smaller_than_next(text)
    sorted_small = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: data[i : i + depth]), np.int64)
    counts = np.bincount(text, minlength=256)
    head = np.cumsum(counts) - counts
    out = np.full(n, -1, np.int64)
    per = np.bincount(text[sorted_small], minlength=256) if len(sorted_small) else np.zeros(256, int)
    tail_from = head + counts - per
    at = 0
    for c in range(256):
        out[tail_from[c] : tail_from[c] + per[c]] = sorted_small[at : at + per[c]]
        at += per[c]
    free = head.copy()
    out[free[text[n - 1]]] = n - 1  # the last suffix is larger than what follows it, nothing
    free[text[n - 1]] += 1

    def induce(seen: np.ndarray) -> None:
        before = seen[seen > 0] - 1
        before = before[~small[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        first, before = first[order], before[order]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [len(first)]]) if len(first) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            c = first[a]
            out[free[c] : free[c] + b - a] = before[a:b]
            free[c] += b - a

    for c in np.flatnonzero(counts):
        low = head[c]
        while low < free[c]:  # a bucket's own suffixes may add to it
            high = free[c]
            induce(out[low:high])
            low = high
        induce(out[tail_from[c] : tail_from[c] + per[c]])
    return out


def prefixes_reach(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix but the first, in order, has its first ``depth`` bytes in common with the one before it."""
    padded = np.frombuffer(data + bytes(depth + 8), np.uint8)
    common, open_ = np.zeros(len(order), np.int64), np.arange(1, len(order))
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(eights[: len(data) + depth]).view(np.uint64)[:, 0]
    for step in range(0, depth - depth % 8, 8):
        open_ = open_[words[order[open_] + step] == words[order[open_ - 1] + step]]
        common[open_] += 8
    for step in range(depth - depth % 8, depth):
        open_ = open_[padded[order[open_] + step] == padded[order[open_ - 1] + step]]
        common[open_] += 1
    return common >= depth


def repeated(texts: list[bytes], depth: int = LENGTH) -> list[np.ndarray]:
    """For each text, the starts of strings of ``depth`` bytes that start anywhere else in the texts too."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    order = suffix_array(data, depth)
    order = order[ends[owner[order]] - order >= depth]  # those that end inside their text
    if len(order) < 2:
        return [np.zeros(0, np.int64)] * len(texts)
    same = prefixes_reach(data, order, depth)
    hit = same.copy()
    hit[:-1] |= same[1:]
    found = np.sort(order[hit])
    at = owner[found]
    starts = ends - [len(t) for t in texts]
    cuts = np.searchsorted(at, np.arange(len(texts) + 1))
    return [found[cuts[k] : cuts[k + 1]] - starts[k] for k in range(len(texts))]


def as_ranges(starts: np.ndarray) -> list[dict]:
    """Consecutive starts as (low, high), high not included."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [{"low": int(x[0]), "high": int(x[-1]) + 1} for x in np.split(starts, cut)]


RANGES = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
RANGES_SQL = "array<struct<low: int, high: int>>"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("data"))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _joined(f, rows: int = 8192):
    """f with its small batches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in f(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _runs(texts: DataFrame) -> DataFrame:
    """(anchor, run, key, start, windows, twice)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                for anchor, digest, start, size, twice in runs(data.as_py()):
                    yield _batch(anchor=pa.array(anchor), run=pa.array(digest, pa.binary()), key=pa.array([key.as_py()] * len(anchor), pa.binary()), start=pa.array(start.astype(np.int32)), windows=pa.array(size.astype(np.int32)), twice=pa.array(twice))

    return texts.select("key", "data").mapInArrow(_joined(find), "anchor long, run binary, key binary, start int, windows int, twice boolean")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (data, wanted): the bytes of each run wanted, with its anchor, run and count."""
    for batch in batches:
        for data, wanted in zip(batch.column(0), batch.column(1), strict=True):
            data, wanted = data.as_py(), wanted.as_py()
            for k in range(0, len(wanted), 4096):
                part = wanted[k : k + 4096]
                yield _batch(anchor=pa.array([w["anchor"] for w in part]), run=pa.array([w["run"] for w in part], pa.binary()), n=pa.array([w["n"] for w in part]), offset=pa.array([-1] * len(part), pa.int32()), bytes=pa.array([data[w["start"] : w["start"] + w["windows"] + LENGTH - 1] for w in part], pa.binary()))


SLICES = "anchor long, run binary, n long, offset int, bytes binary"


def _array_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, run, bytes) in order of anchor: the windows that repeat within each anchor's runs, by suffix arrays of several anchors."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def done(held):
        found = repeated([r[2] for r in held])
        return _batch(anchor=pa.array([r[0] for r in held]), run=pa.array([r[1] for r in held], pa.binary()), ranges=pa.array([as_ranges(x) for x in found], RANGES))

    held, size = [], 0
    for _, group in groupby(rows(), key=lambda r: r[0]):
        for row in group:
            held.append(row)
            size += len(row[2])
        if size >= BLOCK_BYTES:
            yield done(held)
            held, size = [], 0
    if held:
        yield done(held)


def _cut(step: int):
    """Rows (anchor, run, offset, bytes): each run cut where the anchor's place in the window passes a multiple of ``step``.

    Equal windows have the anchor at the same place, so they lie in parts for the same multiple.
    A part's core is what all windows for that multiple have in common.  offset is the anchor's
    place in the first window, or -1 if the anchor is still to be looked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, run, offset, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(data) - LENGTH + 1
                if offset < 0:
                    at = np.flatnonzero(_hashes(np.frombuffer(data, np.uint8)).view(np.int64) == anchor)
                    place = at[np.searchsorted(at, np.arange(n))]
                else:
                    place = np.full(n, offset)
                multiple = (place - np.arange(n)) // step
                low = np.concatenate([[0], np.flatnonzero(np.diff(place * LENGTH + multiple)) + 1])
                high = np.append(low[1:], n)
                first, offsets = place[low] - multiple[low] * step, place[low] - low
                cores = [hashlib.blake2b(data[i : i + LENGTH - step + 1], digest_size=8, salt=int(m).to_bytes(4, "little")).digest() for i, m in zip(first.tolist(), multiple[low], strict=True)]
                texts = [data[i : j + LENGTH - 1] for i, j in zip(low, high, strict=True)]
                parts = [hashlib.blake2b(t, digest_size=16, salt=int(o).to_bytes(4, "little")).digest() for t, o in zip(texts, offsets, strict=True)]
                yield _batch(anchor=pa.array([anchor] * len(low)), run=pa.array([run] * len(low), pa.binary()), low=pa.array(low.astype(np.int32)), core=pa.array(np.frombuffer(b"".join(cores), np.int64)), part=pa.array(parts, pa.binary()), offset=pa.array(offsets.astype(np.int32)), bytes=pa.array(texts, pa.binary()))

    return run


def _ranges(slices: DataFrame, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(anchor, run, ranges): which windows of the different runs (anchor, run, n, offset, bytes) repeat; a run that stands n times repeats as a whole."""
    whole = slices.where("n > 1").select("anchor", "run", F.array(F.struct(F.lit(0).alias("low"), (F.octet_length("bytes") - (LENGTH - 1)).alias("high"))).alias("ranges"))
    arrays = lambda x: x.select("anchor", "run", "bytes").repartition("anchor").sortWithinPartitions("anchor", "run").mapInArrow(_array_ranges, f"anchor long, run binary, ranges {RANGES_SQL}")
    hot = staged(slices.groupBy("anchor").agg(F.count("*").alias("runs")).where(F.col("runs") > RUNS_AT_ONCE).select("anchor"), "hot-anchors")
    if not steps or hot.isEmpty():
        found = arrays(slices)
    else:
        parts = staged(slices.join(hot, "anchor", "left_semi").select("anchor", "run", "offset", "bytes").mapInArrow(_joined(_cut(steps[0])), "anchor long, run binary, low int, core long, part binary, offset int, bytes binary"), "parts")
        shared = parts.groupBy("core").agg(F.count("*").alias("runs")).where("runs > 1").select("core")
        different = parts.join(staged(shared, "shared-cores"), "core").groupBy("core", "part").agg(F.count("*").alias("n"), F.min("offset").alias("offset"), F.min("bytes").alias("bytes"))
        inner = _ranges(staged(different.withColumnsRenamed({"core": "anchor", "part": "run"}), "different-parts"), steps[1:]).withColumnsRenamed({"anchor": "core", "run": "part"})
        shifted = F.expr("transform(ranges, r -> struct(r.low + low AS low, r.high + low AS high))")
        cut = parts.drop("bytes", "offset").join(inner, ["core", "part"]).select("anchor", "run", shifted.alias("ranges")).groupBy("anchor", "run").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
        found = arrays(slices.join(hot, "anchor", "left_anti")).union(cut)
    return staged(found.where("size(ranges) > 0").join(whole.select("anchor", "run"), ["anchor", "run"], "left_anti").union(whole), "ranges")


def _removed(docs: DataFrame) -> DataFrame:
    """(key, ranges): per row key, ranges of window starts, in bytes of its text, that start elsewhere too."""
    texts = _texts(docs)
    found = staged(_runs(texts), "runs")
    active = staged(found.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 OR twice").select("anchor"), "anchors")
    placed = staged(found.join(active.hint("merge"), "anchor"), "placed-runs")
    different = staged(placed.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("key", "start", "windows")).alias("x")), "different-runs")
    compared = staged(different.groupBy("anchor").agg(F.count("*").alias("runs"), F.max("twice").alias("twice")).where("runs > 1 OR twice").select("anchor"), "anchors-compared")
    wanted = different.join(compared.hint("merge"), "anchor").select("anchor", "run", "n", "x.*").groupBy("key").agg(F.collect_list(F.struct("anchor", "run", "n", "start", "windows")).alias("wanted"))
    once = texts.select("key", "data").join(staged(wanted, "runs-wanted").hint("shuffle_hash"), "key")
    slices = staged(once.select("data", "wanted").mapInArrow(_joined(_slices, 512), SLICES), "run-bytes")
    alone = different.where("n > 1").join(compared, "anchor", "left_anti").select("anchor", "run", F.array(F.struct(F.lit(0).alias("low"), F.col("x.windows").alias("high"))).alias("ranges"))
    ranges = staged(_ranges(slices).union(alone), "ranges")
    out = (
        placed.join(ranges.hint("merge"), ["anchor", "run"])
        .select("key", F.expr("transform(ranges, r -> struct(start + r.low AS low, start + r.high AS high))").alias("ranges"))
        .groupBy("key")
        .agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    )
    out = staged(out, "window-ranges")
    discard(found, active, placed, different, compared, slices, ranges)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, data, spans, kept) per row of docs: the text's bytes, the maximal runs removed, and what is left.

    Every byte is removed that is covered by a string of LENGTH bytes that also starts
    anywhere else in docs.  Null and empty texts have no bytes; texts shorter than LENGTH
    keep all; texts of any length are taken whole; equal rows remove each other's strings as
    any copies do; a null doc_id stays null; other columns are left out; an empty table
    gives no rows.
    """
    ranges = _removed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                spans, kept = [], []
                for data, found in zip(part.column(1), part.column(2), strict=True):
                    data, found = data.as_py(), found.as_py()
                    cover = np.zeros(len(data) + 1, np.int32)
                    for r in found or ():
                        cover[r["low"]] += 1
                        cover[r["high"] + LENGTH - 1] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans.append([{"low": int(a), "high": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, RANGES), pa.array(kept, pa.binary())], ["doc_id", "data", "spans", "kept"])

    rows = _texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.join(ranges, "key", "left").select("doc_id", "data", "ranges").mapInArrow(cut, f"doc_id long, data binary, spans {RANGES_SQL}, kept binary")


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, sha256 of what is left) of each text, from all strings at once; for small tables only."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        out.append((int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
