"""Packing by minimum bin slack.

A document's ids are cut into full sequences and one rest.  The rests of a partition are
kept as counts by length; a bitset subset-sum picks, for the largest rest left, the
multiset of lengths that fills the sequence closest to capacity, the counts are found by
going back through the bitsets, and the pattern is used as often as the counts allow.
So a partition needs no shuffle, and its work depends on the number of different lengths.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Ids of rests that a task holds before it packs them and goes on (4 bytes each).
HELD_IDS = 1 << 22
#: Sequence ids of one task: its partition's number times this, and up.
IDS_A_TASK = 1 << 36


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to capacity: at most counts, never beyond."""
    full, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((reach, length, take))
            reach |= (reach << take * length) & full
            left, k = left - take, 2 * k
        if reach >> capacity & 1:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            taken[length] += take
            at -= take * length
    return dict(taken)


def patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Multisets of lengths, one for each kind of sequence, and how many such sequences."""
    counts = {k: n for k, n in counts.items() if n}
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        taken = fill({k: n for k, n in counts.items() if n and k <= capacity - largest}, capacity - largest)
        counts[largest] += 1
        taken[largest] = taken.get(largest, 0) + 1
        times = min(counts[k] // n for k, n in taken.items())
        for k, n in taken.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield taken, times


def powers(total: int) -> list[int]:
    """The powers of two that add up to total, largest first."""
    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


class Packer:
    """Takes documents in turn, gives pieces (doc_id, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.held, self.rests = capacity, first, 0, defaultdict(list)

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            yield doc_id, start, ids[start : start + self.capacity], len(ids), self.sequence(), 0
        if rest := len(ids) - whole:
            self.rests[rest].append((doc_id, whole, ids[whole:].copy(), len(ids)))
            self.held += rest
            if self.held >= HELD_IDS:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """Pack what is held; the last sequence, if not full, is cut into powers of two, which need no padding."""
        for taken, times in patterns({k: len(x) for k, x in self.rests.items()}, self.capacity):
            lengths = [k for k in sorted(taken, reverse=True) for _ in range(taken[k])]
            for _ in range(times):
                pieces = [self.rests[k].pop() for k in lengths]
                yield from self._cut(pieces, powers(sum(lengths)) if self.last() else [sum(lengths)])
        self.rests.clear()
        self.held = 0

    def last(self) -> bool:
        return not any(self.rests.values())

    def _cut(self, pieces: list[tuple], sizes: list[int]) -> Iterator[tuple]:
        sizes, sequence, offset = sizes[::-1], self.sequence(), 0
        for doc_id, start, ids, n in pieces:
            while len(ids):
                if offset == sizes[-1]:
                    sizes.pop()
                    sequence, offset = self.sequence(), 0
                part = ids[: sizes[-1] - offset]
                yield doc_id, start, part, n, sequence, offset
                start, offset, ids = start + len(part), offset + len(part), ids[len(part) :]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most ``capacity`` ids; one row for each piece, with its ids.

    ``ids`` holds little-endian unsigned 32-bit integers.  A null or empty text is the end id
    alone; a long one fills many sequences; equal rows are packed one by one; a null doc_id
    stays null; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer).batches, Packer(capacity, TaskContext.get().partitionId() * IDS_A_TASK)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, n, seq, off = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(n, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        rows: list[tuple] = []
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, ids, sizes in encode(batch.column(1), end):
                for doc_id, upto, n in zip(doc_ids[low:], np.cumsum(sizes).tolist(), sizes.tolist(), strict=False):
                    for piece in packer.add(doc_id, ids[upto - n : upto]):
                        rows.append(piece)
                        if len(rows) >= 2000:
                            yield out(rows)
                            rows = []
        for piece in packer.flush():
            rows.append(piece)
            if len(rows) >= 2000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
