"""Repair of conversation structure by cheapest edits.

The rows of all conversations are sorted by range, so that a conversation of any length is
dealt over as many blocks as it needs.  Repeated messages are found by the least place of each
message.  A row is then one letter (who speaks, and what is wrong with it); letters of a block
and then of a conversation are joined into one string, which is as long as the audit to be
returned.  A* runs on the lattice of places and grammar states, window by window: a window
gives, for each state it may be entered in and left in, the least cost and the least audit, and
windows are chained by these.  Audits go back to the blocks as one row for each piece of a
conversation, and each block edits its rows in one pass.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state after a kept row, by state and role, and the role that may be put in.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Role initials and faults; a row's letter stands for one of each.
ROLES, FAULTS = "suax", ("none", "truncated", "blank", "duplicate")
LETTERS = "".join(chr(ord("A") + i) for i in range(len(ROLES) * len(FAULTS)))
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Rows of a window of the search; bytes of a conversation's text handed on at once where it lies in several blocks.
WINDOW, CHUNK = 48, 1 << 20
SPACE = " \t\n\x0b\x0c\r"
PLAN = "g string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<block: bigint, entry: int, ops: string>>"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) as the contract damages them, by a crc32 of conversation and turn; nulls of role and text become one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    spoiled = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1)))
    return spoiled.select("conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def group_of(conv_id: str = "conv_id") -> Column:
    """A conversation's key; null is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("1"), F.col(conv_id).cast("string")), F.lit("0"))


def _row(letter: str) -> tuple[str, str]:
    k = LETTERS.index(letter)
    return ROLES[k // len(FAULTS)], FAULTS[k % len(FAULTS)]


@lru_cache(1 << 16)
def search(letters: str, entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from state ``entry`` through the rows ``letters`` to each state that can be reached by A*.

    The heuristic is the suffix sum of what no path avoids: a deletion for each blank or
    repeated row, and the charge of a truncated one, which is less than its deletion.  It
    never falls by more than an edit costs, so a node is settled when first taken, and among
    equal costs the audit as second key takes the least first.  Insertions stand before the
    row that follows, or at the end of the ``last`` window, where only end states count.
    """
    rows = [_row(x) for x in letters]
    n = len(rows)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        left[i] = left[i + 1] + (0 if fault == "none" else min(TRUNCATED, DELETE) if fault == "truncated" else DELETE)
    queue: list[tuple[int, str, int, int]] = [(left[0], "", 0, entry)]
    settled, out = set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        cost = f - left[i]
        if i == n:
            if not last:
                out[state] = (cost, audit)
                continue
            if state in ENDS:
                return {state: (cost, audit)}
        else:
            role, fault = rows[i]
            heapq.heappush(queue, (cost + DELETE + left[i + 1], audit + "D", i + 1, state))
            if fault in ("none", "truncated"):
                cost_kept = cost + (TRUNCATED if fault == "truncated" else 0)
                if (state, role) in KEPT:
                    heapq.heappush(queue, (cost_kept + left[i + 1], audit + "K", i + 1, KEPT[state, role]))
                heapq.heappush(queue, (cost_kept + REROLE + left[i + 1], audit + "R", i + 1, AFTER[state]))
        heapq.heappush(queue, (f + INSERT, audit + "I", i, AFTER[state]))
    return out


def cheapest(letters: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a whole conversation, the ASCII-least of them.

    At a window's end all paths have gone through the same rows and end with the edit of a
    row, so that none is a prefix of another: of equal costs, that with the lesser prefix, or
    else the lesser audit of the window, is the lesser whatever follows.
    """
    best, back = {START: (0, 0)}, []  # state: (cost, rank of its audit)
    for at in range(0, max(1, len(letters)), WINDOW):
        part, last = letters[at : at + WINDOW], at + WINDOW >= len(letters)
        found: dict[int, tuple] = {}
        for state, (cost, rank) in best.items():
            for end, (more, audit) in search(part, state, last).items():
                if end not in found or (cost + more, rank, audit) < found[end][:3]:
                    found[end] = (cost + more, rank, audit, state)
        order = sorted(found, key=lambda q: found[q][1:3])
        best = {q: (found[q][0], k) for k, q in enumerate(order)}
        back.append({q: found[q][2:] for q in found})
    state = min(best, key=best.get)
    cost, audits = best[state][0], []
    for step in reversed(back):
        audit, state = step[state]
        audits.append(audit)
    return cost, "".join(reversed(audits))


def _plans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts, cost, audit and its pieces by block, of conversations given as letters by block."""
    for batch in batches:
        out = []
        for g, parts in zip(batch["g"], batch["parts"], strict=True):
            letters = "".join(p["letters"] for p in parts)
            rows = [_row(x) for x in letters]
            cost, audit = cheapest(letters)
            pieces, at, row, state = [], 0, 0, START
            for k, p in enumerate(parts):
                begin, entry, upto = at, state, row + len(p["letters"])
                while at < len(audit) and (row < upto or k + 1 == len(parts)):
                    edit = audit[at]
                    state = KEPT[state, rows[row][0]] if edit == "K" else state if edit == "D" else AFTER[state]
                    row += edit != "I"
                    at += 1
                pieces.append({"block": p["block"], "entry": entry, "ops": audit[begin:at]})
            count = lambda fault: sum(f == fault for _, f in rows)  # noqa: B023, E731
            illegal = sum((a[0], b[0]) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
            out.append((g, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, pieces))
        yield pd.DataFrame(out, columns=["g", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces"])


def ordered(rows: DataFrame) -> DataFrame:
    """(g, id, block, turn, role, text): the rows by conversation and turn, nulls first; id ascends without gaps in a block.

    Rows of one turn are ordered by role and text (its first 64 characters, then its md5), so
    that equal rows are neighbours; equal rows may be dealt to any block.  A written table.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    keyed = rows.select(group_of().alias("g"), F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"), F.monotonically_increasing_id().alias("tie"))
    order = ["g", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.md5(F.col("text").cast("binary")), "tie"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    return staged(placed.select("g", "id", F.shiftright("id", 33).alias("block"), "turn", "role", "text"), "conversations-ordered")


def plans(placed: DataFrame) -> DataFrame:
    """One row for each conversation of ``ordered`` rows: g, gaps, the counts of faults, cost, audit and pieces. A written table."""
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    message = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    narrow = staged(placed.select("g", "id", "block", "turn", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open"), message.alias("message")), "conversations-narrow")
    first = narrow.where("NOT blank").groupBy("g", "message").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 2).when(F.col("first").isNull(), 3).when(F.col("open"), 1).otherwise(0)
    role = F.coalesce(F.expr(f"nullif(instr('{ROLES[:3]}', initial), 0)"), F.lit(4))
    role = F.when(F.col("initial") == "", 4).otherwise(role)
    letter = F.substring(F.lit(LETTERS), (role - 1) * len(FAULTS) + fault + 1, F.lit(1))
    each = narrow.drop("message", "turn").join(first, "id", "left").select("g", "block", "id", letter.alias("letter"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "letter"))), lambda x: x["letter"]), "")
    parts = each.groupBy("g", "block").agg(joined.alias("letters"))  # bounded by a block's rows
    whole = parts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("block", "letters"))).alias("parts"))
    turns = narrow.groupBy("g").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return staged(whole.mapInPandas(_plans, PLAN).join(turns, "g"), "conversations-plans")


def _marked(placed: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows and, before those of each piece of a conversation, a row with its edits, together in one partition and in order."""
    none = F.lit(None).cast("string")
    pieces = planned.select("g", F.size("pieces").alias("blocks"), F.explode("pieces").alias("p")).select("g", "p.block", F.lit(-1).cast("long").alias("id"), none.alias("role"), none.alias("text"), "p.ops", "p.entry", "blocks")
    rows = placed.select("g", "block", "id", "role", "text", none.alias("ops"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("int").alias("blocks"))
    return rows.unionByName(pieces).repartition("g", "block").sortWithinPartitions("g", "block", "id")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(g, block, blocks, id, role, text, edit) of the rows that stay or are put in, in order, and after each piece (g, block, blocks) with Nones."""
    piece, ops, at, state, last = None, "", 0, START, 0

    def inserted():
        nonlocal at, state
        while at < len(ops) and ops[at] == "I":
            role, state, at = NEXT[state], AFTER[state], at + 1
            yield (*piece, last, role, "", "I")

    def closed():
        if piece:
            yield from inserted()
            yield (*piece, None, None, None, None)

    for batch in batches:
        for r in batch.to_pylist():
            if r["id"] < 0:
                yield from closed()
                piece, ops, at, state = (r["g"], r["block"], r["blocks"]), r["ops"], 0, r["entry"]
                continue
            last = r["id"]
            yield from inserted()
            edit, at = ops[at], at + 1
            if edit == "K":
                state = KEPT[state, r["role"][:1]]
                yield (*piece, last, r["role"], r["text"], "K")
            elif edit == "R":
                role, state = NEXT[state], AFTER[state]
                yield (*piece, last, role, r["text"], "R")
    yield from closed()


def _frames(rows: Iterator[tuple], names: list[str], schema: pa.Schema, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of some megabytes of text."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 64 + sum(len(x) for x in r if isinstance(x, str))
        if weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], names)


ROWS = pa.schema([("g", pa.string()), ("id", pa.int64()), ("step", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
PARTS = pa.schema([("g", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("lines", pa.string()), ("sha256", pa.string())])
DIGESTS = pa.schema([("g", pa.string()), ("sha256", pa.string())])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((g, at, k, role, text, edit) for k, (g, _, _, at, role, text, edit) in enumerate(_edited(batches)) if edit)
    return _frames(rows, ROWS.names, ROWS)


def _kept_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a conversation that lies in one block its digest; for others their lines, each after a line break, in chunks."""

    def rows():
        lines, size, chunk, whole = [], 0, 0, sha256()
        for g, block, blocks, _, role, text, edit in _edited(batches):
            if edit:
                lines.append(f"\n{role}:{text}")
                size += len(lines[-1])
            if size > CHUNK or not edit and lines:
                joined, lines, size = "".join(lines), [], 0
                if blocks > 1:
                    yield g, block, chunk, joined, None
                else:
                    whole.update(joined.encode("utf-8")[not chunk :])
                chunk += 1
            if not edit:
                if blocks == 1:
                    yield g, block, None, None, whole.hexdigest()
                chunk, whole = 0, sha256()

    return _frames(rows(), PARTS.names, PARTS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, sha256) of conversations whose chunks come one after another."""

    def rows():
        now, whole, begun = None, None, False
        for batch in batches:
            for r in batch.to_pylist():
                if r["g"] != now:
                    if now is not None:
                        yield now, whole.hexdigest()
                    now, whole, begun = r["g"], sha256(), False
                whole.update(r["lines"].encode("utf-8")[not begun :])
                begun = True
        if now is not None:
            yield now, whole.hexdigest()

    return _frames(rows(), DIGESTS.names, DIGESTS)


def repaired(placed: DataFrame, planned: DataFrame) -> DataFrame:
    """The conversations after their edits: g, id, step, role, text, edit (K, R or I); in a conversation rows go by (id, step)."""
    return _marked(placed, planned).mapInArrow(_kept_rows, "g string, id long, step long, role string, text string, edit string")


def digests(placed: DataFrame, planned: DataFrame) -> DataFrame:
    """(g, sha256) of each repaired conversation's lines ``role:text``, joined by line breaks; those without lines may be missing.

    A sha256 reads its bytes in order: the lines of a conversation that lies in several blocks
    go through one task, chunk by chunk, and are not held.
    """
    parts = staged(_marked(placed, planned).mapInArrow(_kept_parts, "g string, block long, chunk long, lines string, sha256 string"), "conversations-parts")
    over = parts.where("lines IS NOT NULL").repartition("g").sortWithinPartitions("g", "block", "chunk").select("g", "lines")
    return parts.where("sha256 IS NOT NULL").select("g", "sha256").unionByName(over.mapInArrow(_digested, "g string, sha256 string"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, planned): the rows in order, and one row for each conversation with its counts, cost, audit and edits.

    rows must have conv_id, turn, role and text; other columns may have any name and are left
    out.  A null role or text is one space, a null turn comes first and is no gap, a null
    conv_id is a conversation of its own.  Rows of one turn are ordered by role and text; of
    equal rows all but the first are duplicates.  A role with another initial than s, u or a,
    the empty one too, cannot be kept.  An empty table gives no rows.
    """
    placed = ordered(rows)
    return placed, plans(placed)
