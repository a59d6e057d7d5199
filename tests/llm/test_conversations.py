"""Conversation repair against a plain dynamic program over whole strings."""

import hashlib
import random
import zlib
from functools import cache


from tenfold.llm import conversations as c
from tenfold.llm import queries
from tenfold.llm.common import ship

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def least(rows):
    """(cost, audit, repaired rows) of (role, text, fault); from the end, over all edits, by (cost, audit)."""

    @cache
    def best(i, state, inserts):
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, "", ()))
        for role in ("user", "assistant"):
            if inserts < 3 and role[0] in FOLLOWS[state] and (x := best(i, role[0], inserts + 1)):
                out.append((x[0] + 3, "I" + x[1], ((role, ""), *x[2])))
        if i < len(rows):
            role, text, fault = rows[i]
            if x := best(i + 1, state, 0):
                out.append((x[0] + 4, "D" + x[1], x[2]))
            if fault not in ("blank", "duplicate"):
                charge = 3 if fault == "truncated" else 0
                if role[:1] and role[0] in FOLLOWS[state] and (x := best(i + 1, role[0], 0)):
                    out.append((x[0] + charge, "K" + x[1], ((role, text), *x[2])))
                for new in ("user", "assistant"):
                    if new[0] in FOLLOWS[state] and (x := best(i + 1, new[0], 0)):
                        out.append((x[0] + charge + 3, "R" + x[1], ((new, text), *x[2])))
        return min(out, default=None)

    return best(0, "", 0)


def brute(rows):
    """Results by conv_id of rows (conv_id, turn, role, text) as they are after damage."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append((r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    out = {}
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in mine:
            end = text.rstrip(BLANKS)[-1:]
            faulty.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "none"))
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit, kept = least(tuple(faulty))
        count = lambda f: sum(x[2] == f for x in faulty)  # noqa: B023, E731
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in kept))
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def results(spark, rows):
    placed, planned = c.repair(spark.createDataFrame([(*r, 1, "z", 1, "z") for r in rows], "conv_id long, turn long, role string, text string, id int, g string, block int, letters string"))
    sha = {r.g: r.sha256 for r in c.digests(placed, planned).collect()}
    lines = {}
    for r in c.repaired(placed, planned).orderBy("g", "id", "step").collect():
        lines.setdefault(r.g, []).append(f"{r.role}:{r.text}")
    out = {}
    for r in planned.collect():
        text = "\n".join(lines.get(r.g, []))
        assert sha.get(r.g, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()
        assert "".join(p.ops for p in r.pieces) == r.audit
        out[None if r.g == "0" else int(r.g[1:])] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, text)
    return out


def some(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Hi.", "Yes!", "cut", "cut \n", " ", "", None, "É?", "x." + " " * 50, "role:a\nb.", "One more.", "Two.", "Three?", "Hi.\x1f"]
    return [(rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_search_is_least(monkeypatch):
    rng = random.Random(5)
    for size in (1, 3, 48):
        monkeypatch.setattr(c, "WINDOW", size)
        c.search.cache_clear()
        for _ in range(1500):
            rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice(["none"] * 5 + list(c.FAULTS))) for _ in range(rng.randint(0, 11))]
            letters = "".join(c.LETTERS[c.ROLES.index(r[0]) * 4 + c.FAULTS.index(f)] for r, _, f in rows)
            assert c.cheapest(letters) == least(tuple(rows))[:2]


def test_conversations_against_a_plain_program(spark):
    ship(spark)
    rng = random.Random(6)
    rows = [(conv, *r) for conv in [None, *range(60)] for r in some(rng, rng.randint(1, 9))]
    rows += rows[:20]
    assert results(spark, rows) == brute(rows)


def test_one_conversation_over_many_blocks(spark, monkeypatch):
    """Half of all rows in one conversation, a third of them equal; sorted into many ranges, in chunks of few bytes."""
    ship(spark)
    monkeypatch.setattr(c, "CHUNK", 50)
    rng = random.Random(7)
    long = [(1, i, ["user", "assistant"][(i + (rng.random() < 0.1)) % 2], f"Text {i}{rng.choice(['.', '.', '.', ''])}") for i in range(300)]
    rows = long + [(1, 300, "user", "Again.")] * 200 + [(k, *r) for k in range(2, 90) for r in some(rng, 5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = results(spark, rows)
        placed = c.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert placed.where("g = '11'").select("block").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    import sys

    sys.setrecursionlimit(20_000)
    assert got == brute(rows)


def test_empty(spark):
    ship(spark)
    placed, planned = c.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert planned.count() == c.digests(placed, planned).count() == c.repaired(placed, planned).count() == 0



def test_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damaged(rows))
    every = {r[0]: want.get(r[0], (0, 0, 0, 0, 0, 0, "", "")) for r in rows}
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SF).collect()}
    assert got == {k: (*v[:7], hashlib.sha256(v[7].encode()).hexdigest()) for k, v in every.items()}
    assert len({v[6] for v in got.values()}) > 5
