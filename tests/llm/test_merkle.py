"""The Merkle manifest against trees built in plain Python, and proofs of texts that were changed."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tenfold.llm import merkle, queries
from tenfold.llm.common import ship

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def tree(nodes, fanout):
    """The last node and, for each first node, its siblings (before, after) by level."""
    paths, level, groups = [[] for _ in nodes], nodes, [[i] for i in range(len(nodes))]
    while len(level) > 1:
        up, joined = [], []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for k, members in enumerate(groups[at : at + fanout]):
                for i in members:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            joined.append([i for members in groups[at : at + fanout] for i in members])
        level, groups = up, joined
    return level[0], paths


def brute(rows, fanout=8):
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subroots, out = [], []
    for lang in langs:
        mine = sorted(by_lang[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        sub, paths = tree([leaf(r, r.text) for r in mine], fanout)
        subroots.append(sub)
        out.append((mine, paths))
    root, crown = tree(subroots, fanout)
    result = []
    for (mine, paths), sub, above in zip(out, subroots, crown, strict=True):
        for r, path in zip(mine, paths, strict=True):
            whole = path + above
            now = leaf(r, low(r.text) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else r.text)
            for before, after in whole:
                now = h(before, now, after)
            result.append((r.doc_id, leaf(r, r.text), sub, root, h(*[b + a for b, a in whole]), now, now == root))
    return result


def results(docs, fanout=8):
    spoiled = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(docs, fanout, received=F.when(spoiled, merkle.leaf(merkle.tampered()))).withColumn("folded_root", merkle.folded(F.coalesce("received", "leaf")))
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", merkle.proof(), "folded_root", F.col("folded_root") == F.col("root")).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    """Languages of 1, 8, 9, 65 and 130 rows; nulls, an empty language, repeated rows, equal ids with other texts, names that clash."""
    ship(spark)
    rng = random.Random(2)
    rows = []
    for lang, n in (("en", 130), ("de", 65), ("fr", 9), ("es", 8), ("", 1), (None, 12), ("é", 1), ("z", 3), ("y", 2)):
        rows += [(rng.randrange(10**6), rng.choice(["Some Text", "x", "", None, "É A\nb"]) if rng.random() < 0.5 else "W" * rng.randrange(5000), lang, rng.choice(["s", None]), rng.choice([1, None, -3])) for _ in range(n)]
    rows += [rows[0], rows[0], (rows[1][0], "other", *rows[1][2:]), (None, None, None, None, None), (None, "A", "en", None, 1), (None, "A", "en", None, 1)]
    return spark.createDataFrame([(*r, 1, "z", 1, "z", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, i int, g string, n int, h string, part int")


@pytest.mark.parametrize("fanout", [8, 2])
def test_against_trees_in_plain_python(docs, fanout):
    assert sorted(map(str, results(docs, fanout))) == sorted(map(str, brute(docs.collect(), fanout)))


def test_small_and_empty_tables(docs):
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = docs.where("lang = 'z'").limit(1)
    got = results(one)
    assert got == brute(one.collect()) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == hashlib.sha256(b"").hexdigest()
    two = docs.where("lang IN ('z', 'fr')")
    assert sorted(results(two)) == sorted(brute(two.collect()))


def test_any_change_of_a_field_is_seen(docs):
    """A row whose fields run together like another's is still another leaf."""
    for c, v in (("source", F.lit("t")), ("n_chars", F.lit(2)), ("lang", F.lit("enx")), ("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" ")))):
        changed = docs.where("doc_id IS NOT NULL").select("doc_id", merkle.leaf().alias("a"), *[F.when(F.lit(True), v).alias(c) if x == c else F.col(x) for x in ("text", "lang", "source", "n_chars")])
        assert changed.where(merkle.leaf() == F.col("a")).count() == 0


def test_query(spark):
    rows = queries.table(spark, SF, "documents").collect()
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, SF).collect()]
    assert sorted(got) == sorted(brute(rows)) and 0 < sum(not r[-1] for r in got) < len(got)
