"""Near duplicates among pages of one template that are too different to be linked."""

import random

import pytest
from pyspark.sql import functions as F

from test_llm import brute_classes

from tenfold.llm import minhash
from tenfold.llm.common import ship



def pages(n, rng, changed, vocabulary=10**12, apart=1):
    """Pages of 100 words of one template, each with some words of its own, at places that are multiples of ``apart``."""
    template = [f"t{i}" for i in range(100)]
    out = []
    for _ in range(n):
        words = list(template)
        for at in rng.sample(range(apart, 100 - apart, apart), rng.choice(changed)):
            words[at] = f"w{rng.randrange(vocabulary)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k,share", [(3, (85, 100)), (5, (80, 100))])
@pytest.mark.parametrize("vocabulary", [10**6, 6])
def test_crowds_against_brute_force(spark, monkeypatch, k, share, vocabulary):
    """Few and many changes, from a wide and a narrow vocabulary, so that there are links of all kinds; a second template; every bucket is crowded."""
    ship(spark)
    monkeypatch.setattr(minhash, "SPLIT", 2)
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(vocabulary)
    texts = pages(90, rng, [1, 2, 2, 3, 3, 4, 5], vocabulary)
    texts += [x.replace("t", "s") for x in pages(40, rng, [2, 3, 4], vocabulary)] + [" ".join(x.split()[:70]) for x in pages(30, rng, [1, 2, 3], vocabulary)]
    texts += [" ".join([*texts[0].split(), *(f"e{j}" for j in range(i))]) for i in range(25)]
    rows = list(enumerate(texts))
    seen = []
    real = minhash._crowd_pairs
    monkeypatch.setattr(minhash, "_crowd_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, share).collect()
    want = brute_classes(rows, k, share)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert seen and 1 < len({w[2] for w in want}) < len(rows)


def test_rows_grow_with_the_input(spark, monkeypatch):
    """Twice the pages of one template, unlinked, give about twice the rows of all steps together."""
    ship(spark)
    counts = []
    for n in (2000, 4000):
        rows, real_blocks, real_staged = {}, minhash._blocks, minhash.staged

        def counted(df, name, rows=rows, real=real_staged, **options):
            out = real(df, name, **options)
            rows[name] = rows.get(name, 0) + out.count()
            return out

        def blocks(mixed, rows=rows, real=real_blocks):
            out = real(mixed)
            rows["asked"] = out.count()
            return out

        with monkeypatch.context() as m:
            m.setattr(minhash, "staged", counted)
            m.setattr(minhash, "_blocks", blocks)
            texts = pages(n, random.Random(n), [3], apart=5)  # 89 shingles of 107 in common at most
            found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8), 3, (85, 100))
            assert found.where(F.col("component_id") != F.col("doc_id")).count() == 0
        counts.append(rows)
    small, large = counts
    assert large["asked"] <= 20 * 4000 and large["crowd-differences"] >= 4000 * 0.9
    assert sum(large.values()) <= 2.5 * sum(small.values())
