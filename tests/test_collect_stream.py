"""The collecting stream: the same tables as the loop, also when it is cut off and started again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_collecting import seeded, source

from tenfold.operators import crawl
from tenfold.schemas import TABLES
from tenfold.sources import commits
from tenfold.streaming import collect

def opened(spark, folder):
    return crawl.Store(spark, folder, F.lit("2026-01-01").cast("timestamp_ntz"))


def counted(fetchers, asked):
    def one(f):
        def run(ids):
            asked.update(r[0] for r in ids.collect())
            return f(ids)

        return run

    return [one(f) for f in fetchers]


def run(store, fetchers, checkpoint):
    """To the end, or to the error that stops the query."""
    q = collect.collecting(store, *fetchers, checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def rows(store, name):
    return sorted(map(str, store.read(name).collect()))


@pytest.fixture(scope="module")
def looped(spark, tmp_path_factory):
    store = opened(spark, f"file://{tmp_path_factory.mktemp('loop')}")
    seeded(spark, store, "p0")
    assert store.crawl(100, *source(spark, flaky=(7,)), low_water=5, players=5, batch=6) == 10
    return {name: rows(store, name) for name in TABLES}


def test_stream_collects_what_the_loop_does(spark, tmp_path, looped, monkeypatch):
    monkeypatch.setattr(commits, "MERGE", 3)  # folders are merged under the stream
    store, asked = opened(spark, f"file://{tmp_path}/store"), Counter()
    seeded(spark, store, "p0")
    fetchers = counted(source(spark, flaky=(7,)), asked)
    run(store, fetchers, f"{tmp_path}/ck")
    assert {name: rows(store, name) for name in TABLES} == looped
    assert asked == Counter([f"p{i}" for i in range(15)] + [f"M{m}" for m in range(12)] + ["M7"])  # M7 fails once
    # started again, it has nothing to do; what is queued meanwhile is taken up
    before = store.tables.manifest()["number"]
    run(store, fetchers, f"{tmp_path}/ck")
    assert store.tables.manifest()["number"] == before and asked["p0"] == 1
    seeded(spark, store, "p0", "p77")
    run(store, fetchers, f"{tmp_path}/ck")
    assert asked["p77"] == 1 and asked["p0"] == 1 and sum(asked.values()) == 29


@pytest.mark.parametrize("where", ["before the lists count", "after the lists", "before the answers count", "after the answers"])
def test_a_stream_cut_off_and_started_again(spark, tmp_path, looped, monkeypatch, where):
    """Whatever the place, nothing is asked twice and the tables are the same."""
    store, asked, calls = opened(spark, f"file://{tmp_path}/store"), Counter(), Counter()
    seeded(spark, store, "p0")
    fetchers = counted(source(spark, flaky=(7,)), asked)
    name, late = ("take_lists" if "lists" in where else "take_answers"), where.startswith("after")

    def cut(self, *args, real=getattr(crawl.Store, name)):
        calls[name] += 1
        if calls[name] == 2 and not late:
            raise RuntimeError("cut off")
        return real(self, *args)

    def committed(self, added, marks, real=commits.Tables._commit):
        real(self, added, marks)
        calls["commit", *marks] += 1
        if late and calls["commit", *marks] == 2 and any(m.endswith("lists") == ("lists" in where) for m in marks):
            raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(crawl.Store, name, cut)
        m.setattr(commits.Tables, "_commit", committed)
        with pytest.raises(Exception, match="cut off"):
            run(store, fetchers, f"{tmp_path}/ck")
    again = opened(spark, store.folder)
    run(again, fetchers, f"{tmp_path}/ck")
    assert {name: rows(again, name) for name in TABLES} == looped
    assert asked == Counter([f"p{i}" for i in range(15)] + [f"M{m}" for m in range(12)] + ["M7"])
