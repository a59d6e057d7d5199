"""The stored state against the windows over the whole history."""

import pytest
from pyspark.sql import functions as F

from tenfold.operators import features as X
from tenfold.operators import state
from tenfold.plans.catalog import rounded
from tenfold.sources.fixtures import contests
from tenfold.sources.tables import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return staged(contests(spark, SF), "state-test").cache()


@pytest.fixture(scope="module")
def whole(spark, rows, tmp_path_factory):
    """The state after all contests but the last five, folded in three uneven parts, saved and loaded."""
    folder = f"file://{tmp_path_factory.mktemp('state')}"
    now = state.delta(rows.where("seq < 20"))
    for k, (low, high) in enumerate([(20, 21), (21, 95)]):
        state.save(now, f"{folder}/{k}")
        now = state.fold(state.load(spark, f"{folder}/{k}"), rows.where(f"seq >= {low} AND seq < {high}"))
    state.save(now, f"{folder}/whole")
    return state.load(spark, f"{folder}/whole")


def shown(df):
    out = []
    for r in rounded(df).collect():
        ring = [tuple(x) for x in r.ring] if "ring" in df.columns else None
        out.append({k: v for k, v in r.asDict().items() if k != "ring"} | {"_ring": ring})
    return sorted(map(str, (sorted(x.items()) for x in out)))


def test_parts_folded_are_the_whole(rows, whole):
    once = state.delta(rows.where("seq < 95"))
    for name in [*state.SUMS, "meta"]:
        assert shown(whole[name].select(*sorted(whole[name].columns))) == shown(once[name].select(*sorted(once[name].columns))), name
    assert max(len(r.ring) for r in whole["player"].collect()) <= state.RING


def test_live_rows_equal_the_windows(rows, whole):
    """The five contests after the state, served as one batch: each is told by what came before the first of them."""
    first = rows.where("seq < 96")
    want = rounded(X.feature_matrix(first)).where("match_id = 'M_00000095'")
    got = rounded(state.live_matrix(rows.where("seq = 95"), whole))
    assert set(got.columns) == set(want.columns)
    a, b = got.first().asDict(), want.first().asDict()
    assert {k: v for k, v in a.items() if v != b[k] and not (isinstance(v, float) and abs(v - b[k]) < 2e-6)} == {}
    assert state.live_matrix(rows.where("seq >= 95"), whole).count() == 5


def test_unknown_players_have_played_nothing(rows, whole):
    live = rows.where("seq = 95").withColumns({"puuid": F.concat(F.lit("anon:"), "puuid"), "pos_idx": F.lit(None).cast("int"), "winner": F.lit(None).cast("int")})
    row = state.live_matrix(live, whole).first()
    assert row.blue_coverage == row.red_coverage == 0 and row.d_games_mean == 0 and row.d_premade_pairs == 0 and row.d_style_damage_per_minute_mean is None and row.d_kda_mean is None
    assert row.d_champ_scaling_mean is not None


def test_only_the_players_rows_are_read(rows, whole, monkeypatch):
    live = rows.where("seq = 95")
    plan = state.lookup(whole["player"], live, "puuid")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(puuid" in plan and "contests" not in plan and "state-test" not in plan
    monkeypatch.setattr(state, "ASKED", 3)
    same = state.lookup(whole["player"], live, "puuid")
    assert same.count() == live.select("puuid").distinct().join(whole["player"], "puuid", "left_semi").count() == 10


def test_other_versions_are_refused(spark, whole, tmp_path):
    folder = f"file://{tmp_path}/old"
    state.save({**whole, "meta": whole["meta"].withColumn("version", F.lit(0))}, folder)
    with pytest.raises(ValueError):
        state.load(spark, folder)
