"""The fold as a stream against the batch windows, on rows out of order and on rows that come too late."""

import random

import pytest
from pyspark.sql import functions as F

from tenfold.operators import causal
from tenfold.streaming import contests

SCHEMA = "match_id string, puuid string, game_start timestamp, seq long, champion_id int, role int, guess int, win int"
HOUR, START = 3600, 1_700_000_000


@pytest.fixture(scope="module")
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, contests.PROVIDER)
    yield
    spark.conf.unset(key)


def made(spark, at):
    """60 contests of six players, 7 hours apart, in files that are out of order by up to two days; then a row of year 2100, and after it one that is late."""
    draw = random.Random(3)
    rows = [(f"m{m:02}", f"p{p}", START + m * 7 * HOUR, m, draw.choice([1, 2, None]), draw.randrange(3), draw.randrange(3), draw.randrange(2)) for m in range(60) for p in draw.sample(range(9), 6)]
    moved = sorted(rows, key=lambda r: r[2] + draw.random() * 48 * HOUR)
    files = [moved[i : i + 60] for i in range(0, len(moved), 60)]
    end, late = ("end", "end", 4_102_444_800, 10**6, 1, 0, 0, 1), ("late", "p0", START, 0, 1, 0, 0, 1)
    frame = lambda x: spark.createDataFrame(x, SCHEMA.replace("timestamp", "long")).withColumn("game_start", F.timestamp_seconds("game_start"))
    for x in [*files, [end], [late]]:
        frame(x).coalesce(1).write.mode("append").parquet(at)
    return frame(rows), frame([*rows, end, late])


def run(spark, stream_of, at, check, name):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
    q = stream_of(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name), q.lastProgress["eventTime"]["watermark"]


def test_folds_out_of_order(spark, provider, tmp_path):
    at = f"{tmp_path}/in"
    rows, everything = made(spark, at)
    got, watermark = run(spark, lambda s: contests.player_form(s, "50 hours", 3), at, f"{tmp_path}/a", "form")
    p, c = "PARTITION BY puuid ORDER BY seq", "PARTITION BY puuid, champion_id ORDER BY seq"
    before, three, forty = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING", "PARTITION BY puuid ORDER BY unix_seconds(game_start) RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING"
    sums = [("count(*)", f"{p} {before}"), ("sum(win)", f"{p} {before}"), ("count(*)", f"{c} {before}"), ("sum(win)", f"{c} {before}"), ("count(*)", f"{p} {three}"), ("sum(win)", f"{p} {three}"), ("count(*)", forty)]
    want = rows.select("match_id", "puuid", *[causal.over(s, w).alias(n) for (s, w), n in zip(sums, contests.PlayerForm.columns[2:], strict=True)])
    assert sorted(map(tuple, got.where("match_id <> 'end'").collect())) == sorted(map(tuple, want.collect()))
    late = contests.late_rows(everything, got, watermark)
    assert [r.match_id for r in late.collect()] == ["late"]


def test_read_key_apart_from_write_key(spark, provider, tmp_path):
    at = f"{tmp_path}/in"
    rows, _ = made(spark, at)
    got, _ = run(spark, lambda s: contests.asof_counts(s, "50 hours", "role", "guess"), at, f"{tmp_path}/b", "counts")
    reads = rows.select("match_id", "puuid", F.col("guess").alias("role"), "seq")
    want = causal.asof_sums(rows, reads, ["role"], {"games": "1", "wins": "win"}).select("match_id", "puuid", "games", "wins")
    assert sorted(map(tuple, got.where("match_id <> 'end'").collect())) == sorted(map(tuple, want.collect()))
