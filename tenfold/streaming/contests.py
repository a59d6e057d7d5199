"""The causal fold as a stream: what was known of a player, or of any key, strictly before a contest.

Rows wait in the state of their key until the watermark has passed their contest's start; a timer
then takes them in order of (start, match_id), reads for all rows of a contest first and writes them
after.  So rows may come in any order within the watermark's delay, and the results are those of
the batch windows.  Rows behind the watermark are dropped by Spark; ``late_rows`` finds them.

``transformWithStateInPandas`` needs the RocksDB state store (``PROVIDER``).  The state of a player is
two counters, a pair for each champion, and a ring of the last contests; what waits is bounded by the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000
PLAYER = "match_id string, puuid string, games long, wins long, champ_games long, champ_wins long, recent_games long, recent_wins long, games_24h long"
COUNTS = "match_id string, puuid string, games long, wins long"


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then folds them contest by contest. ``waiting`` starts with (at, match_id)."""

    waiting: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("waiting", self.waiting)

    def fold(self, key: tuple, contest: list[tuple]) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.waiting.split(", ")]
        for batch in rows:
            got = [tuple(None if pd.isna(v) else v for v in r) for r in batch[names].astype(object).itertuples(index=False)]
            self.rows.appendList(got)
            for at in {r[0] for r in got}:
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.rows.get())
        due = sorted((r for r in held if r[0] <= upto), key=lambda r: r[:2])
        left = [r for r in held if r[0] > upto]
        if not due:
            return
        if left:
            self.rows.put(left)
        else:
            self.rows.clear()
        out = [r for _, contest in groupby(due, key=lambda r: r[:2]) for r in self.fold(key, list(contest))]
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class PlayerForm(InOrder):
    """Games and wins of a player, in all and with the champion, of the last ``recent`` contests and of the day before (of 40 at most)."""

    waiting = "at long, match_id string, champion string, win int"
    columns = [c.split()[0] for c in PLAYER.split(", ")]
    kept = 40

    def __init__(self, recent: int = 10):
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", "games long, wins long")
        self.champions = handle.getMapState("champions", "champion string", "games long, wins long")
        self.ring = handle.getListState("ring", "at long, win int")

    def fold(self, key: tuple, contest: list[tuple]) -> Iterator[tuple]:
        games, wins = self.totals.get() if self.totals.exists() else (0, 0)
        ring = list(self.ring.get()) if self.ring.exists() else []
        with_champion = lambda c: self.champions.getValue((c,)) if self.champions.containsKey((c,)) else (0, 0)
        for at, match_id, champion, _ in contest:
            last = ring[-self.recent :]
            yield (match_id, key[0], games, wins, *with_champion(champion), len(last), sum(w for _, w in last), sum(at - t < DAY for t, _ in ring))
        for at, _, champion, win in contest:
            g, w = with_champion(champion)
            self.champions.updateValue((champion,), (g + 1, w + (win or 0)))
            games, wins = games + 1, wins + (win or 0)
            ring.append((at, win or 0))
        self.totals.update((games, wins))
        self.ring.put(ring[-self.kept :])


class Counts(InOrder):
    """Games and wins written to a key before each contest that reads it."""

    waiting = "at long, match_id string, puuid string, reads boolean, win int"
    columns = [c.split()[0] for c in COUNTS.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", "games long, wins long")

    def fold(self, key: tuple, contest: list[tuple]) -> Iterator[tuple]:
        games, wins = self.totals.get() if self.totals.exists() else (0, 0)
        for _, match_id, puuid, reads, _ in contest:
            if reads:
                yield match_id, puuid, games, wins
        written = [win or 0 for *_, reads, win in contest if not reads]
        self.totals.update((games + len(written), wins + sum(written)))


def player_form(stream: DataFrame, delay: str, recent: int = 10) -> DataFrame:
    """For each row (match_id, puuid, game_start, champion_id, win) of a stream, what was known of the player before it.

    A null champion is one of its own, a null win is none; a null start cannot be put in time and goes;
    rows of one contest do not see each other.
    """
    rows = stream.where("game_start IS NOT NULL").withWatermark("game_start", delay)
    rows = rows.select("match_id", "puuid", "game_start", F.unix_millis("game_start").alias("at"), F.coalesce(F.col("champion_id").cast("string"), F.lit("")).alias("champion"), F.col("win").cast("int").alias("win"))
    return rows.groupBy("puuid").transformWithStateInPandas(PlayerForm(recent), PLAYER, "Append", "EventTime")


def asof_counts(stream: DataFrame, delay: str, write_key: str, read_key: str) -> DataFrame:
    """For each row of a stream, games and wins that earlier contests wrote to its ``read_key``; each row writes to its ``write_key``.

    Both are columns and may differ, as for inferred and true roles.  A key is one task's
    work within a batch: for keys with few values use ``causal.asof_sums`` on stored rows.
    """
    rows = stream.where("game_start IS NOT NULL").withWatermark("game_start", delay)
    sides = F.explode(F.array(*[F.struct(F.coalesce(F.col(k).cast("string"), F.lit("")).alias("key"), F.lit(reads).alias("reads")) for k, reads in ((write_key, False), (read_key, True))]))
    rows = rows.select("match_id", "puuid", "game_start", F.unix_millis("game_start").alias("at"), F.col("win").cast("int").alias("win"), sides.alias("s")).select("*", "s.key", "s.reads").drop("s")
    return rows.groupBy("key").transformWithStateInPandas(Counts(), COUNTS, "Append", "EventTime")


def late_rows(rows: DataFrame, written: DataFrame, watermark: str) -> DataFrame:
    """Rows that the source has had, that start at the watermark or before it (of the query's last progress), and that were never written: they came too late."""
    return rows.where(F.col("game_start") <= F.lit(watermark).cast("timestamp")).join(written, ["match_id", "puuid"], "left_anti")
