"""The collecting loops over stored tables: seed, expand, drain, crawl, discover, densify, extras.

Tables that only grow are keyed appends.  Players and matches change their state: each change
appends whole rows with a higher step, and the state is the last step of each key.  A batch
changes all its tables in one commit, so that a run that is cut off leaves none of them ahead
of the others; small folders are merged as they gather.  Every step is a few joins over a
batch of ids, and rows of other keys are left out before anything is grouped; the driver
keeps counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenfold.schemas import KEYS, TABLES
from tenfold.sources.commits import Tables
from tenfold.sources.tables import latest, new_rows, staged, unread_payloads

from . import frontier, ingest

CHANGING = ("crawl_players", "crawl_matches", "crawl_plan")
Fetch = Callable[[DataFrame], DataFrame]


class Store:
    def __init__(self, spark: SparkSession, folder: str, now: Column | None = None):
        self.spark, self.folder, self.now = spark, folder, F.current_timestamp().cast("timestamp_ntz") if now is None else now
        self.tables = Tables(spark, folder, {name: partial(self._latest_rows, name) for name in CHANGING}, {"raw_matches": "match_id"})

    @staticmethod
    def _latest_rows(name: str, log: DataFrame) -> DataFrame:
        return latest(log, KEYS[name], "step").select(*TABLES[name].names, "step")

    def _of(self, df: DataFrame, of: DataFrame | None) -> DataFrame:
        return df if of is None else df.join(of.distinct(), of.columns, "left_semi")

    def log(self, name: str) -> DataFrame:
        return self.tables.read(name, T.StructType([*TABLES[name].fields, T.StructField("step", T.LongType())]))

    def read(self, name: str, of: DataFrame | None = None) -> DataFrame:
        """A table's rows as they are now; ``of`` asks for those of some keys (or first parts of keys) only."""
        if name not in CHANGING:
            return self._of(self.tables.read(name, TABLES[name]), of)
        return self._latest_rows(name, self._of(self.log(name), of)).select(*TABLES[name].names)

    def insert(self, name: str, rows: DataFrame) -> int:
        """Append rows with new keys; returns how many."""
        rows = staged(rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]]), f"insert-{name}")
        fresh = new_rows(rows, self.read(name, rows.select(*KEYS[name])), KEYS[name])
        return self.put(name, fresh) if name in CHANGING else self.tables.add(name, fresh)

    def put(self, name: str, rows: DataFrame) -> int:
        """Append changed rows with the commit's number as their step; returns how many."""
        return self.tables.add(name, rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]], F.lit(self.tables.step).cast("long").alias("step")))

    # -- steps

    def seed(self, entries: DataFrame, queue: str = "RANKED_SOLO_5x5", source: str = "seed", summoners: Fetch | None = None) -> int:
        """Ladder entries become players, with a rank snapshot each; returns the new players.

        ``summoners`` gives (summonerId, puuid) for (summonerId): entries without a puuid are asked
        for, each id once; those it does not know, or all of them without it, are left out.
        """
        entries = staged(entries, "seed")
        if summoners is not None:
            asked = entries.where("puuid IS NULL AND summonerId IS NOT NULL").select("summonerId").distinct()
            told = summoners(asked).where("puuid IS NOT NULL").groupBy("summonerId").agg(F.min("puuid").alias("told"))
            entries = staged(entries.join(told, "summonerId", "left").withColumn("puuid", F.coalesce("puuid", "told")).select(*entries.columns), "seed")
        with self.tables.together():
            added = self.insert("crawl_players", frontier.players(entries, source, self.now))
            self.insert("player_ranks", frontier.rank_snapshots(entries, queue, self.now))
        return added

    def expand(self, n: int, match_ids: Fetch, seed: int | None = None) -> tuple[int, int]:
        """Ask for the match ids of n queued players; returns (players done, new matches).

        ``match_ids`` gives (puuid, ids) for (puuid); players with null ids have failed and stay queued.
        """
        claimed = staged(frontier.claim(self.read("crawl_players"), n, seed), "claimed")
        return self.take_lists(claimed, staged(match_ids(claimed.select("puuid")), "listed"))

    def take_lists(self, claimed: DataFrame, listed: DataFrame) -> tuple[int, int]:
        """Store the lists (puuid, ids) of claimed players, in one commit; returns (players done, new matches)."""
        got = listed.where("ids IS NOT NULL")
        batch = staged(got.select("puuid", F.explode("ids").alias("match_id")).distinct(), "batch")
        of = batch.select("match_id")
        _, unseen, after = frontier.add_discoveries(self.read("match_discoveries", of), self.read("crawl_matches", of), batch, self.now)
        mapped = staged(unseen, "unseen").count()
        done = got.groupBy("puuid").agg(F.first(F.size("ids")).alias("n_match_ids"))
        with self.tables.together():
            self.put("crawl_matches", after)
            self.insert("match_discoveries", batch)
            return self.put("crawl_players", frontier.processed(claimed, done, self.now).where("processed_at IS NOT NULL")), mapped

    def drain(self, n: int, fetch: Fetch, least: int = 0, use_plan: bool = False, enqueue: bool = True, queue_id: int | None = 420, min_patch: tuple[int, int] = (0, 0), max_attempts: int = 4) -> tuple[int, int]:
        """Fetch n pending matches and store what is valid; returns (asked, stored).

        ``fetch`` gives (match_id, status, payload) for (match_id).  Payloads, rows and states count
        at once: a run cut off has stored nothing of its batch and is taken up again.
        """
        matches = self.read("crawl_matches")
        ids = staged(frontier.next_pending(matches.where(F.col("discovery_count") >= least) if least else matches, self.read("crawl_plan") if use_plan else None, n).select("match_id"), "asked")
        asked = ids.count()
        if not asked:
            return 0, 0
        got = staged(ingest.answered(fetch(ids), queue_id, min_patch), "answers")
        return asked, self.take_answers(ids, got, enqueue, max_attempts)

    def take_answers(self, ids: DataFrame, got: DataFrame, enqueue: bool = True, max_attempts: int = 4) -> int:
        """Store what is valid of the answers to ids (match_id), and the states after them, in one commit; returns the new matches."""
        valid = got.where("state = 'stored'")
        with self.tables.together():
            stored = self._store(valid)
            if enqueue:
                seen = ingest.participant_ids(valid).select("puuid").distinct()
                self.insert("crawl_players", frontier.players(seen.select("puuid", *[F.lit(None).cast(t).alias(c) for c, t in (("tier", "string"), ("rank", "string"), ("leaguePoints", "int"))]), "snowball", self.now))
            self.put("crawl_matches", ingest.states_after(self.read("crawl_matches", ids), got, self.now, max_attempts))
        return stored

    def _store(self, valid: DataFrame) -> int:
        """Payloads, participants and matches of valid answers; returns the new matches."""
        with self.tables.together():
            self.insert("participants", ingest.flat_participants(valid))
            self.insert("raw_matches", valid.select("match_id", self.now.alias("fetched_at"), "patch", "payload"))
            return self.insert("matches", ingest.flat_matches(valid).drop("winner_inferred"))

    def top_up(self, players: DataFrame, games: int, match_ids: Fetch, fetch: Fetch, queue_id: int | None = 420) -> int:
        """Ask for and store what the history of players (puuid) lacks of that many games; returns the new matches.

        Players without an id of their own (anon:) are not asked for.  Of each, as many of the latest
        listed ids as are lacking are looked at, those not stored are fetched, and the valid ones stored
        with their extras in one commit: what is read back afterwards has them.
        """
        known = players.select("puuid").where("puuid IS NOT NULL AND puuid NOT LIKE 'anon:%'").distinct()
        depth = known.join(self.read("participants").join(known, "puuid", "left_semi").groupBy("puuid").agg(F.count("*").alias("games")), "puuid", "left").select("puuid", F.coalesce("games", F.lit(0)).alias("games"))
        short = staged(depth.where(F.col("games") < games).select("puuid", (F.lit(games) - F.col("games")).alias("need")), "short")
        if short.isEmpty():
            return 0
        listed = staged(match_ids(short.select("puuid")).where("ids IS NOT NULL").join(short, "puuid").select(F.explode(F.expr("slice(ids, 1, cast(need AS int))")).alias("match_id")).distinct(), "listed")
        wanted = listed.join(self.read("matches", listed), "match_id", "left_anti")
        got = staged(ingest.answered(fetch(wanted), queue_id, (0, 0)), "answers")
        valid = got.where("state = 'stored'")
        with self.tables.together():
            stored = self._store(valid)
            self.insert("participant_extras", ingest.flat_extras(valid))
        return stored

    def history(self, players: DataFrame) -> DataFrame:
        """The rows (match, participant, extras) of all stored matches in which one of the players (puuid) was."""
        ids = self.read("participants").join(players.select("puuid").distinct(), "puuid", "left_semi").select("match_id").distinct()
        return self.read("matches", ids).join(self.read("participants", ids), "match_id").join(self.read("participant_extras", ids), ["match_id", "puuid"], "left")

    def add_extras(self, only_missing: bool = True) -> int:
        """The wide metrics of stored payloads; keys that exist are never overwritten. Returns the new rows."""
        raw = unread_payloads(self.read("raw_matches"), self.read("participant_extras"), only_missing)
        return self.insert("participant_extras", ingest.flat_extras(ingest.parsed(raw).where("info IS NOT NULL")))

    # -- loops

    def crawl(self, target: int, match_ids: Fetch, fetch: Fetch, low_water: int = 400, players: int = 40, batch: int = 200, go_on: Callable[[], bool] = lambda: True, **options) -> int:
        """Store ``target`` more matches: list ids when few are pending, then drain; ends when nobody and nothing is left, or ``go_on`` says so."""
        stored = 0
        while stored < target and go_on():
            pending = frontier.pending(self.read("crawl_matches")).count()
            done, _ = self.expand(players, match_ids) if pending < low_water else (0, 0)
            asked, n = self.drain(min(batch, target - stored), fetch, **options)
            stored += n
            if not asked and not done:
                break
        return stored

    def discover(self, most: int, match_ids: Fetch, players: int = 40, go_on: Callable[[], bool] = lambda: True) -> tuple[int, int]:
        """List ids only; returns (players done, matches mapped). Ends when a batch has no players, or none that answered."""
        done = mapped = 0
        while done < most and go_on():
            n, new = self.expand(min(players, most - done), match_ids)
            if not n:
                break
            done, mapped = done + n, mapped + new
        return done, mapped

    def densify(self, target: int, fetch: Fetch, least: int = 5, use_plan: bool = False, enqueue: bool = True, batch: int = 200, go_on: Callable[[], bool] = lambda: True, **options) -> tuple[int, int]:
        """Drain only matches with that many known players, or those planned; returns (asked, stored)."""
        asked = stored = 0
        while stored < target and go_on():
            n, new = self.drain(min(batch, target - stored), fetch, 0 if use_plan else least, use_plan, enqueue, **options)
            if not n:
                break
            asked, stored = asked + n, stored + new
        return asked, stored
