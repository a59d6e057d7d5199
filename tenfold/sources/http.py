"""Rows from an HTTP service: requests are rows of a DataFrame, answers come back as rows."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Paths of the service, and the tiers that have no divisions.
PATHS = {
    "account": "/riot/account/v1/accounts/by-riot-id/{name}/{tag}",
    "account_of": "/riot/account/v1/accounts/by-puuid/{puuid}",
    "match_ids": "/lol/match/v5/matches/by-puuid/{puuid}/ids",
    "match": "/lol/match/v5/matches/{match_id}",
    "timeline": "/lol/match/v5/matches/{match_id}/timeline",
    "entries": "/lol/league/v4/entries/{queue}/{tier}/{division}",
    "entries_of": "/lol/league/v4/entries/by-puuid/{puuid}",
    "apex": "/lol/league/v4/{tier}leagues/by-queue/{queue}",
    "summoner": "/lol/summoner/v4/summoners/{summoner_id}",
    "masteries": "/lol/champion-mastery/v4/champion-masteries/by-puuid/{puuid}",
    "active_game": "/lol/spectator/v5/active-games/by-summoner/{puuid}",
}
APEX = ("challenger", "grandmaster", "master")
RETRIED = (408, 429, 500, 502, 503, 504)
ENTRY = "puuid string, summonerId string, tier string, rank string, leaguePoints int, wins int, losses int"


def path(kind: str, **query: int | None) -> Column:
    """The request for a row whose columns fill the path; query parameters that are None are left out."""
    out, rest = [], PATHS[kind]
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), F.replace(F.url_encode(F.col(name).cast("string")), F.lit("+"), F.lit("%20"))]
    given = "&".join(f"{k}={v}" for k, v in query.items() if v is not None)
    return F.concat(*out, F.lit(rest + (f"?{given}" if given else "")))


def match_ids_path(queue: int | None = None, start_time: int | None = None, end_time: int | None = None, start: int = 0, count: int = 100) -> Column:
    """Times are epoch seconds; the service gives 100 ids at most."""
    return path("match_ids", start=start, count=min(count, 100), queue=queue, startTime=start_time, endTime=end_time)


def fetched(requests: DataFrame, base: str, headers: dict[str, str] | None = None, per_second: float = 50 / 60, lanes: int = 1, attempts: int = 4, wait: float = 1.0) -> DataFrame:
    """requests (path, ...) with status and body. body is null for 404 and for what still fails after the attempts; 401 and 403 raise.

    The rows are dealt to ``lanes`` tasks, each of which keeps its share of ``per_second`` evenly
    paced; 408, 429 and 5xx are tried again after the time that the service names, or a growing one.
    """
    fields = requests.schema.names
    pause = lanes / per_second

    def one(url: str) -> tuple[int, str | None]:
        status = 0
        for k in range(attempts):
            after = wait * 2**k
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=30) as answer:  # noqa: S310
                    return answer.status, answer.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                status = e.code
                if status in (401, 403):
                    raise RuntimeError(f"{status} for {url}") from e
                if status not in RETRIED:
                    return status, None
                after = float(e.headers.get("Retry-After") or after)
            except OSError:
                status = 0
            if k < attempts - 1:
                time.sleep(min(after, 30.0))
        return status, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = time.monotonic()
        for batch in batches:
            got = []
            for at in batch.column(fields.index("path")).to_pylist():
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + pause
                got.append(one(base + at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in got], pa.int32()), pa.array([b for _, b in got], pa.string())], [*fields, "status", "body"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.repartition(lanes).mapInArrow(run, f"{schema}, status int, body string")


def ids_in(answers: DataFrame) -> DataFrame:
    """(puuid, match_id) of answers to match_ids; none for null bodies."""
    return answers.select("puuid", F.explode(F.from_json("body", "array<string>")).alias("match_id"))


def summoners_in(answers: DataFrame) -> DataFrame:
    """(summonerId, puuid) of answers to summoner requests; a null body gives a null puuid."""
    return answers.select(F.col("summoner_id").alias("summonerId"), F.get_json_object("body", "$.puuid").alias("puuid"))


def entries_in(answers: DataFrame) -> DataFrame:
    """Ladder entries of answers (tier, body): a list, or an object with a list of entries, whose rows take the tier and rank I where they name none."""
    each = F.coalesce(F.from_json("body", f"entries array<struct<{ENTRY}>>")["entries"], F.from_json("body", f"array<struct<{ENTRY}>>"))  # an object would be read as a list of one
    rows = answers.withColumnRenamed("tier", "asked").select("asked", F.explode(each).alias("e")).select("asked", "e.*")
    return rows.select("puuid", "summonerId", F.coalesce("tier", F.upper("asked")).alias("tier"), F.coalesce("rank", F.lit("I")).alias("rank"), "leaguePoints", "wins", "losses")


def ladder_entries(spark: SparkSession, get, tiers: list[str], divisions: list[str], pages: int, queue: str = "RANKED_SOLO_5x5") -> DataFrame:
    """Entries of the ladder, apex tiers whole and the others page by page; ``get`` answers requests (path, ...).

    A division is asked for its next page only while the last one had entries; there are as many jobs as pages.
    """
    from .tables import staged

    ask = lambda rows, kind: spark.createDataFrame(rows, "queue string, tier string, division string, page int").withColumn("path", path(kind))
    found = []
    if apex := [(queue, t.lower(), "I", 1) for t in tiers if t.lower() in APEX]:
        found.append(staged(entries_in(get(ask(apex, "apex"))), "ladder"))
    open_ = [(queue, t.upper(), d) for t in tiers if t.lower() not in APEX for d in divisions]
    for page in range(1, pages + 1):
        if not open_:
            break
        answers = staged(get(ask([(*x, page) for x in open_], "entries").withColumn("path", F.concat("path", F.lit(f"?page={page}")))), "ladder-page")
        found.append(entries_in(answers))
        full = answers.where("get_json_object(body, '$[0]') IS NOT NULL").select("queue", "tier", "division").collect()  # a row for each division at most
        open_ = [tuple(r) for r in full]
    out = spark.createDataFrame([], ENTRY)
    for x in found:
        out = out.unionByName(x)
    return out
