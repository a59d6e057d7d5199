"""Nested payloads to tables: parse, validate, flatten, extras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenfold.functions.scalars import duration_seconds, parse_patch, patch_number, position_index, start_time
from tenfold.schemas import EXTRAS, MIN_DURATION_S, PAYLOAD, QUEUE_ID, ROLES

from .frontier import after_failures, updated


def parsed(raw: DataFrame) -> DataFrame:
    """Adds info; null for a corrupt payload."""
    return raw.withColumn("info", F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"})["info"])


def reject_reason(queue_id: int | None = QUEUE_ID, min_patch: tuple[int, int] = (0, 0)) -> Column:
    """Why a payload is refused, in order of precedence; null for a valid one. Needs info."""
    queue = F.col("info.queueId")
    players = F.coalesce(F.size("info.participants"), F.lit(0))
    players = F.when(F.col("info.participants").isNull(), 0).otherwise(players)
    patch = parse_patch(F.col("info.gameVersion"))
    least = F.struct(F.lit(min_patch[0]).alias("major"), F.lit(min_patch[1]).alias("minor"))
    roles = ", ".join(f"'{r}'" for r in ROLES)
    five = lambda team: F.expr(f"size(array_distinct(transform(filter(info.participants, p -> coalesce(p.teamId, 0) = {team}), p -> p.teamPosition))) = 5")
    out = F.when(F.col("info").isNull(), "corrupt")
    if queue_id is not None:
        out = out.when(F.coalesce(F.nullif(queue, F.lit(0)), F.lit(-1)) != queue_id, F.concat(F.lit("queue="), F.coalesce(queue.cast("string"), F.lit("None"))))
    return (
        out.when(players != 10, F.concat(F.lit("participants="), players.cast("string")))
        .when(duration_seconds(F.col("info.gameDuration")) < MIN_DURATION_S, "too_short")
        .when(F.coalesce("info.endOfGameResult", F.lit("GameComplete")) != "GameComplete", F.col("info.endOfGameResult"))
        .when(patch_number(patch) < least, F.concat(F.lit("patch="), F.coalesce(patch, F.lit("None"))))
        .when(F.expr(f"exists(info.participants, p -> coalesce(p.teamPosition, '') NOT IN ({roles}))"), "missing_position")
        .when(~(five(100) & five(200)), "duplicate_position")
    )


def validated(raw: DataFrame, queue_id: int | None = QUEUE_ID, min_patch: tuple[int, int] = (0, 0)) -> DataFrame:
    """Adds info, patch and reject_reason (cut to 200 characters)."""
    rows = parsed(raw)
    return rows.withColumns({"patch": F.coalesce(parse_patch(F.col("info.gameVersion")), F.lit("")), "reject_reason": F.substring(reject_reason(queue_id, min_patch), 1, 200)})


def flat_matches(valid: DataFrame) -> DataFrame:
    """One row of each match. winner_inferred tells that no team was marked as winner and the first participant decided."""
    marked = F.expr("get(filter(info.teams, t -> coalesce(t.win, false)), 0).teamId")
    first = F.expr("CASE WHEN coalesce(info.participants[0].win, false) AND info.participants[0].teamId = 100 THEN 100 ELSE 200 END")
    return valid.select(
        "match_id", F.col("info.platformId").alias("platform"), F.coalesce("info.queueId", F.lit(0)).cast("int").alias("queue_id"), "patch", F.col("info.gameVersion").alias("game_version"),
        start_time(F.col("info.gameStartTimestamp"), F.col("info.gameCreation")).alias("game_start"), duration_seconds(F.col("info.gameDuration")).alias("duration_s"), F.coalesce(marked, first).cast("smallint").alias("winner"), marked.isNull().alias("winner_inferred"),
    )


def flat_participants(valid: DataFrame) -> DataFrame:
    """One row of each participant."""
    n = lambda k: F.coalesce(F.col(f"p.{k}"), F.lit(0)).cast("int")
    return valid.select("match_id", F.explode("info.participants").alias("p")).select(
        "match_id", "p.puuid", n("teamId").cast("smallint").alias("team_id"), F.col("p.teamPosition").alias("position"), n("championId").alias("champion_id"), F.coalesce("p.win", F.lit(False)).alias("win"),
        n("kills").alias("kills"), n("deaths").alias("deaths"), n("assists").alias("assists"), n("goldEarned").alias("gold_earned"), (n("totalMinionsKilled") + n("neutralMinionsKilled")).alias("cs"),
        n("totalDamageDealtToChampions").alias("dmg_champs"), n("totalDamageTaken").alias("dmg_taken"), n("visionScore").alias("vision_score"), n("wardsPlaced").alias("wards_placed"), n("turretKills").alias("turret_kills"),
        position_index(F.col("p.teamPosition")).cast("smallint").alias("team_pos_idx"),
    )


def flat_extras(rows: DataFrame) -> DataFrame:
    """The wide metrics of each participant with an id; what is no number is null."""

    def metric(name: str, source: str, key: str) -> Column:
        raw = F.col(f"p.{key}" if source == "p" else f"p.challenges.{key}")
        flag = F.when(raw == "true", F.lit(1.0)).when(raw == "false", F.lit(0.0))
        return (F.when(raw == "true", True).when(raw == "false", False) if name == "first_blood" else F.coalesce(flag, raw.try_cast("double"))).alias(name)

    return rows.select("match_id", F.explode("info.participants").alias("p")).where(F.coalesce("p.puuid", F.lit("")) != "").select("match_id", "p.puuid", *[metric(*x) for x in EXTRAS])


def participant_ids(rows: DataFrame) -> DataFrame:
    """(match_id, puuid) of real participants: ids that are not empty and are no bots."""
    return rows.select("match_id", F.explode("info.participants.puuid").alias("puuid")).where((F.coalesce("puuid", F.lit("")) != "") & ~F.col("puuid").startswith("BOT"))


def answered(answers: DataFrame, queue_id: int | None = QUEUE_ID, min_patch: tuple[int, int] = (0, 0)) -> DataFrame:
    """Answers (match_id, status, payload) with info, patch, state and reason: stored, rejected (404 and refused payloads), or error (no answer, or one that cannot be read)."""
    rows = validated(answers, queue_id, min_patch)
    missing, failed, corrupt = F.col("status") == 404, F.col("status") != 200, F.col("info").isNull()
    state = F.when(missing, "rejected").when(failed | corrupt, "error").when(F.col("reject_reason").isNotNull(), "rejected").otherwise("stored")
    reason = F.when(missing, "404").when(failed, F.concat(F.lit("status="), F.col("status").cast("string"))).when(corrupt, "parse").otherwise(F.col("reject_reason"))
    return rows.withColumns({"state": state, "reason": reason})


def states_after(matches: DataFrame, got: DataFrame, now: Column, max_attempts: int = 4) -> DataFrame:
    """Matches after their answers: final states with their reason, errors as one more attempt, pending again or dead."""
    final = got.where("state <> 'error'").select("match_id", "state", "reason", now.alias("resolved_at"))
    failed = got.where("state = 'error'").select("match_id", "reason")
    return updated(after_failures(updated(matches, failed, "match_id"), failed, now, max_attempts), final, "match_id")
