"""Table and payload schemas, and the specs that generate columns."""

from __future__ import annotations

from pyspark.sql import types as T

# Role order, traits, lane traits, smoothing weights, thresholds and the metric spec (column, source, key).
ROLES = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]
TRAITS = ["damage_per_minute", "vision_per_min", "solo_kills", "team_damage_pct", "damage_taken_pct", "kill_participation", "turret_plates", "max_cs_adv_lane", "time_spent_dead"]
LANE_TRAITS = ["damage_per_minute", "max_cs_adv_lane", "solo_kills", "damage_taken_pct"]
AGGRESSION = ["solo_kills", "turret_plates", "max_cs_adv_lane"]
EXTRAS = [
    ("summoner_level", "p", "summonerLevel"), ("champ_level", "p", "champLevel"), ("laning_gold_exp_adv", "c", "laningPhaseGoldExpAdvantage"), ("early_laning_gold_exp_adv", "c", "earlyLaningPhaseGoldExpAdvantage"), ("max_cs_adv_lane", "c", "maxCsAdvantageOnLaneOpponent"), ("max_level_lead_lane", "c", "maxLevelLeadLaneOpponent"), ("turret_plates", "c", "turretPlatesTaken"), ("lane_minions_10", "c", "laneMinionsFirst10Minutes"), ("solo_kills", "c", "soloKills"), ("kill_participation", "c", "killParticipation"), ("damage_per_minute", "c", "damagePerMinute"), ("team_damage_pct", "c", "teamDamagePercentage"), ("kills_near_enemy_turret", "c", "killsNearEnemyTurret"), ("outnumbered_kills", "c", "outnumberedKills"), ("multikills", "c", "multikills"), ("dragon_takedowns", "c", "dragonTakedowns"), ("herald_takedowns", "c", "riftHeraldTakedowns"), ("turret_takedowns", "c", "turretTakedowns"), ("damage_to_turrets", "p", "damageDealtToTurrets"), ("vision_per_min", "c", "visionScorePerMinute"), ("vision_adv_lane", "c", "visionScoreAdvantageLaneOpponent"), ("control_wards", "c", "controlWardsPlaced"), ("damage_taken_pct", "c", "damageTakenOnTeamPercentage"), ("skillshots_dodged", "c", "skillshotsDodged"), ("survived_low_hp", "c", "survivedSingleDigitHpCount"), ("time_spent_dead", "p", "totalTimeSpentDead"), ("time_ccing", "p", "timeCCingOthers"), ("first_blood", "p", "firstBloodKill"),
]
PLAYER_FEATURES = ["games", "winrate", "recent_winrate", "champ_games", "champ_winrate", "first_time_champ", "role_games", "role_winrate", "off_role", "cs_per_min", "gold_per_min", "kda", "dmg_share", "vision_per_min", "days_since_last", "games_today", "champ_role_winrate"]
MEAN_ONLY = {"first_time_champ", "off_role", "games_today"}
MIN_DURATION_S, MS_ABOVE, LONG_S, SHORT_S, DAY_S = 900, 100_000, 2100, 1500, 86_400
QUEUE_ID = 420


TYPES = {"string": T.StringType(), "timestamp_ntz": T.TimestampNTZType(), "int": T.IntegerType(), "smallint": T.ShortType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(k, TYPES[v]) for k, v in columns.items()])


TABLES = {
    "raw_matches": table(match_id="string", fetched_at="timestamp_ntz", patch="string", payload="string"),
    "matches": table(match_id="string", platform="string", queue_id="int", patch="string", game_version="string", game_start="timestamp_ntz", duration_s="int", winner="smallint"),
    "participants": table(match_id="string", puuid="string", team_id="smallint", position="string", champion_id="int", win="boolean", kills="int", deaths="int", assists="int", gold_earned="int", cs="int", dmg_champs="int", dmg_taken="int", vision_score="int", wards_placed="int", turret_kills="int", team_pos_idx="smallint"),
    "player_ranks": table(puuid="string", queue="string", tier="string", division="string", lp="int", wins="int", losses="int", observed_at="timestamp_ntz"),
    "crawl_players": table(puuid="string", tier="string", division="string", lp="int", source="string", discovered_at="timestamp_ntz", processed_at="timestamp_ntz", n_match_ids="int"),
    "crawl_matches": table(match_id="string", state="string", reason="string", discovered_at="timestamp_ntz", resolved_at="timestamp_ntz", discovery_count="int", attempts="int"),
    "match_discoveries": table(match_id="string", puuid="string"),
    "crawl_plan": table(match_id="string", priority="int"),
    "participant_extras": table(match_id="string", puuid="string", **{c: "boolean" if c == "first_blood" else "double" for c, _, _ in EXTRAS}),
}

KEYS = {"raw_matches": ["match_id"], "matches": ["match_id"], "participants": ["match_id", "puuid"], "player_ranks": ["puuid", "queue", "observed_at"], "crawl_players": ["puuid"], "crawl_matches": ["match_id"], "match_discoveries": ["match_id", "puuid"], "crawl_plan": ["match_id"], "participant_extras": ["match_id", "puuid"]}

_INT = ["teamId", "championId", "kills", "deaths", "assists", "goldEarned", "totalMinionsKilled", "neutralMinionsKilled", "totalDamageDealtToChampions", "totalDamageTaken", "visionScore", "wardsPlaced", "turretKills"]
_OWN = [f"{k}: string" for _, s, k in EXTRAS if s == "p"]
_CHALLENGES = ", ".join(f"{k}: string" for _, s, k in EXTRAS if s == "c")
PAYLOAD = "info struct<queueId: bigint, gameDuration: bigint, gameVersion: string, endOfGameResult: string, gameStartTimestamp: bigint, gameCreation: bigint, platformId: string, gameId: bigint, teams: array<struct<teamId: int, win: boolean>>, participants: array<struct<puuid: string, teamPosition: string, win: boolean, " + ", ".join([*(f"{k}: bigint" for k in _INT), *_OWN, f"challenges: struct<{_CHALLENGES}>"]) + ">>>"
