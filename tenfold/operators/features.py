"""Features of participants and contests, all from earlier contests only."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenfold.functions.scalars import days_between, epoch_seconds, smoothed
from tenfold.schemas import AGGRESSION, DAY_S, LANE_TRAITS, LONG_S, MEAN_ONLY, PLAYER_FEATURES, ROLES, SHORT_S, TRAITS
from tenfold.sources.tables import staged

from .causal import asof_sums, before, condensed, last, over, prior_sums, running_mean

P, PC = before("puuid"), before("puuid", "champion_id")
TEAM = "PARTITION BY match_id, team_id"
ID = ["match_id", "puuid"]


def role_counts(df: DataFrame) -> DataFrame:
    """Adds arrays of earlier games by true role: by_champion, by_player, by_pair."""
    fives = lambda p: F.array(*[F.col(f"_{p}{r}") for r in range(5)])
    is_role = lambda r: f"CASE WHEN pos_idx = {r} THEN 1 ELSE 0 END"
    out = prior_sums(df, ["champion_id"], {f"_a{r}": is_role(r) for r in range(5)})
    out = out.withColumns({f"_b{r}": over(f"sum({is_role(r)})", P) for r in range(5)}).withColumns({f"_c{r}": over(f"sum({is_role(r)})", PC) for r in range(5)})
    return out.select(*df.columns, fives("a").alias("by_champion"), fives("b").alias("by_player"), fives("c").alias("by_pair"))


def role_scores(df: DataFrame) -> DataFrame:
    """Adds scores: for each role the weighted log probabilities of champion, player and pair."""
    return scored_roles(role_counts(df))


def scored_roles(counted: DataFrame) -> DataFrame:
    """``role_scores`` of rows that have the three arrays of games by role."""

    def logs(c: str, alpha: float) -> str:
        total = f"aggregate({c}, 0L, (a, x) -> a + x)"
        return f"transform({c}, x -> CASE WHEN {total} = 0 THEN ln(0.2D) ELSE ln((x + {alpha}D) / ({total} + {5 * alpha}D)) END)"

    both = f"zip_with({logs('by_champion', 0.5)}, {logs('by_player', 1.0)}, (a, b) -> a + 0.6D * b)"
    return counted.withColumn("scores", F.expr(f"zip_with({both}, {logs('by_pair', 2.0)}, (a, b) -> a + 1.6D * b)")).drop("by_champion", "by_player", "by_pair")


def assigned_roles(df: DataFrame) -> DataFrame:
    """(match_id, puuid, role): the one-to-one assignment of each team's five with the highest score; ties go to the first in order. Other team sizes get roles in turn."""
    return best_roles(role_scores(df))


def best_roles(scored: DataFrame) -> DataFrame:
    """``assigned_roles`` of rows that have scores."""
    team = scored.groupBy("match_id", "team_id").agg(F.sort_array(F.collect_list(F.struct("pos_idx", "puuid", "scores"))).alias("t"))
    orders = list(permutations(range(5)))
    perms = F.array(*[F.array(*[F.lit(5 * i + r) for i, r in enumerate(p)]) for p in orders])
    # a total to nine places and the order's number in one integer: the highest total wins, then the first order
    best = F.expr("127 - pmod(array_max(transform(perms, (p, i) -> cast(floor((m[p[0]] + m[p[1]] + m[p[2]] + m[p[3]] + m[p[4]]) * 1e9D + 0.5D) AS bigint) * 128 + 127 - i)), 128)")
    chosen = team.withColumns({"perms": perms, "m": F.flatten("t.scores")}).select("match_id", F.posexplode("t").alias("i", "x"), F.when(F.size("t") == 5, best).alias("best"))
    role = F.get(F.array(*[F.array(*map(F.lit, p)) for p in orders]), F.col("best").cast("int"))[F.col("i")]
    return chosen.select("match_id", "x.puuid", F.coalesce(role, F.col("i") % 5).alias("role"))


def with_team_damage(df: DataFrame) -> DataFrame:
    """Adds team_dmg."""
    return df.withColumn("team_dmg", F.expr(f"sum(dmg_champs) OVER ({TEAM})"))


def player_features(df: DataFrame) -> DataFrame:
    """Adds PLAYER_FEATURES. df has the true role (pos_idx) and the one to read by (role)."""
    at = pair_windows(player_windows(df if "team_dmg" in df.columns else with_team_damage(df)))
    keep = player_values(at).select(*df.columns, *[f for f in PLAYER_FEATURES if f != "champ_role_winrate"])
    writes = df.selectExpr("patch", "champion_id", "pos_idx AS role", "seq", "win")
    return keep.join(champion_role_winrates(writes, df, _GAMES), ID)


def player_windows(df: DataFrame) -> DataFrame:
    """Adds what is known of a row's player before its contest, as ``player_values`` takes it. df has team_dmg."""
    role_sum = lambda v, r: over(f"sum(CASE WHEN pos_idx = {r} THEN {v} ELSE 0 END)", P)
    at = df.withColumns({"ts_s": epoch_seconds(F.col("game_start")), "minutes": F.expr("greatest(duration_s, 1) / 60D")})
    at = at.withColumns(
        {
            "_cs": F.expr("cs / minutes"), "_gold": F.expr("gold_earned / minutes"), "_vision": F.expr("vision_score / minutes"),
            "_kda": F.expr("(kills + assists) / cast(greatest(deaths, 1) AS double)"), "_share": F.expr("CASE WHEN team_dmg > 0 THEN dmg_champs / cast(team_dmg AS double) ELSE 0.2D END"),
        }
    )
    return at.withColumns(
        {
            "n": over("count(*)", P), "w": over("sum(win)", P), "_rn": over("count(*)", last(10, "puuid")), "_rw": over("sum(win)", last(10, "puuid")),
            "cs_per_min": over("avg(_cs)", P, None), "gold_per_min": over("avg(_gold)", P, None), "kda": over("avg(_kda)", P, None), "dmg_share": over("avg(_share)", P, None), "vision_per_min": over("avg(_vision)", P, None),
            "_last": over("max(ts_s)", P, None), "_times": over("collect_list(ts_s)", last(40, "puuid"), None),
            "rg": F.array(*[role_sum("1", r) for r in range(5)]), "rw": F.array(*[role_sum("win", r) for r in range(5)]),
            "_first": F.array(*[over(f"min(CASE WHEN pos_idx = {r} THEN seq END)", P, None) for r in range(5)]),
        }
    )


def pair_windows(df: DataFrame) -> DataFrame:
    """Adds the earlier games and wins of a row's player with its champion."""
    return df.withColumns({"_cg": over("count(*)", PC), "_cw": over("sum(win)", PC)})


_GAMES = {"_g": "1", "_w": "win"}


def champion_role_winrates(writes: DataFrame, reads: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(match_id, puuid, champ_role_winrate); sums tell games _g and wins _w of a row of writes."""
    read = asof_sums(writes, reads.select("patch", "champion_id", "role", "seq", *ID), ["patch", "champion_id", "role"], sums)
    return read.select(*ID, champion_role_winrate().alias("champ_role_winrate"))


def champion_role_winrate() -> Column:
    """From games _g and wins _w of a champion in a role and patch."""
    return smoothed(F.col("_w"), F.col("_g"), 0.5, 50)


def player_values(at: DataFrame) -> DataFrame:
    """Adds PLAYER_FEATURES but champ_role_winrate, from what is known of a player and its champion before a contest: n, w, _rn, _rw, _last, _times, rg, rw, _first, _cg, _cw and the five means."""
    main = "array_max(transform(sequence(0, 4), r -> CASE WHEN rg[r] > 0 THEN struct(rg[r] AS g, -_first[r] AS f, r AS r) END)).r"
    base = smoothed(F.col("w"), F.col("n"), 0.5, 10)
    rg, rw = F.col("rg")[F.col("role")], F.col("rw")[F.col("role")]
    out = at.withColumn("winrate", F.when(F.col("n") == 0, 0.5).otherwise(base))
    out = out.withColumns(
        {
            "games": F.col("n").cast("double"), "recent_winrate": smoothed(F.col("_rw"), F.col("_rn"), F.col("winrate"), 5),
            "champ_games": F.col("_cg").cast("double"), "champ_winrate": smoothed(F.col("_cw"), F.col("_cg"), F.col("winrate"), 6), "first_time_champ": F.expr("CASE WHEN _cg = 0 THEN 1D ELSE 0D END"),
            "role_games": rg.cast("double"), "role_winrate": smoothed(rw, rg, F.col("winrate"), 8), "off_role": F.expr(f"CASE WHEN n >= 5 AND role <> {main} THEN 1D ELSE 0D END"),
            "days_since_last": days_between(F.col("ts_s"), F.col("_last")), "games_today": F.expr(f"cast(size(filter(_times, t -> ts_s - t <= {DAY_S})) AS double)"),
        }
    )
    return out


def curve(prefix: str, weight: float) -> Column:
    """Smoothed win rate of long less that of short contests, from sums <prefix>sg, sw, lg, lw."""
    long = smoothed(F.col(f"{prefix}lw"), F.col(f"{prefix}lg"), 0.5, weight)
    short = smoothed(F.col(f"{prefix}sw"), F.col(f"{prefix}sg"), 0.5, weight)
    return F.when(F.col(f"{prefix}lg") + F.col(f"{prefix}sg") == 0, 0.0).otherwise(long - short)


CURVE = {"sg": f"CASE WHEN duration_s < {SHORT_S} THEN 1 ELSE 0 END", "sw": f"CASE WHEN duration_s < {SHORT_S} THEN win ELSE 0 END", "lg": f"CASE WHEN duration_s > {LONG_S} THEN 1 ELSE 0 END", "lw": f"CASE WHEN duration_s > {LONG_S} THEN win ELSE 0 END"}


def duration_preference(df: DataFrame) -> DataFrame:
    """Adds duration_preference of the player."""
    out = df.withColumns({f"_d{k}": over(f"sum({e})", P) for k, e in CURVE.items()})
    return out.withColumn("duration_preference", curve("_d", 8)).drop(*[f"_d{k}" for k in CURVE])


def champion_scaling(df: DataFrame) -> DataFrame:
    """(match_id, puuid, champion_scaling): read by role, written by true role."""
    return champion_curves(df.selectExpr("champion_id", "pos_idx AS role", "seq", "win", "duration_s"), df, CURVE)


def champion_curves(writes: DataFrame, reads: DataFrame, sums: dict[str, str]) -> DataFrame:
    """``champion_scaling`` of reads; sums tell the CURVE of a row of writes."""
    read = asof_sums(writes, reads.select("champion_id", "role", "seq", *ID), ["champion_id", "role"], sums)
    return read.select(*ID, curve("", 40).alias("champion_scaling"))


def trait_residuals(df: DataFrame, traits: list[str] = TRAITS, known: DataFrame | None = None) -> DataFrame:
    """Adds r_<trait>: the value less the mean of all earlier rows of its role; 0 for the first. ``known`` has the sums and counts of rows before all of df, by role."""
    out = running_mean(df, "pos_idx", ["seq", "team_id", "pos_idx", "puuid"], traits, known=known)
    return out.withColumns({f"r_{t}": F.col(t) - F.coalesce(F.col(f"{t}_mean"), F.col(t)) for t in traits}).drop(*[f"{t}_mean" for t in traits])


def player_style(df: DataFrame) -> DataFrame:
    """Adds s_<trait> (mean of earlier residuals), style_games, duration_preference and aggression."""
    return styles(trait_residuals(df))


def styles(residuals: DataFrame) -> DataFrame:
    """``player_style`` of rows that have their residuals."""
    out = residuals.withColumns({f"s_{t}": over(f"avg(r_{t})", P, None) for t in TRAITS} | {"style_games": over("count(*)", P).cast("double")})
    return duration_preference(out.drop(*[f"r_{t}" for t in TRAITS])).withColumn("aggression", aggression())


def aggression() -> Column:
    """The mean of the style means that tell it, those that are known."""
    mean = f"array_compact(array({', '.join(f's_{t}' for t in AGGRESSION)}))"
    return F.expr(f"CASE WHEN size({mean}) > 0 THEN aggregate({mean}, 0D, (a, x) -> a + x) / size({mean}) END")


def pair_history(df: DataFrame) -> DataFrame:
    """(match_id, team_id, p1, p2, together): each pair of teammates and its earlier contests on one team."""
    own, other = df.select("match_id", "team_id", "seq", F.col("puuid").alias("p1")), df.select("match_id", "team_id", F.col("puuid").alias("p2"))
    return own.join(other, ["match_id", "team_id"]).where("p1 < p2").withColumn("together", over("count(*)", before("p1", "p2"))).select("match_id", "team_id", "p1", "p2", "together")


def premade_pairs(df: DataFrame, least: int = 2) -> DataFrame:
    """(match_id, team_id, premade_pairs)"""
    return premades(pair_history(df), least)


def premades(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of teammates that were on one team that often, by team."""
    return pairs.groupBy("match_id", "team_id").agg(F.sum((F.col("together") >= least).cast("int")).cast("double").alias("premade_pairs"))


def side(agg, value: str | Column, team: int) -> Column:
    return agg(F.when(F.col("team_id") == team, F.col(value) if isinstance(value, str) else value))


def difference(agg, value: str | Column) -> Column:
    """Aggregate of team 100 less that of team 200; null if either has no value."""
    return side(agg, value, 100) - side(agg, value, 200)


def team_differences(df: DataFrame, min_history: int = 5) -> DataFrame:
    """One row of each contest: label, d_<feature>_<mean|min|max> and coverage."""
    aggs = [difference(f, x).alias(f"d_{x}_{name}") for x in PLAYER_FEATURES for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max)) if name == "mean" or x not in MEAN_ONLY]
    known = (F.col("games") >= min_history).cast("int")
    return (
        df.groupBy("match_id")
        .agg(F.first("seq").alias("seq"), F.first("game_start").alias("game_start"), F.first("patch").alias("patch"), F.first((F.col("winner") == 100).cast("int")).alias("blue_win"), *aggs, side(F.sum, known, 100).alias("blue_coverage"), side(F.sum, known, 200).alias("red_coverage"))
        .withColumns({"d_coverage": F.expr("blue_coverage - red_coverage"), "min_coverage": F.expr("least(blue_coverage, red_coverage)")})
    )


def interaction_terms(x: DataFrame) -> DataFrame:
    """Adds three terms that change their sign when sides are swapped. x has blue_ and red_ summaries; null counts as 0."""
    b, r = (lambda k: F.coalesce(F.col(f"blue_{k}"), F.lit(0.0))), (lambda k: F.coalesce(F.col(f"red_{k}"), F.lit(0.0)))
    clash = lambda own, other: b(own) * r(other) - r(own) * b(other)
    return x.withColumns({"x_aggression_vs_scaling": clash("aggression", "scaling"), "x_damage_vs_durability": clash("damage_per_minute", "damage_taken_pct"), "x_vision_vs_aggression": b("vision_per_min") * r("aggression") - r("vision_per_min") * b("aggression")})


SUMMARY = {"aggression": "aggression", "scaling": "duration_preference", "damage_per_minute": "s_damage_per_minute", "damage_taken_pct": "s_damage_taken_pct", "vision_per_min": "s_vision_per_min"}


def style_differences(df: DataFrame) -> DataFrame:
    """One row of each contest: style means, champion scaling, lanes, premades and interaction terms. df has role."""
    return style_rows(player_style(df).join(champion_scaling(df), ID), premade_pairs(df))


def style_rows(styled: DataFrame, premade: DataFrame) -> DataFrame:
    """``style_differences`` of rows with their styles and champion scaling, and of the premade pairs by team."""
    lanes = [(F.max(F.when((F.col("team_id") == 100) & (F.col("role") == i), F.col(f"s_{t}"))) - F.max(F.when((F.col("team_id") == 200) & (F.col("role") == i), F.col(f"s_{t}")))).alias(f"d_lane_{role.lower()}_{t}") for i, role in enumerate(ROLES) for t in LANE_TRAITS]
    means = [difference(F.avg, c).alias(f"d_style_{t}_mean") for t, c in [*((t, f"s_{t}") for t in TRAITS), ("duration_preference",) * 2, ("style_games",) * 2]]
    sides = [side(F.avg, c, team).alias(f"{name}_{k}") for k, c in SUMMARY.items() for team, name in ((100, "blue"), (200, "red"))]
    rows = styled.groupBy("match_id").agg(*means, difference(F.avg, "champion_scaling").alias("d_champ_scaling_mean"), *lanes, *sides)
    pairs = premade.groupBy("match_id").agg(difference(F.max, "premade_pairs").alias("d_premade_pairs"))
    return interaction_terms(rows.join(pairs, "match_id")).drop(*[f"{s}_{k}" for k in SUMMARY for s in ("blue", "red")])


def with_roles(df: DataFrame, post_game: bool = False) -> DataFrame:
    """Adds role: the true one, or the one inferred from earlier contests."""
    return df.withColumn("role", F.col("pos_idx")) if post_game else df.join(assigned_roles(df), ID)


def feature_matrix(df: DataFrame, min_history: int = 5, require_coverage: int = 0, advanced: bool = True, post_game: bool = False) -> DataFrame:
    """One row of each contest with 4 + 85 columns (4 + 49 without the advanced ones). Coverage is required after the windows, never before.

    The rows with their roles are written once as a table.  All windows by player stand next to each other,
    so that the rows are dealt by player and sorted once; what they give is written too, as it is summed up in two ways.
    """
    roled = staged(with_roles(df, post_game), "roled")
    if not advanced:
        return _covered(team_differences(player_features(roled), min_history), require_coverage)
    known = player_features(styles(with_team_damage(trait_residuals(roled))).drop(*TRAITS))  # a trait has the name of a feature
    known = staged(known.join(champion_scaling(roled), ID), "participants-known")
    return _covered(team_differences(known, min_history), require_coverage).join(style_rows(known, premade_pairs(roled)), "match_id")


#: Columns of a player's earlier rows that its features are made of, besides the residuals of its traits.
OWN = [*ID, "team_id", "champion_id", "pos_idx", "seq", "game_start", "duration_s", "win", "kills", "deaths", "assists", "gold_earned", "cs", "vision_score", "dmg_champs"]


def feature_rows(df: DataFrame, live: DataFrame, min_history: int = 5) -> DataFrame:
    """The rows of ``feature_matrix`` of a few contests, ``live``, which are in df too.

    Only what these read is dealt out: the rows of their players, the sums of their champions and of the
    teams. The traits alone go through windows over all rows, as each residual asks for the mean before it.
    """
    of_live = lambda x, *keys: x.join(live.select(*keys).distinct(), [*keys], "left_semi")
    at = _own_rows(df, live.select("puuid").distinct())
    # the longer key first: what the windows by player add, lists among it, is not sorted again
    fives = F.array(*[over(f"sum(CASE WHEN pos_idx = {r} THEN 1 ELSE 0 END)", PC) for r in range(5)])
    at = player_windows(styles(pair_windows(at.repartition("puuid").withColumn("by_pair", fives)))).drop(*[c for c in OWN if c not in ID])
    known = live.select(*ID, "team_id", "champion_id", "patch", "pos_idx", "seq", "game_start", "winner")
    known = known.join(staged(of_live(at, *ID), "live-windows"), ID)
    premade = staged(premades(of_live(pair_history(of_live(df.select(*ID, "team_id", "seq"), "puuid")), "match_id")), "live-premades")
    cell, champions = _GAMES | CURVE, live.select(F.col("champion_id").alias("_c")).distinct()
    writes = df.join(champions, F.col("champion_id").eqNullSafe(F.col("_c")), "left_semi")
    cells = staged(condensed(writes, live, ["patch", "champion_id", "pos_idx"], cell), "live-champions")
    by_champion = asof_sums(cells, live.select("champion_id", "seq", *ID), ["champion_id"], {f"_a{r}": f"CASE WHEN pos_idx = {r} THEN _g ELSE 0 END" for r in range(5)})
    known = known.join(by_champion.select(*ID, F.array(*[f"_a{r}" for r in range(5)]).alias("by_champion")), ID)
    roles = best_roles(scored_roles(known.select(*ID, "team_id", "pos_idx", "by_champion", F.col("rg").alias("by_player"), "by_pair")))
    known = staged(known.join(roles, ID), "live-roles")
    cells = cells.withColumnRenamed("pos_idx", "role")
    known = staged(player_values(known).join(champion_role_winrates(cells, known, {k: k for k in _GAMES}), ID).join(champion_curves(cells, known, {k: k for k in CURVE}), ID), "live-known")
    return team_differences(known, min_history).drop("seq").join(style_rows(known, premade), "match_id")


def _own_rows(df: DataFrame, players: DataFrame) -> DataFrame:
    """The players' rows: OWN, the residuals and team_dmg. Rows of others pass through the running means with nothing but their traits."""
    own = F.when(F.col("_own"), F.struct(*OWN)).alias("_row")
    at = df.join(players.withColumn("_own", F.lit(True)), "puuid", "left").select("seq", "team_id", "pos_idx", "puuid", *TRAITS, own)
    at = trait_residuals(at).where("_row IS NOT NULL").select("_row.*", *[f"r_{t}" for t in TRAITS])
    teams = df.groupBy(F.col("match_id").alias("_m"), F.col("team_id").alias("_t")).agg(F.sum("dmg_champs").alias("team_dmg"))
    return at.join(teams, (F.col("match_id") == F.col("_m")) & F.col("team_id").eqNullSafe(F.col("_t"))).drop("_m", "_t")


def _covered(rows: DataFrame, least: int) -> DataFrame:
    return rows.where(F.col("blue_coverage") + F.col("red_coverage") >= least).drop("seq")


def side_swapped(frame: DataFrame) -> DataFrame:
    """The rows and their mirror images: differences and interaction terms negated, label and coverage swapped."""
    swap = {"blue_coverage": "red_coverage", "red_coverage": "blue_coverage"}

    def mirrored(c: str) -> Column:
        if c.startswith(("d_", "x_")):
            return (-F.col(c)).alias(c)
        if c == "blue_win":
            return (1 - F.col(c)).alias(c)
        return F.concat("match_id", F.lit("_swap")).alias(c) if c == "match_id" else F.col(swap.get(c, c)).alias(c)

    return frame.unionByName(frame.select(*map(mirrored, frame.columns)))
