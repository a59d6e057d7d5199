"""DuckDB SQL of the registered queries, written apart from the operators: as-of reads are θ-joins, assignments are
searched over all permutations, running means are plain windows."""

from __future__ import annotations

from tenfold.schemas import AGGRESSION, LANE_TRAITS, MEAN_ONLY, PLAYER_FEATURES, ROLES, TRAITS
from tenfold.sources.fixtures import ROW_SQL, SLOT_SQL

P = "PARTITION BY puuid ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
PC = P.replace("puuid", "puuid, champion_id")
C = P.replace("puuid", "champion_id")
L = "PARTITION BY puuid ORDER BY seq ROWS BETWEEN {} PRECEDING AND 1 PRECEDING"
BASE = f"""WITH e AS (SELECT event_id, ts, event_type, value, user_id, props, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) - 1 AS rn FROM events),
s AS (SELECT {", ".join(SLOT_SQL)} FROM e),
g AS (SELECT match_seq, min(ts) AS game_start FROM s GROUP BY match_seq),
nn AS (SELECT max(match_seq) + 1 AS n_seq FROM s),
c AS (SELECT {", ".join(ROW_SQL)}, match_seq AS seq, epoch_us(game_start) / 1e6 AS ts_s FROM s JOIN g USING (match_seq), nn)"""
EDGES = "WITH ed AS (SELECT DISTINCT l_orderkey AS match_id, l_suppkey AS puuid FROM lineitem), kn AS (SELECT s_suppkey AS puuid FROM supplier WHERE s_acctbal > 0), st AS (SELECT o_orderkey AS match_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'stored' ELSE 'error' END AS state, CAST(o_orderkey % 5 AS INT) AS attempts FROM orders)"


def r6(sql: str) -> str:
    return f"round(({sql}) + 3.17e-8, 6) + 0.0"


def counts(kind: str) -> str:
    window = {"champion": C, "player": P, "pair": PC}[kind]
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN pos_idx = {r} THEN 1 ELSE 0 END) OVER ({window}), 0) AS BIGINT) AS {kind}_{r}" for r in range(5))


ROLE_COUNTS = f"rc AS (SELECT *, {counts('champion')}, {counts('player')}, {counts('pair')} FROM c)"


def _score(r: int) -> str:
    def log(kind: str, alpha: float) -> str:
        total = "(" + " + ".join(f"{kind}_{i}" for i in range(5)) + ")"
        return f"CASE WHEN {total} = 0 THEN ln(CAST(0.2 AS DOUBLE)) ELSE ln(({kind}_{r} + CAST({alpha} AS DOUBLE)) / ({total} + CAST({5 * alpha} AS DOUBLE))) END"

    return f"({log('champion', 0.5)} + CAST(0.6 AS DOUBLE) * {log('player', 1.0)} + CAST(1.6 AS DOUBLE) * {log('pair', 2.0)}) AS score_{r}"


SCORES = ROLE_COUNTS + f", sc AS (SELECT match_id, team_id, puuid, pos_idx, {', '.join(map(_score, range(5)))} FROM rc)"
_differ = " AND ".join(f"p{i}.r <> p{j}.r" for i in range(5) for j in range(i))
ASSIGN = (
    SCORES
    + f""", ra AS (SELECT CAST(r AS INT) AS r FROM range(5) t(r)),
pm AS (SELECT p0.r AS a, p1.r AS b, p2.r AS cc, p3.r AS d, p4.r AS ee FROM ra p0, ra p1, ra p2, ra p3, ra p4 WHERE {_differ}),
tm AS (SELECT match_id, team_id, list(puuid ORDER BY pos_idx, puuid) AS who, list([score_0, score_1, score_2, score_3, score_4] ORDER BY pos_idx, puuid) AS m FROM sc GROUP BY match_id, team_id),
al AS (SELECT match_id, team_id, who, [a, b, cc, d, ee] AS p, round(m[1][a+1] + m[2][b+1] + m[3][cc+1] + m[4][d+1] + m[5][ee+1], 9) AS v FROM tm, pm),
bs AS (SELECT match_id, team_id, who, p FROM al QUALIFY row_number() OVER (PARTITION BY match_id, team_id ORDER BY v DESC, p) = 1),
ro AS (SELECT match_id, unnest(who) AS puuid, unnest(p) AS role FROM bs)"""
)
INFERRED = ASSIGN + ", x AS (SELECT c.*, ro.role FROM c JOIN ro USING (match_id, puuid))"
TRUE = "x AS (SELECT *, pos_idx AS role FROM c)"


def smooth(w: str, n: str, prior: str, k: float) -> str:
    return f"(({w}) + ({prior}) * {float(k)}) / (({n}) + {float(k)})"


_role = lambda v: "CASE role " + " ".join(f"WHEN {r} THEN coalesce(sum(CASE WHEN pos_idx = {r} THEN {v} ELSE 0 END) OVER ({P}), 0)" for r in range(5)) + " END"
_games = lambda r: f"coalesce(sum(CASE WHEN pos_idx = {r} THEN 1 ELSE 0 END) OVER ({P}), 0)"
_first = lambda r: f"min(CASE WHEN pos_idx = {r} THEN seq END) OVER ({P})"
PLAYER = f"""y AS (SELECT *, greatest(duration_s, 1) / CAST(60 AS DOUBLE) AS minutes, sum(dmg_champs) OVER (PARTITION BY match_id, team_id) AS team_dmg FROM x),
z AS (SELECT *, count(*) OVER ({P}) AS n, coalesce(sum(win) OVER ({P}), 0) AS w, count(*) OVER ({L.format(10)}) AS rn, coalesce(sum(win) OVER ({L.format(10)}), 0) AS rw,
    count(*) OVER ({PC}) AS cg, coalesce(sum(win) OVER ({PC}), 0) AS cw, {_role('1')} AS rg, {_role('win')} AS rgw,
    avg(cs / minutes) OVER ({P}) AS f_cs_per_min, avg(gold_earned / minutes) OVER ({P}) AS f_gold_per_min, avg((kills + assists) / CAST(greatest(deaths, 1) AS DOUBLE)) OVER ({P}) AS f_kda,
    avg(CASE WHEN team_dmg > 0 THEN dmg_champs / CAST(team_dmg AS DOUBLE) ELSE 0.2 END) OVER ({P}) AS f_dmg_share, avg(vision_score / minutes) OVER ({P}) AS f_vision_per_min,
    max(ts_s) OVER ({P}) AS last_s, list(ts_s) OVER ({L.format(40)}) AS times,
    list_max([{", ".join(f"CASE WHEN {_games(r)} > 0 THEN struct_pack(g := {_games(r)}, f := -{_first(r)}, r := {r}) END" for r in range(5))}]).r AS main FROM y),
cr AS (SELECT a.match_id, a.puuid, count(b.seq) AS g, coalesce(sum(b.win), 0) AS w FROM x a LEFT JOIN c b ON a.patch = b.patch AND a.champion_id = b.champion_id AND a.role = b.pos_idx AND b.seq < a.seq GROUP BY a.match_id, a.puuid),
v AS (SELECT *, CASE WHEN n = 0 THEN 0.5 ELSE {smooth('w', 'n', '0.5', 10)} END AS base FROM z),
pf AS (SELECT v.match_id, v.puuid, team_id, seq, game_start, patch, winner, CAST(n AS DOUBLE) AS games, base AS winrate, {smooth('rw', 'rn', 'base', 5)} AS recent_winrate, CAST(cg AS DOUBLE) AS champ_games,
    {smooth('cw', 'cg', 'base', 6)} AS champ_winrate, CASE WHEN cg = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS first_time_champ, CAST(rg AS DOUBLE) AS role_games, {smooth('rgw', 'rg', 'base', 8)} AS role_winrate,
    CASE WHEN n >= 5 AND role <> main THEN 1.0 ELSE 0.0 END::DOUBLE AS off_role, f_cs_per_min AS cs_per_min, f_gold_per_min AS gold_per_min, f_kda AS kda, f_dmg_share AS dmg_share, f_vision_per_min AS vision_per_min,
    (ts_s - last_s) / 86400.0 AS days_since_last, CAST(len(list_filter(coalesce(times, []), lambda t: ts_s - t <= 86400)) AS DOUBLE) AS games_today, {smooth('cr.w', 'cr.g', '0.5', 50)} AS champ_role_winrate
    FROM v JOIN cr ON v.match_id = cr.match_id AND v.puuid = cr.puuid)"""
_rm = "PARTITION BY pos_idx ORDER BY seq, team_id, pos_idx, puuid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
RESIDUAL = f"rs AS (SELECT *, {', '.join(f'{t} - coalesce(avg({t}) OVER ({_rm}), {t}) AS r_{t}' for t in TRAITS)} FROM x)"
SHORT, LONG = "duration_s < 1500", "duration_s > 2100"


def curve(sg: str, sw: str, lg: str, lw: str, k: int) -> str:
    return f"CASE WHEN {lg} + {sg} = 0 THEN 0.0 ELSE {smooth(lw, lg, '0.5', k)} - {smooth(sw, sg, '0.5', k)} END::DOUBLE"


def _cond(what: str, when: str, prefix: str = "") -> str:
    return f"coalesce(sum(CASE WHEN {prefix}{when} THEN {prefix}{what} ELSE 0 END)"


_dp = [f"{_cond(v, w).replace('THEN 1 ', 'THEN 1 ')} OVER ({P}), 0)" for w in (SHORT, LONG) for v in ("1", "win")]
PREFERENCE = f"dp AS (SELECT match_id, puuid, {curve(*_dp, 8)} AS duration_preference FROM c)"
_cs = [f"coalesce(sum(CASE WHEN b.{w} THEN {v} ELSE 0 END), 0)" for w in (SHORT, LONG) for v in ("1", "b.win")]
SCALING = f"cx AS (SELECT a.match_id, a.puuid, {curve(*_cs, 40)} AS champion_scaling FROM x a LEFT JOIN c b ON a.champion_id = b.champion_id AND a.role = b.pos_idx AND b.seq < a.seq GROUP BY a.match_id, a.puuid)"
PAIRS = """pr AS (SELECT a.match_id, a.team_id, a.seq, a.puuid AS p1, b.puuid AS p2 FROM c a JOIN c b ON a.match_id = b.match_id AND a.team_id = b.team_id AND a.puuid < b.puuid),
ph AS (SELECT *, row_number() OVER (PARTITION BY p1, p2 ORDER BY seq) - 1 AS together FROM pr),
pp AS (SELECT match_id, team_id, CAST(sum(CASE WHEN together >= 2 THEN 1 ELSE 0 END) AS DOUBLE) AS premade_pairs FROM ph GROUP BY match_id, team_id)"""
_ag = ", ".join(f"s_{t}" for t in AGGRESSION)
STYLE = (
    RESIDUAL
    + f""", sy AS (SELECT match_id, puuid, team_id, role, {", ".join(f"avg(r_{t}) OVER ({P}) AS s_{t}" for t in TRAITS)}, CAST(count(*) OVER ({P}) AS DOUBLE) AS style_games FROM rs),
sa AS (SELECT *, list_avg(list_filter([{_ag}], lambda q: q IS NOT NULL)) AS aggression FROM sy)"""
)


def diff(agg: str, col: str, extra: str = "") -> str:
    one = lambda t: f"{agg}(CASE WHEN team_id = {t}{extra} THEN {col} END)"
    return f"{one(100)} - {one(200)}"


TEAM_COLS = ", ".join(f"{r6(diff(a, f))} AS d_{f}_{n}" for f in PLAYER_FEATURES for n, a in (("mean", "avg"), ("min", "min"), ("max", "max")) if n == "mean" or f not in MEAN_ONLY)
_cov = lambda t: f"count(*) FILTER (WHERE team_id = {t} AND games >= 5)"
COVER = f"CAST({_cov(100)} AS BIGINT) AS blue_coverage, CAST({_cov(200)} AS BIGINT) AS red_coverage, CAST({_cov(100)} - {_cov(200)} AS BIGINT) AS d_coverage, CAST(least({_cov(100)}, {_cov(200)}) AS BIGINT) AS min_coverage"
TEAM = f"tf AS (SELECT match_id, any_value(game_start) AS game_start, any_value(patch) AS patch, CAST(any_value(winner) = 100 AS INT) AS blue_win, {TEAM_COLS}, {COVER} FROM pf GROUP BY match_id)"
LANE = ", ".join(f"{r6(diff('max', f's_{t}', f' AND role = {i}'))} AS d_lane_{role.lower()}_{t}" for i, role in enumerate(ROLES) for t in LANE_TRAITS)
_sum = lambda t, col: f"coalesce(avg(CASE WHEN team_id = {t} THEN {col} END), 0)"


def clash(a: str, b: str) -> str:
    return r6(f"{_sum(100, a)} * {_sum(200, b)} - {_sum(200, a)} * {_sum(100, b)}")


INTER = f"{clash('aggression', 'duration_preference')} AS x_aggression_vs_scaling, {clash('s_damage_per_minute', 's_damage_taken_pct')} AS x_damage_vs_durability, {r6(_sum(100, 's_vision_per_min') + ' * ' + _sum(200, 'aggression') + ' - ' + _sum(200, 's_vision_per_min') + ' * ' + _sum(100, 'aggression'))} AS x_vision_vs_aggression"
STYLE_DIFF = ", ".join(f"{r6(diff('avg', c))} AS d_style_{t}_mean" for t, c in [*((t, f"s_{t}") for t in TRAITS), ("duration_preference",) * 2, ("style_games",) * 2]) + f", {r6(diff('avg', 'champion_scaling'))} AS d_champ_scaling_mean"
ALL_STYLE = f"{STYLE}, {PREFERENCE}, {SCALING}, {PAIRS}, sf AS (SELECT * FROM sa JOIN dp USING (match_id, puuid) JOIN cx USING (match_id, puuid)), pd AS (SELECT match_id, {r6(diff('max', 'premade_pairs'))} AS d_premade_pairs FROM pp GROUP BY match_id), sd AS (SELECT match_id, {STYLE_DIFF}, {LANE}, {INTER} FROM sf GROUP BY match_id)"

SCORED = BASE + f", b AS (SELECT *, {smooth(f'coalesce(sum(win) OVER ({P}), 0)', f'count(*) OVER ({P})', '0.5', 10)} AS wr FROM c), sco AS (SELECT match_id, any_value(seq) AS seq, CAST(any_value(winner) = 100 AS INT) AS y, round(0.5 + avg(CASE WHEN team_id = 100 THEN wr END) - avg(CASE WHEN team_id = 200 THEN wr END), 6) AS p FROM b GROUP BY match_id)"
PF = lambda cols: f"{BASE}, {TRUE}, {PLAYER} SELECT match_id, puuid, {', '.join(f'{r6(c)} AS {c}' for c in cols)} FROM pf"
_clip = "least(greatest(p, 1e-15), 1 - 1e-15)"
AUC = "k AS (SELECT p, count(*) AS n, sum(y) AS pos FROM q GROUP BY p), rk AS (SELECT *, sum(n) OVER (ORDER BY p) - n + (n + 1) / 2.0 AS r FROM k), au AS (SELECT CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(n - pos)) END AS auc FROM rk)"
CAL = "SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS predicted, avg(CAST(y AS DOUBLE)) AS actual FROM sco GROUP BY 1"
PRIO = EDGES + ", pl AS (SELECT m.match_id, CAST(coalesce(n, 0) AS INT) AS priority FROM (SELECT DISTINCT match_id FROM ed) m LEFT JOIN (SELECT match_id, count(*) AS n FROM ed SEMI JOIN kn USING (puuid) GROUP BY match_id) USING (match_id))"
COVERED = "pc AS (SELECT match_id, count(kn.puuid) AS covered, count(*) AS n FROM ed LEFT JOIN kn USING (puuid) GROUP BY match_id)"


def core(m: int, p: int) -> str:
    return EDGES + f", a AS (SELECT * FROM ed WHERE match_id IN (SELECT match_id FROM ed GROUP BY 1 HAVING count(*) >= {m})), b AS (SELECT * FROM a WHERE puuid IN (SELECT puuid FROM a GROUP BY 1 HAVING count(*) >= {p})), cc AS (SELECT * FROM b WHERE match_id IN (SELECT match_id FROM b GROUP BY 1 HAVING count(*) >= {m}))"


BAD = BASE + """, h AS (SELECT DISTINCT match_id, match_seq, game_start, patch, duration_s, winner, match_seq % 11 AS bad FROM c),
vr AS (SELECT *, CASE WHEN bad = 5 THEN '15.1' ELSE patch END AS pt, CASE bad WHEN 1 THEN 'queue=400' WHEN 2 THEN 'participants=9' WHEN 3 THEN 'too_short' WHEN 4 THEN 'Abort_TooFewPlayers' WHEN 5 THEN 'patch=15.1' WHEN 6 THEN 'missing_position' WHEN 7 THEN 'duplicate_position' END AS reason FROM h)"""
_first_won = "(SELECT min(puuid) FROM c WHERE c.match_id = vr.match_id)"

SQL = {
    "prior_games_winrate": f"{BASE} SELECT match_id, puuid, count(*) OVER ({P}) AS games, CAST(coalesce(sum(win) OVER ({P}), 0) AS BIGINT) AS wins, {r6(smooth(f'coalesce(sum(win) OVER ({P}), 0)', f'count(*) OVER ({P})', '0.5', 10))} AS winrate FROM c",
    "recent_form_last10": f"{BASE} SELECT match_id, puuid, count(*) OVER ({L.format(10)}) AS recent_games, CAST(coalesce(sum(win) OVER ({L.format(10)}), 0) AS BIGINT) AS recent_wins FROM c",
    "entity_category_prior": PF(["champ_games", "champ_winrate", "first_time_champ"]),
    "ratio_means_prior": PF(["cs_per_min", "gold_per_min", "kda", "dmg_share", "vision_per_min"]),
    "days_since_last": PF(["days_since_last"]),
    "games_last_24h_of_40": PF(["games_today"]),
    "main_role_off_role": PF(["role_games", "role_winrate", "off_role"]),
    "asof_key_prior": PF(["champ_role_winrate"]),
    "duration_curve_prior": f"{BASE}, {TRUE}, {SCALING} SELECT match_id, puuid, {r6('champion_scaling')} AS champion_scaling FROM cx",
    "duration_preference": f"{BASE}, {PREFERENCE} SELECT match_id, puuid, {r6('duration_preference')} AS duration_preference FROM dp",
    "pair_history": f"{BASE}, {PAIRS} SELECT * FROM pp",
    "role_counts_prior": f"{BASE}, {ROLE_COUNTS} SELECT match_id, puuid, {', '.join(f'{k}_{r}' for k in ('champion', 'player', 'pair') for r in range(5))} FROM rc",
    "role_log_prior": f"{BASE}, {SCORES} SELECT match_id, puuid, {', '.join(f'{r6(f"score_{r}")} AS score_{r}' for r in range(5))} FROM sc",
    "role_assignment": f"{BASE}, {ASSIGN} SELECT match_id, puuid, role FROM ro",
    "role_residual": f"{BASE}, {TRUE}, {RESIDUAL} SELECT match_id, puuid, {', '.join(f'{r6(f"r_{t}")} AS r_{t}' for t in TRAITS)} FROM rs",
    "trait_mean": f"{BASE}, {TRUE}, {STYLE} SELECT match_id, puuid, {', '.join(f'{r6(c)} AS {c}' for c in [*(f's_{t}' for t in TRAITS), 'style_games', 'aggression'])} FROM sa",
    "team_feature_diff": f"{BASE}, {TRUE}, {PLAYER}, {TEAM} SELECT * EXCLUDE (game_start) FROM tf",
    "feature_matrix": f"{BASE}, {INFERRED}, {PLAYER}, {TEAM}, {ALL_STYLE} SELECT * FROM tf JOIN sd USING (match_id) JOIN pd USING (match_id)",
    "lane_diff": f"{BASE}, {TRUE}, {ALL_STYLE} SELECT match_id, COLUMNS('^d_lane_.*') FROM sd",
    "interaction_terms": f"{BASE}, {TRUE}, {ALL_STYLE} SELECT match_id, COLUMNS('^x_.*'), d_champ_scaling_mean, d_premade_pairs FROM sd JOIN pd USING (match_id)",
    "coverage_counts": f"{BASE}, n AS (SELECT *, count(*) OVER ({P}) AS games FROM c) SELECT match_id, {_cov(100)} AS blue_coverage, {_cov(200)} AS red_coverage FROM n GROUP BY match_id",
    "side_swap_union": f"{BASE}, n AS (SELECT *, count(*) OVER ({P}) AS n FROM c), a AS (SELECT match_id, CAST(any_value(winner) = 100 AS INT) AS blue_win, CAST({diff('sum', 'n')} AS BIGINT) AS d_games, count(*) FILTER (WHERE team_id = 100) AS blue_coverage, CAST(sum(win) FILTER (WHERE team_id = 200) AS BIGINT) AS red_coverage FROM n GROUP BY match_id) SELECT * FROM a UNION ALL SELECT match_id || '_swap', 1 - blue_win, -d_games, red_coverage, blue_coverage FROM a",
    "contest_seq": f"{BASE} SELECT match_id, row_number() OVER (ORDER BY game_start, match_id) - 1 AS seq FROM (SELECT DISTINCT match_id, game_start FROM c)",
    "insert_new_anti": "SELECT l_orderkey AS match_id, l_linenumber AS line, l_suppkey AS puuid FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) = 1",
    "progress_counts": EDGES + f" SELECT {', '.join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ('pending', 'stored', 'rejected', 'error'))}, count(*) AS total FROM st",
    "filtered_counts": "SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), '(unknown)') AS tier, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS processed FROM customer GROUP BY 1",
    "coverage_histogram_cumulative": EDGES + f", {COVERED} SELECT covered, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY covered DESC) AS BIGINT) AS n_at_least FROM pc GROUP BY covered",
    "discovery_counts": EDGES + " SELECT match_id, count(*) AS discovery_count FROM ed GROUP BY match_id",
    "pending_topk": PRIO + " SELECT match_id, priority, coalesce(n, 0) AS discovery_count FROM st JOIN pl USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM ed GROUP BY match_id) USING (match_id) WHERE state = 'pending' ORDER BY priority DESC, 3 DESC, match_id LIMIT 50",
    "claim_players": "SELECT c_custkey AS puuid, c_nationkey AS discovered_at FROM customer WHERE NOT c_acctbal > 0 ORDER BY c_nationkey, c_custkey LIMIT 40",
    "retry_transition": EDGES + ", f AS (SELECT DISTINCT l_orderkey AS match_id, 1 AS hit FROM lineitem WHERE l_returnflag = 'R') SELECT match_id, CASE WHEN hit IS NULL THEN state WHEN attempts + 1 >= 4 THEN 'error' ELSE 'pending' END AS state, attempts + coalesce(hit, 0) AS attempts, hit IS NOT NULL AND attempts + 1 >= 4 AS dead FROM st LEFT JOIN f USING (match_id)",
    "requeue": EDGES + " SELECT match_id, CASE state WHEN 'error' THEN 'pending' ELSE state END AS state, CASE state WHEN 'error' THEN 0 ELSE attempts END AS attempts FROM st",
    "priority_score": PRIO + " SELECT match_id, priority FROM pl",
    "priority_histogram": PRIO + " SELECT priority, count(*) AS n FROM pl JOIN st USING (match_id) WHERE state = 'pending' GROUP BY priority ORDER BY priority DESC LIMIT 8",
    "fully_covered_groups": EDGES + f", {COVERED} SELECT ed.* FROM ed JOIN pc USING (match_id) WHERE covered >= 3 AND covered = n",
    "staged_update": EDGES + ", n AS (SELECT DISTINCT l_orderkey AS match_id FROM lineitem WHERE l_orderkey % 3 = 0) SELECT st.match_id, CASE WHEN n.match_id IS NOT NULL THEN 'stored' ELSE state END AS state, attempts FROM st LEFT JOIN n USING (match_id)",
    "latest_state": "SELECT l_orderkey AS match_id, l_linestatus AS state, l_linenumber AS ord FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_linestatus DESC) = 1",
    "discoveries_added": EDGES + ", m AS (SELECT match_id, state FROM st WHERE match_id % 5 <> 0), t AS (SELECT DISTINCT match_id FROM ed WHERE match_id % 4 = 0), a AS (SELECT * FROM m UNION ALL SELECT match_id, 'pending' FROM t ANTI JOIN m USING (match_id)) SELECT a.match_id, state, CAST(CASE WHEN t.match_id IS NULL THEN 0 ELSE d.n END AS INT) AS discovery_count FROM a LEFT JOIN t USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM ed GROUP BY 1) d USING (match_id)",
    "kcore_edges": core(3, 5) + " SELECT match_id, puuid FROM cc",
    "kcore_edges_dense": core(5, 20) + " SELECT match_id, puuid FROM cc",
    "plan_report": core(3, 5) + " SELECT count(DISTINCT puuid) AS players, count(DISTINCT match_id) AS matches, round(count(*) / count(DISTINCT puuid), 1) AS games_per_player FROM cc",
    "validate_reasons": BAD + " SELECT match_id, pt AS patch, reason AS reject_reason FROM vr",
    "flatten_groups": BAD + f" SELECT match_id, 420 AS queue_id, patch, patch || '.704.1234' AS game_version, date_trunc('milliseconds', game_start) AS game_start, duration_s, CASE WHEN bad = 9 THEN CASE WHEN (SELECT any_value(win = 1 AND team_id = 100) FROM c WHERE c.match_id = vr.match_id AND c.puuid = {_first_won}) THEN 100 ELSE 200 END ELSE winner END AS winner, bad = 9 AS winner_inferred FROM vr WHERE reason IS NULL",
    "flatten_participants": BAD + f" SELECT c.match_id, puuid, CAST(team_id AS INT) AS team_id, CASE pos_idx {' '.join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES))} END AS position, champion_id, win = 1 AS win, kills, gold_earned, cs + 1 AS cs, dmg_champs, 0 AS turret_kills, pos_idx AS team_pos_idx FROM c JOIN vr USING (match_id) WHERE reason IS NULL",
    "extras_projection": BAD + f" SELECT match_id, puuid, {r6('damage_per_minute')} AS damage_per_minute, solo_kills, vision_per_min, CAST(NULL AS DOUBLE) AS multikills, win = 1 AS first_blood, CAST(NULL AS DOUBLE) AS dragon_takedowns FROM c JOIN vr USING (match_id) WHERE reason IS NULL",
    "participant_ids": BAD + " SELECT match_id, puuid FROM c JOIN vr USING (match_id) WHERE reason IS NULL",
    "parse_patches": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '15.' || CAST(event_id % 24 AS VARCHAR) WHEN 3 THEN '16.x' END AS patch, CASE event_id % 4 WHEN 0 THEN 15 ELSE 0 END AS major, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 24 ELSE 0 END AS INT) AS minor FROM events",
    "parse_targets": "SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'some name ' || event_type WHEN event_id % 4 = 1 THEN 'Name ' || event_type END AS name, CASE WHEN event_id % 8 = 0 THEN 't' || CAST(user_id AS VARCHAR) WHEN event_id % 4 = 1 THEN 'AB' || CAST(user_id % 1000 AS VARCHAR) END AS tag, CASE event_id % 8 WHEN 0 THEN 'euw1' END AS platform, 'anon:' || user_id || ':' || event_id AS anonymous FROM events",
    "time_split": SCORED + ", o AS (SELECT match_id, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n FROM sco) SELECT match_id, CASE WHEN i < n - greatest(1, floor(n * 0.2)) - greatest(1, floor(n * 0.1)) THEN 'train' WHEN i < n - greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'test' END AS part FROM o",
    "metrics_table": SCORED + f", q AS (SELECT y, p FROM sco), {AUC} SELECT count(*) AS n, {r6(f'avg(-(y * ln({_clip}) + (1 - y) * ln(1 - {_clip})))')} AS log_loss, {r6('avg((p - y) * (p - y))')} AS brier, {r6('avg(CASE WHEN CAST(p >= 0.5 AS INT) = y THEN 1.0 ELSE 0.0 END)')} AS accuracy, {r6('(SELECT auc FROM au)')} AS auc FROM q",
    "auc_rank": f"WITH q AS (SELECT quality AS y, n_chars / 100000 AS p FROM labels JOIN documents USING (doc_id)), {AUC} SELECT {r6('auc')} AS auc FROM au",
    "calibration_table": SCORED + f" SELECT bin, n, {r6('predicted')} AS predicted, {r6('actual')} AS actual, {r6('actual - predicted')} AS gap FROM ({CAL})",
    "ece": SCORED + f" SELECT {r6('sum(n * abs(actual - predicted)) / sum(n)')} AS ece FROM ({CAL})",
    "snapshot_champ_role": BASE + " SELECT patch, champion_id, pos_idx, count(*) AS games, CAST(sum(win) AS BIGINT) AS wins FROM c GROUP BY ALL",
    "snapshot_duration": BASE + f" SELECT champion_id, pos_idx, {', '.join(f'CAST(sum(CASE WHEN {w} THEN {v} ELSE 0 END) AS BIGINT) AS {k}' for k, w, v in (('sg', SHORT, '1'), ('sw', SHORT, 'win'), ('lg', LONG, '1'), ('lw', LONG, 'win')))} FROM c GROUP BY ALL",
    "snapshot_roles": BASE + f" SELECT champion_id, {', '.join(f'count(*) FILTER (WHERE pos_idx = {r}) AS role_{r}' for r in range(5))} FROM c GROUP BY champion_id",
    "snapshot_meta": BASE + " SELECT count(DISTINCT match_id) AS matches, arg_max(patch, seq) AS latest_patch, 1 AS version FROM c",
    "eligibility": BASE + " SELECT DISTINCT match_id, CASE WHEN match_id LIKE '%2' THEN 'platform=' WHEN match_seq % 5 = 0 THEN 'platform=KR' WHEN match_id LIKE '%4' THEN 'queue=0' WHEN match_seq % 7 = 0 THEN 'queue=400' WHEN match_seq % 9 = 0 THEN 'participants=8' WHEN match_seq % 11 = 0 THEN 'anonymous' END AS reason FROM c",
}
SQL["predict_one"] = SQL["predict_from_state"] = SQL["feature_matrix"] + " WHERE match_id = (SELECT max(match_id) FROM tf)"

SPLIT = SCORED + ", pt AS (SELECT DISTINCT match_id, patch FROM c), o AS (SELECT sco.*, patch, game_start, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n FROM sco JOIN pt USING (match_id) JOIN (SELECT DISTINCT match_id, game_start FROM c) USING (match_id)), sp AS (SELECT *, CASE WHEN i < n - greatest(1, floor(n * 0.2)) - greatest(1, floor(n * 0.1)) THEN 'train' WHEN i < n - greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'test' END AS part FROM o)"
ENTRIES = "WITH en AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS puuid, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS tier, CAST(c_nationkey AS INT) AS lp, CAST(c_custkey % 9 AS INT) AS wins, CAST(c_custkey % 8 AS INT) AS losses FROM customer)"
DC = EDGES + ", dc AS (SELECT match_id, state, count(ed.puuid) AS discovery_count FROM st LEFT JOIN ed USING (match_id) GROUP BY match_id, state)"
COVERAGE = f"{BASE}, n AS (SELECT *, count(*) OVER ({P}) AS games FROM c), cv AS (SELECT match_id, count(*) FILTER (WHERE team_id = 100 AND games >= 40) AS blue_coverage, count(*) FILTER (WHERE team_id = 200 AND games >= 40) AS red_coverage FROM n GROUP BY match_id)"
SQL |= {
    "joined_history": BAD + f", v AS (SELECT match_id, row_number() OVER (ORDER BY date_trunc('milliseconds', game_start), match_id) - 1 AS sq FROM vr WHERE reason IS NULL) SELECT c.match_id, puuid, sq AS seq, patch, duration_s, CAST(team_id AS INT) AS team_id, win, pos_idx, champion_id, CASE WHEN c.match_id NOT LIKE '%3' THEN {r6('damage_per_minute')} END AS damage_per_minute, CASE WHEN c.match_id NOT LIKE '%3' THEN solo_kills END AS solo_kills FROM c JOIN v ON c.match_id = v.match_id",
    "stored_inserts": BAD + ", x AS (SELECT c.* FROM c JOIN vr USING (match_id) WHERE reason IS NULL) SELECT count(*) AS n, count(DISTINCT match_id) AS matches, CAST(sum(kills) AS BIGINT) AS kills, count(*) FILTER (WHERE match_id NOT LIKE '%5') AS first, count(*) FILTER (WHERE match_id LIKE '%5') AS second, CAST(0 AS BIGINT) AS again FROM x",
    "unread": BASE + " SELECT DISTINCT match_id FROM c WHERE match_id NOT LIKE '%7' AND match_id NOT LIKE '%8'",
    "payload_lookup": BASE + ' SELECT match_id, CAST(420 AS BIGINT) AS "queueId", CAST(count(*) AS INT) AS n FROM c WHERE match_seq = 7 GROUP BY match_id',
    "gzip_payloads": BAD + " SELECT match_id, CAST(CASE WHEN match_id LIKE '%9' THEN NULL WHEN bad = 1 THEN 400 ELSE 420 END AS BIGINT) AS queue_id, CASE WHEN match_id LIKE '%9' THEN NULL WHEN bad = 2 THEN 9 ELSE 10 END AS n FROM vr",
    "pending_histogram": DC + " SELECT discovery_count, count(*) AS n FROM dc WHERE state = 'pending' GROUP BY 1",
    "pending_covered": DC + " SELECT match_id, discovery_count FROM dc WHERE state = 'pending' AND discovery_count >= 5",
    "next_by_coverage": DC + " SELECT match_id, discovery_count FROM dc WHERE state = 'pending' ORDER BY discovery_count DESC, match_id LIMIT 50",
    "resolved_matches": EDGES + " SELECT match_id, state FROM st WHERE state <> 'pending'",
    "added_players": ENTRIES + " SELECT puuid, tier, 'I' AS division, lp, 'seed' AS source, CAST(NULL AS INT) AS n_match_ids FROM en WHERE puuid <> ''",
    "rank_snapshots": ENTRIES + " SELECT puuid, 'SOLO' AS queue, tier, 'I' AS division, lp, wins, losses FROM en WHERE puuid <> '' AND tier <> ''",
    "marked_processed": ENTRIES + " SELECT puuid, CASE WHEN lp < 5 THEN lp END AS n_match_ids, lp < 5 AS done FROM en WHERE puuid <> ''",
    "extended_plan": EDGES + " SELECT m.match_id, CAST(CASE WHEN m.match_id % 4 = 0 THEN coalesce(n, 0) ELSE 0 END AS INT) AS priority FROM (SELECT DISTINCT match_id FROM ed WHERE match_id % 4 = 0 OR match_id % 3 = 0) m LEFT JOIN (SELECT match_id, count(*) AS n FROM ed SEMI JOIN kn USING (puuid) GROUP BY match_id) k ON m.match_id = k.match_id",
    "migrated_matches": EDGES + " SELECT match_id, CASE attempts WHEN 3 THEN 0 ELSE attempts END AS attempts, 0 AS discovery_count FROM st",
    "failure_counts": EDGES + ", f AS (SELECT DISTINCT l_orderkey AS match_id FROM lineitem WHERE l_returnflag = 'R') SELECT count(*) FILTER (WHERE attempts + 1 < 4) AS requeued, count(*) FILTER (WHERE attempts + 1 >= 4) AS dead FROM st JOIN f USING (match_id)",
    "drained_states": BAD + ", dr AS (SELECT *, CAST(match_seq % 4 AS INT) AS att, CASE WHEN match_seq % 17 = 0 THEN 'rejected' WHEN match_seq % 19 = 0 OR match_seq % 23 = 0 THEN 'error' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'stored' END AS got FROM vr) SELECT match_id, CASE WHEN got <> 'error' THEN got WHEN att = 3 THEN 'error' ELSE 'pending' END AS state, CASE WHEN match_seq % 17 = 0 THEN '404' WHEN match_seq % 19 = 0 THEN 'status=503' WHEN match_seq % 23 = 0 THEN 'parse' ELSE reason END AS reason, att + CAST(got = 'error' AS INT) AS attempts, got <> 'error' OR att = 3 AS done FROM dr",
    "post_counts": EDGES + " SELECT puuid, count(*) FILTER (WHERE match_id % 10 = 0) AS post FROM ed GROUP BY puuid",
    "greedy_topup": EDGES + f", {COVERED}, tg AS (SELECT DISTINCT puuid FROM ed JOIN pc USING (match_id) WHERE covered >= 2 AND covered = n), po AS (SELECT puuid, count(*) AS post FROM ed WHERE match_id % 10 = 0 GROUP BY puuid), nd AS (SELECT puuid, 100 - coalesce(post, 0) AS need FROM tg LEFT JOIN po USING (puuid) WHERE coalesce(post, 0) < 100), ca AS (SELECT match_id, puuid, count(*) OVER (PARTITION BY match_id) AS n FROM ed SEMI JOIN nd USING (puuid) WHERE match_id % 10 <> 0 AND match_id NOT IN (SELECT match_id FROM st WHERE state <> 'pending')), rk AS (SELECT match_id, puuid, row_number() OVER (PARTITION BY puuid ORDER BY n DESC, match_id) AS turn FROM ca) SELECT DISTINCT match_id FROM rk JOIN nd USING (puuid) WHERE turn <= need",
    "topup_candidates": EDGES + " SELECT match_id, CAST(count(*) AS INT) AS n, string_agg(CAST(puuid AS VARCHAR), ',' ORDER BY puuid) AS who FROM ed SEMI JOIN kn USING (puuid) WHERE match_id % 10 <> 0 AND match_id NOT IN (SELECT match_id FROM st WHERE state <> 'pending') GROUP BY match_id",
    "fully_processed": BASE + " SELECT match_id, puuid FROM c WHERE match_id IN (SELECT match_id FROM c GROUP BY match_id HAVING count(*) FILTER (WHERE CAST(substr(puuid, 3) AS INT) % 16 <> 3) = 10)",
    "players_history": BASE + " SELECT match_id, puuid FROM c WHERE match_seq <> n_seq - 1 AND match_id IN (SELECT match_id FROM c WHERE puuid IN (SELECT puuid FROM c WHERE match_seq = n_seq - 1))",
    "history_depth": BASE + " SELECT puuid, count(*) FILTER (WHERE match_seq % 50 = 0) AS games FROM c GROUP BY puuid",
    "missing_history": BASE + ", dp AS (SELECT puuid, count(*) FILTER (WHERE match_seq % 3 = 0) AS games FROM c GROUP BY puuid), nd AS (SELECT puuid, (SELECT max(games) FROM dp) + 5 - games AS need FROM dp), r AS (SELECT puuid, match_id, row_number() OVER (PARTITION BY puuid ORDER BY match_seq DESC, match_id) AS i FROM c WHERE match_seq % 3 <> 0) SELECT puuid, match_id FROM r JOIN nd USING (puuid) WHERE i <= need",
    "live_names": BASE + ", l AS (SELECT *, CAST(substr(puuid, 3) AS INT) % 7 AS k7, row_number() OVER (PARTITION BY match_seq ORDER BY puuid) - 1 AS i FROM c) SELECT 'EUW1_' || match_seq AS match_id, CASE WHEN k7 = 0 THEN 'anon:' || match_seq || ':' || i ELSE puuid END AS puuid, team_id, champion_id, CASE WHEN k7 = 0 THEN NULL WHEN k7 % 2 = 0 THEN 'n' || puuid ELSE 's' || puuid END AS name, k7 = 0 AS anonymous FROM l",
    "snapshot_role_traits": BASE + f" SELECT pos_idx, {', '.join(f'{r6(f"CAST(sum({t}) AS DOUBLE)")} AS sum_{t}, count({t}) AS count_{t}' for t in TRAITS)} FROM c GROUP BY pos_idx",
    "filter_coverage": COVERAGE + " SELECT * FROM cv WHERE blue_coverage >= 3 AND red_coverage >= 3",
    "feature_coverage": COVERAGE + " SELECT blue_coverage, count(*) AS n FROM cv GROUP BY 1 ORDER BY 1 LIMIT 12",
    "split_summary": SPLIT + f" SELECT part, count(*) AS n, min(game_start) AS first_start, max(game_start) AS last_start, {r6('avg(CAST(y AS DOUBLE))')} AS label_rate, string_agg(DISTINCT patch, ',' ORDER BY patch) AS patches FROM sp GROUP BY part",
    "constant_baseline": SPLIT + f", t AS (SELECT avg(CAST(y AS DOUBLE)) AS p FROM sp WHERE part = 'train'), q AS (SELECT y, t.p FROM sp, t WHERE part = 'test') SELECT count(*) AS n, {r6('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))')} AS log_loss, {r6('avg((p - y) * (p - y))')} AS brier, {r6('avg(CASE WHEN CAST(p >= 0.5 AS INT) = y THEN 1.0 ELSE 0.0 END)')} AS accuracy, CAST(0.5 AS DOUBLE) AS auc FROM q",
    "augmented_train": SPLIT + f" SELECT match_id, y AS blue_win, {r6('p')} AS d_p FROM sp WHERE part = 'train' UNION ALL SELECT match_id || '_swap', 1 - y, {r6('-p')} FROM sp WHERE part = 'train'",
    "aligned_features": SPLIT + f" SELECT match_id, patch, y AS blue_win, {r6('p')} AS d_p, CAST(NULL AS DOUBLE) AS d_other FROM sp",
}
SQL["predict_scored"] = f"SELECT match_id, round(1 / (1 + exp(-(0.1 + 0.7 * (d_winrate_mean - 0.01) / 0.2 - 0.4 * d_games_mean / 10.0))) + 3.17e-8, 4) + 0.0 AS p FROM ({SQL['predict_one']})"
SQL["explanation"] = SPLIT + f", {COVERAGE.removeprefix(BASE + ', ')}, f AS (SELECT match_id, unnest([{{'feature': 'd_p', 'effect': (p - 0.01) / 0.05 * 0.3}}, {{'feature': 'blue_coverage', 'effect': (blue_coverage - 2.5) / 1.5 * 0.2}}, {{'feature': 'red_coverage', 'effect': (red_coverage - 2.0) / 2.0 * -0.1}}]) AS e FROM sp JOIN cv USING (match_id)), k AS (SELECT match_id, e.feature AS feature, e.effect AS effect, row_number() OVER (PARTITION BY match_id ORDER BY abs(e.effect) DESC, e.feature DESC) AS i FROM f) SELECT match_id, CAST(i - 1 AS INT) AS rank, feature, round(effect + 3.17e-8, 4) + 0.0 AS effect, CASE WHEN effect > 0 THEN 'blue' ELSE 'red' END AS favours FROM k WHERE i <= 2"
SQL["snapshot_reloaded"] = SQL["snapshot_champ_role"]
