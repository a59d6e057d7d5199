"""The HTTP source, the ladder, and the collecting loops on stored tables."""

import json
import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tenfold.functions.scalars import parse_limits, parse_patch_floor, parse_target
from tenfold.operators import crawl, frontier, graph
from tenfold.plans import collecting, predict
from tenfold.schemas import ROLES, TABLES
from tenfold.sources import commits, http, tables
from tenfold.sources.fixtures import edges, states
from tenfold.sources.tables import payload_of, read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def service():
    """A service on this machine; what it was asked is counted."""
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            path = self.path.split("?")[0]
            status, body = 200, None
            if path.endswith("/flaky"):
                status, body = (503, None) if asked[self.path] < 3 else (200, {"ok": 1})
            elif path.endswith("/down"):
                status = 500
            elif path.endswith("/forbidden"):
                status = 403
            elif path.startswith("/lol/match/v5/matches/by-puuid/"):
                body = ["M_1", "M_2"] if "p1" in path else []
            elif "challengerleagues" in path:
                body = {"entries": [{"puuid": "top", "leaguePoints": 900}, {"puuid": "own", "tier": "OTHER", "rank": "II"}]}
            elif "/entries/" in path:
                page = int(self.path.rpartition("=")[2])
                body = [{"puuid": f"{path.split('/')[-1]}{page}", "tier": "GOLD", "rank": path.split("/")[-1]}] if page <= (2 if path.endswith("/I") else 1) else []
            else:
                status = 404
            self.send_response(status)
            if status == 503:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(json.dumps(body).encode() if body is not None else b"")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_fetched(spark, service):
    base, asked = service
    get = lambda df: http.fetched(df, base, per_second=1000, lanes=2, wait=0.01)
    rows = spark.createDataFrame([("/flaky",), ("/down",), ("/nothing",)], "path string")
    got = {r.path: (r.status, r.body) for r in get(rows).collect()}
    assert got == {"/flaky": (200, '{"ok": 1}'), "/down": (500, None), "/nothing": (404, None)} and asked["/flaky"] == 3 and asked["/down"] == 4
    with pytest.raises(Exception, match="403"):
        get(spark.createDataFrame([("/forbidden",)], "path string")).collect()
    players = spark.createDataFrame([("p1",), ("p 2",)], "puuid string").withColumn("path", http.match_ids_path(420, count=500))
    assert {r.path for r in players.collect()} == {f"/lol/match/v5/matches/by-puuid/{p}/ids?start=0&count=100&queue=420" for p in ("p1", "p%202")}
    assert sorted(tuple(r) for r in http.ids_in(get(players)).collect()) == [("p1", "M_1"), ("p1", "M_2")]


def test_ladder_stops_at_empty_pages(spark, service):
    base, asked = service
    get = lambda df: http.fetched(df, base, per_second=1000, wait=0.01)
    got = {(r.puuid, r.tier, r.rank) for r in http.ladder_entries(spark, get, ["challenger", "gold"], ["I", "II"], 5).collect()}
    assert got == {("top", "CHALLENGER", "I"), ("own", "OTHER", "II"), ("I1", "GOLD", "I"), ("I2", "GOLD", "I"), ("II1", "GOLD", "II")}
    assert asked["/lol/league/v4/entries/RANKED_SOLO_5x5/GOLD/I?page=3"] == 1 and not any("page=4" in p for p in asked)


def payload(match: int, players: list[str], queue: int = 420) -> str:
    people = [{"puuid": p, "teamId": 100 + 100 * (i // 5), "teamPosition": ROLES[i % 5], "championId": i, "win": i < 5, "kills": match, "challenges": {"soloKills": i}} for i, p in enumerate(players)]
    return json.dumps({"info": {"queueId": queue, "gameDuration": 1800, "gameVersion": "16.1.1", "gameStartTimestamp": 1_700_000_000_000 + match, "platformId": "EUW1", "teams": [{"teamId": 100, "win": True}], "participants": people}})


@pytest.fixture
def store(spark, tmp_path):
    return crawl.Store(spark, f"file://{tmp_path}", F.lit("2026-01-01").cast("timestamp_ntz"))


def source(spark, flaky=()):
    """12 matches of 10 out of 15 players; match 3 is of another queue, match 4 is not found, those in ``flaky`` fail once."""
    who = {m: [f"p{(m + i) % 15}" for i in range(10)] for m in range(12)}
    failed = Counter()

    def match_ids(players):
        rows = [(r.puuid, None if r.puuid == "p14" else [f"M{m}" for m in who if r.puuid in who[m]]) for r in players.collect()]
        return spark.createDataFrame(rows, "puuid string, ids array<string>")

    def fetch(ids):
        rows = []
        for r in ids.collect():
            m = int(r.match_id[1:])
            failed[m] += 1
            bad = m in flaky and failed[m] == 1
            rows.append((r.match_id, 404 if m == 4 else 503 if bad else 200, None if m == 4 or bad else payload(m, who[m], 400 if m == 3 else 420)))
        return spark.createDataFrame(rows, "match_id string, status int, payload string")

    return match_ids, fetch


def seeded(spark, store, *players):
    rows = [(p, None, "GOLD", "I", 10, 1, 2) for p in players] + [(None, "s", "GOLD", "I", 1, 1, 1)]
    return store.seed(spark.createDataFrame(rows, http.ENTRY))


def test_seed_entries_without_a_puuid_are_asked_for(spark, store):
    rows = [(None, "s1", "GOLD", "I", 10, 1, 2), (None, "s1", "GOLD", "I", 10, 1, 2), (None, "s2", "GOLD", "I", 1, 1, 1), ("p3", "s3", "GOLD", "I", 1, 1, 1), (None, None, "GOLD", "I", 1, 1, 1)]
    asked = []

    def summoners(ids):
        asked.extend(sorted(r.summonerId for r in ids.collect()))
        answers = spark.createDataFrame([("s1", 200, '{"puuid": "p1"}'), ("s2", 404, None)], "summoner_id string, status int, body string")
        return http.summoners_in(answers)

    assert store.seed(spark.createDataFrame(rows, http.ENTRY), summoners=summoners) == 2 and asked == ["s1", "s2"]
    assert {r.puuid for r in store.read("crawl_players").collect()} == {"p1", "p3"} == {r.puuid for r in store.read("player_ranks").collect()}


def test_crawl_stores_all_that_can_be_reached(spark, store):
    match_ids, fetch = source(spark, flaky=(7,))
    assert seeded(spark, store, "p0") == 1 and seeded(spark, store, "p0") == 0
    assert store.crawl(100, match_ids, fetch, low_water=5, players=5, batch=6) == 10
    got = {r.match_id: (r.state, r.reason, r.attempts) for r in store.read("crawl_matches").collect()}
    assert {k for k, v in got.items() if v[0] == "stored"} == {f"M{m}" for m in range(12) if m not in (3, 4)}
    assert got["M3"][:2] == ("rejected", "queue=400") and got["M4"][:2] == ("rejected", "404") and got["M7"][2] == 1
    assert store.read("participants").count() == 100 and store.read("matches").count() == 10
    people = {r.puuid: r for r in store.read("crawl_players").collect()}
    assert len(people) == 15 and people["p14"].processed_at is None and people["p0"].n_match_ids == 7 and people["p1"].source == "snowball"
    assert store.add_extras() == 100 and store.add_extras() == 0 and store.add_extras(only_missing=False) == 0
    assert store.read("participant_extras").where("solo_kills = 9").count() == 10
    assert payload_of(store.read("raw_matches"), "M1").count() == 1 and store.crawl(5, match_ids, fetch) == 0


def test_discover_then_densify(spark, store):
    match_ids, fetch = source(spark)
    seeded(spark, store, *[f"p{i}" for i in range(6)])
    assert store.discover(100, match_ids, players=4) == (6, 12)
    counts = {r.match_id: r.discovery_count for r in store.read("crawl_matches").collect()}
    assert counts["M0"] == 6 and counts["M6"] == sum(f"p{i}" in [f"p{(6 + j) % 15}" for j in range(10)] for i in range(6))
    assert store.densify(100, fetch, least=6, enqueue=False)[1] == len([m for m, n in counts.items() if n >= 6 and m not in ("M3", "M4")])
    assert store.read("crawl_players").count() == 6
    store.put("crawl_plan", frontier.set_plan(spark.createDataFrame([("M5",), ("M9",)], "match_id string")))
    assert store.densify(1, fetch, use_plan=True, enqueue=False) == (1, 1)
    dead = store.read("crawl_matches").where("match_id = 'M8'")
    for _ in range(4):
        dead = frontier.after_failures(dead, dead, F.lit("2026-01-01").cast("timestamp_ntz"))
    assert dead.first().state == "error" and frontier.requeued(dead).first().state == "pending"


def test_unread_payloads_are_not_moved(spark):
    """Only ids are shuffled; with many missing ids the payloads are joined, with the same rows."""
    raw = spark.createDataFrame([(f"m{i}", "x" * 100) for i in range(50)] + [(None, "y")], "match_id string, payload string")
    extras = spark.createDataFrame([(f"m{i}", f"p{k}") for i in range(0, 50, 2) for k in range(3)] + [(None, "p")], "match_id string, puuid string")
    few = tables.unread_payloads(raw, extras)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    want = sorted(f"m{i}" for i in range(1, 50, 2))
    assert sorted(r.match_id for r in few.collect()) == want == sorted(r.match_id for r in tables.unread_payloads(raw, extras, most=3).collect())
    assert tables.unread_payloads(raw, extras, only_missing=False).count() == 51


def test_tables_never_written_are_empty(spark, store):
    assert store.read("matches").count() == 0 and store.read("crawl_players").count() == 0
    assert read_table(spark, store.folder, "crawl_plan").columns == ["match_id", "priority"]


def test_a_run_cut_off_between_two_tables_reads_as_before(spark, store, monkeypatch):
    match_ids, fetch = source(spark)
    seeded(spark, store, "p0", "p1")
    store.expand(1, match_ids)
    before = {name: sorted(map(str, store.read(name).collect())) for name in TABLES}

    def killed(self, name, rows, real=crawl.Store.put):
        if name == "crawl_matches":
            raise KeyboardInterrupt
        return real(self, name, rows)

    with monkeypatch.context() as m:
        m.setattr(crawl.Store, "put", killed)
        with pytest.raises(KeyboardInterrupt):
            store.drain(3, fetch)
    assert {name: sorted(map(str, store.read(name).collect())) for name in TABLES} == before
    again = crawl.Store(spark, store.folder, store.now)
    assert again.drain(3, fetch)[0] == 3 and again.read("matches").count() == again.read("crawl_matches").where("state = 'stored'").count() > 0


def test_folders_stay_few(spark, store, tmp_path, monkeypatch):
    """Thirty changes of the same keys: few folders, few rows in the log, no file that does not count but those of the last merge."""
    monkeypatch.setattr(commits, "MERGE", 4)
    for k in range(30):
        store.put("crawl_plan", spark.createDataFrame([("A", k), ("B", -k), (f"own{k}", 1)], "match_id string, priority int"))
    got = {r.match_id: r.priority for r in store.read("crawl_plan").collect()}
    assert got == {"A": 29, "B": -29} | {f"own{k}": 1 for k in range(30)}
    folders = store.tables.folders("crawl_plan")
    assert len(folders) <= 3 * 3 and store.log("crawl_plan").count() <= 30 + 2 * len(folders)
    on_disk = {p.name for p in (tmp_path / "crawl_plan").iterdir()}
    assert {f.rsplit("/", 1)[1] for f in folders} <= on_disk and len(on_disk) <= len(folders) + 8 and len(list((tmp_path / "_commits").glob("*.json"))) <= 3
    other = commits.Tables(spark, store.folder)
    with pytest.raises(RuntimeError, match="another writer"):
        other._put({"number": store.tables.manifest()["number"], "tables": {}, "dropped": []})


def test_a_lookup_reads_one_row_group(spark, store, monkeypatch):
    """Ids spread over all folders: bloom filters leave one file, before folders are merged and after."""

    def scanned(match_id):
        found = payload_of(store.read("raw_matches"), match_id)
        got = found.collect()
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return len(got), scan.metrics().apply("numOutputRows").value()

    monkeypatch.setattr(commits, "MERGE", 5)
    for k in range(9):
        rows = spark.createDataFrame([(f"M{i:04}", "16.1", "x" * 50) for i in range(k, 900, 9)], "match_id string, patch string, payload string").coalesce(1)
        store.insert("raw_matches", rows.withColumn("fetched_at", store.now))
        if k == 3:
            assert len(store.tables.folders("raw_matches")) == 4 and scanned("M0002") == (1, 100) and scanned("M0450") == (1, 100)
    assert len(store.tables.folders("raw_matches")) == 5
    assert scanned("M0002") == (1, 500) and scanned("M0008") == (1, 100) and scanned("nothing")[0] == 0


def test_top_up_for_serving(spark, store):
    """Players short of games are asked for, valid answers stored and read back; hidden ones and full ones are not asked."""
    match_ids, fetch = source(spark)
    asked = []

    def listing(players):
        asked.extend(sorted(r.puuid for r in players.collect()))
        return match_ids(players)

    live = spark.createDataFrame([("p0",), ("p1",), ("anon:7:1",), (None,)], "puuid string")
    # p0 lists M0, M6 to M11, p1 lists M0, M1, M7 to M11: the first three of each
    assert store.top_up(live, 3, listing, fetch) == 4 and asked == ["p0", "p1"]
    history = store.history(live)
    assert {r.match_id for r in history.select("match_id").distinct().collect()} == {"M0", "M1", "M6", "M7"}
    assert history.count() == 40 and history.where("solo_kills IS NULL").count() == 0 and history.where("puuid = 'p0'").count() >= 3
    assert store.top_up(live, 3, listing, fetch) == 0 and store.top_up(spark.createDataFrame([("p14",)], "puuid string"), 99, match_ids, fetch) == 0


def greedy(candidates, need):
    """The scan as it is defined: matches in order, each taken that still serves a player in need."""
    need, chosen = dict(need), []
    for match, who in candidates:
        if served := [p for p in who if need.get(p)]:
            chosen.append(match)
            for p in served:
                need[p] -= 1
    return chosen


def test_greedy_top_up_against_a_plain_twin(spark):
    e = edges(spark, SF)
    plan, targets = frontier.set_plan(e.where("match_id % 10 = 0")), frontier.fully_covered(e, collecting.catalog._known(spark, SF), 2)
    resolved = {r.match_id for r in frontier.resolved(states(spark, SF)).collect()}
    of = {}
    for r in e.collect():
        of.setdefault(r.match_id, set()).add(r.puuid)
    planned = {r.match_id for r in plan.collect()}
    post = Counter(p for m in planned for p in of[m])
    need = {p: 100 - post[p] for p in {r.puuid for r in targets.collect()} if post[p] < 100}
    order = sorted(((-len(of[m] & set(need)), m) for m in of if m not in planned | resolved and of[m] & set(need)))
    want = greedy([(m, of[m]) for _, m in order], need)
    assert sorted(r.match_id for r in graph.top_up(e, plan, frontier.resolved(states(spark, SF)), targets, games=100).collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(6))
def test_greedy_top_up_of_random_graphs(spark, seed):
    """One player in most matches, needs of every size, players in no candidate, matches planned or resolved, coverage asked for."""
    draw = random.Random(seed)
    games, least = draw.choice([1, 3, 6]), draw.choice([0, 0, 2])
    of = {f"m{m:02}": {p for p in range(12) if draw.random() < (0.8 if p == 0 else 0.25)} for m in range(60)}
    planned, resolved = {m for m in of if draw.random() < 0.15}, {m for m in of if draw.random() < 0.1}
    targets = [(m, p) for m in of if draw.random() < 0.4 for p in of[m]] + [("other", 99)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    edge_rows, ids = frame([(m, p) for m, who in of.items() for p in who], "match_id string, puuid long"), lambda x: frame([(m,) for m in x], "match_id string")
    post = Counter(p for m in planned for p in of[m])
    ok = Counter(m for m, p in targets if post[p] >= games)
    need = {p: games - post[p] for m, p in targets if ok[m] >= least and post[p] < games}
    order = sorted((-len(of[m] & set(need)), m) for m in of if m not in planned | resolved and of[m] & set(need))
    got = graph.top_up(edge_rows, ids(planned), ids(resolved), frame(targets, "match_id string, puuid long"), least, games)
    assert sorted(r.match_id for r in got.collect()) == sorted(greedy([(m, of[m]) for _, m in order], need))


def test_top_up_sends_on_a_players_first_matches_only(spark):
    e = edges(spark, SF)
    got = graph.top_up(e, frontier.set_plan(e.where("match_id % 10 = 0")), e.where("match_id % 10 = 1").select("match_id"), e, games=5)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_core_of_a_long_chain(spark):
    """Peeling takes as many rounds as the chain is long."""
    chain = [(f"m{i}", f"p{j}") for i in range(30) for j in (i, i + 1)]
    got = graph.k_core(spark.createDataFrame([*chain, ("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")], "match_id string, puuid string"), 2, 2)
    assert {r.match_id for r in got.collect()} == {"x", "y"}


def test_small_parsers(spark):
    assert parse_limits("20:1, 100:120,") == [(20, 1), (100, 120)] and parse_patch_floor(" 15.3") == (15, 3) and parse_patch_floor("15") == (15, 0) and parse_patch_floor("x.1") == (0, 0) == parse_patch_floor("")
    links = ["https://U.gg/lol/profile/euw1/a+b-c1/overview", "https://other.example/lol/profile/euw1/a-b/", "Name #AB1"]
    got = [tuple(r.t) for r in spark.createDataFrame([(x,) for x in links], "s string").select(parse_target(F.col("s")).alias("t")).collect()]
    assert got == [("a b", "c1", "euw1"), (None, None, None), ("Name", "AB1", None)]


def test_seeded_claim_is_a_fixed_shuffle(spark):
    queue = spark.createDataFrame([(f"p{i}", None, i) for i in range(50)], "puuid string, processed_at timestamp, discovered_at int")
    a, b, c = ([r.puuid for r in frontier.claim(queue, 10, s).collect()] for s in (1, 1, 2))
    assert a == b and a != c and len(set(a)) == 10


def test_hidden_live_players(spark):
    game = spark.createDataFrame([(7, "euw1", [("p1", 3, 100, "one#1", None), (None, 4, 200, "champ", "x")])], "game_id long, platform string, participants array<struct<puuid: string, championId: int, teamId: int, riotId: string, summonerName: string>>")
    assert [(r.match_id, r.puuid, r.name, r.anonymous) for r in predict.live_players(game).collect()] == [("EUW1_7", "p1", "one#1", False), ("EUW1_7", "anon:7:1", None, True)]
