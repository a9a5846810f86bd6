import itertools
import random

import pytest
from pyspark.sql import functions as F

from podium.operators import association, careers, clustering, consensus, joins, neighbours, observation, quality, scenarios, scoring, similarity
from podium.sources import publish, tables
from podium.streaming import ingest


def test_exact_shares_tie_across_denominators(frame):
    events = frame("season int, event string, date date", *[(1, f"a{i}", "2001-01-01") for i in range(4)], *[(2, f"b{i}", "2002-01-01") for i in range(6)])
    wins = frame("entity int, season int, championship boolean", (1, 1, False), (1, 1, True), (2, 2, False), (2, 2, False), (2, 2, False), (3, 2, False))
    ctx = scoring.season_context(events)
    shares = scoring.opportunity_share(scoring.entity_season(wins, ctx), ctx)
    rows = {r["entity"]: r for r in scoring.leaderboard(shares).collect()}
    assert rows[1]["adjusted_rank"] == rows[2]["adjusted_rank"] == 1 and rows[3]["adjusted_rank"] == 3
    assert rows[1]["adjusted"] == pytest.approx(0.5 * 5)
    assert rows[1]["raw_rank"] == 2 and rows[1]["rank_change"] == 1


def test_context_counts_schedule_and_overrides(frame):
    events = frame("season int, event string, date date", (1, "a", "2001-01-01"), (1, "b", None), (2, "c", None))
    rows = scoring.season_context(events, overrides={1: 5}).collect()
    assert [(r["season"], r["held"], r["scheduled"], r["denom"]) for r in rows] == [(1, 1, 2, 5)]


def obs_rows(frame, rows):
    return frame("entity int, season int, event string, mode string, split string, team string, good int, bad int, won boolean, date date", *rows)


def test_stat_grains(frame):
    rows = [(1, 1, "e1", "S&D", "snd", "t", 9, 6, True, "2001-01-01"), (1, 1, "e1", "HP", "respawn", "t", 24, 20, None, "2001-01-02"),
            (1, 1, "e2", "HP", "respawn", "t", 2, 1, None, "2001-02-01"), (1, 1, "e1", "CTF", "respawn", "u", 18, 17, False, "2001-01-03")]
    got = {(r["grain"], r["event"], r["split"], r["mode"]): r for r in observation.stat_grains(obs_rows(frame, rows)).collect()}
    top = got[("overall", None, None, None)]
    assert (top["good"], top["bad"], top["maps"], top["ratio"], top["events"], top["teams"]) == (53, 44, 4, 1.205, 2, 2)
    assert got[("split", None, "snd", None)]["ratio"] == 1.5 and got[("split", None, "respawn", None)]["ratio"] == 1.158
    assert (got[("event", "e1", None, None)]["good"], got[("event", "e2", None, None)]["bad"]) == (51, 1)
    assert top["win_rate"] == 0.5


def test_stat_grains_expand_within_tasks_of_an_entity(frame):
    rows = [(1, 1, "e1", "HP", "respawn", None, 3, 2, True, "2001-01-01"), (1, 2, None, "HP", "respawn", "t", 4, 0, None, "2001-01-02"), (1, 2, "e2", "HP", None, "u", 5, 1, False, "2001-01-03")]
    df = observation.stat_grains(obs_rows(frame, rows))
    got = {(r["grain"], r["season"], r["event"], r["split"]): (r["good"], r["events"], r["teams"], r["wins"], r["losses"]) for r in df.collect()}
    assert got["overall", None, None, None] == (12, 2, 2, 1, 1) and got["season", 2, None, None] == (9, 1, 2, 0, 1)
    assert got["event", 2, None, None] == (4, 0, 1, 0, 0) and got["split", None, None, None] == (5, 1, 1, 0, 1) and len(got) == 15
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan and "Generate" in plan  # rows that multiply ahead of an exchange


def test_best_fact_needs_a_reviewed_decision(frame):
    facts = frame("entity string, event string, place_x2 int, team string", ("p", "e", 21, "A"), ("p", "e", 21, "B"), ("q", "e", 29, "A"), ("q", "e", 7, "C"))
    assert {r["entity"]: r["status"] for r in quality.best_fact(facts).collect()} == {"p": "conflict", "q": "single"}
    decided = frame("entity string, event string, chosen_team string, rationale string, evidence string, reviewed_at string", ("p", "e", "B", "why", "link", "2026-01-01"))
    rows = {r["entity"]: r for r in quality.best_fact(facts, decided).collect()}
    assert rows["p"]["team"] == "B" and rows["q"]["place_x2"] == 7
    with pytest.raises(quality.ConflictError):
        quality.fail_if_any(quality.best_fact(facts).where("status = 'conflict'"), "participation", "entity")


FIELDS = ("entity string, season string, event string, series string, mode string, map string, date string, team string, team_vs string, good int, bad int, stat_id string")


def test_observation_identity_ignores_row_order(frame):
    a = ("p", "s", "e", "1", "HP", "m", "2001-01-01", "A", "B", 38, 20, None)
    b = (*a[:9], 31, 20, None)
    one = {r["good"]: (r["occurrence"], r["observation_id"]) for r in quality.observation_id(frame(FIELDS, a, b)).collect()}
    two = {r["good"]: (r["occurrence"], r["observation_id"]) for r in quality.observation_id(frame(FIELDS, b, a)).collect()}
    assert one == two and sorted(v[0] for v in one.values()) == [1, 2] and one[38][1] != one[31][1]


def test_observation_conflicts(frame):
    a = ("p", "s", "e", "1", "HP", "m", "2001-01-01", "A", "B", 38, 20, None)
    b = (*a[:9], 38, 20, "7")
    c = (*a[:9], 31, 20, "7")
    kinds = {r["kind"] for r in quality.observation_conflicts(frame(FIELDS, a, a, b, c)).collect()}
    assert kinds == {"exact duplicate without an upstream id", "conflicting facts for an upstream id"}


def one_map(wrong_opponent=False):
    rows = [(i, "A", "B", g, 20, True) for i, g in enumerate((25, 24, 23, 22))] + [(i + 4, "B", "A", g, 20, False) for i, g in enumerate((20, 19, 18, 17))]
    if wrong_opponent:
        rows[0] = (0, "A", "C", 25, 20, True)
    return [("k", "HP", *r) for r in rows]


SCHEMA = "series string, mode string, entity int, team string, team_vs string, good int, bad int, won boolean"


def test_complete_map_and_team_totals(frame):
    obs = frame(SCHEMA, *one_map())
    assert quality.group_violations(obs, ["series"]).first()["reasons"] == ""
    rows = {r["team"]: r for r in association.team_maps(obs, ["series", "mode"]).collect()}
    assert (rows["A"]["good"], rows["A"]["opponent_good"], rows["A"]["difference"], rows["B"]["difference"]) == (94, 74, 20, -20)
    bad = quality.group_violations(frame(SCHEMA, *one_map(True)), ["series"])
    assert bad.first()["reasons"] == "opponent"


def test_conditional_rates(frame):
    obs = frame("entity int, season int, mode string, good int, bad int, won boolean", (1, 1, "HP", 30, 20, True), (1, 1, "HP", 22, 22, True),
                (1, 1, "HP", 25, 20, False), (1, 1, "HP", 18, 25, False), *[(2, 1, "HP", 20 + i, 20, True) for i in range(6)])
    rows = {r["entity"]: r for r in association.conditional_rates(obs).where("mode = 'all'").collect()}
    r = rows[1]
    assert (r["up_maps"], r["up_wins"], r["win_given_up"], r["up_given_win"], r["up_given_loss"], r["down_wins"]) == (2, 1, 0.5, 0.5, 0.5, 0)
    assert rows[2]["ratio_corr"] is None and rows[2]["corr_low"] is None and rows[2]["status"] == "unavailable — no outcome variation"


def test_role_intervals(frame):
    stints = frame("entity int, role string, start_season int, end_season int", (1, "SMG", 1, 2), (1, "AR", 3, None))
    keys = frame("entity int, season int", *[(1, s) for s in (1, 2, 3, 4)])
    got = [r["role"] for r in joins.role_by_season(keys, stints, 1, 4).orderBy("season").collect()]
    assert got == ["SMG", "SMG", "AR", "AR"]
    clash = frame("entity int, role string, start_season int, end_season int", (1, "SMG", 1, 3), (1, "AR", 2, None))
    assert "overlap" in joins.stint_violations(clash, keys, ["SMG", "AR"], 1, 4).first()["reasons"]


def test_shared_percentile(frame):
    long = frame("f string, v double, i int", ("x", 0.0, 1), ("x", 0.0, 2), ("x", 1.0, 3), ("x", 2.0, 4), ("x", None, 5))
    rows = {r["i"]: r["percentile"] for r in association.shared_percentile(long, ["f"], "v").collect()}
    assert rows[1] == rows[2] == pytest.approx(16.6667, abs=1e-3) and rows[4] == 100 and rows[5] is None


def test_prior_features_match_a_sequential_pass(spark):
    rng = random.Random(5)
    data = [(s, rng.randrange(6), f"2001-01-{rng.randrange(1, 9):02d}", f"e{rng.randrange(3)}", i, rng.choice(["snd", "respawn"]), rng.randrange(30), rng.randrange(1, 30))
            for s in (1, 2) for i in range(150)]
    df = spark.createDataFrame(data, "season int, entity int, date string, event string, series int, split string, good int, bad int")
    got = {(r["season"], r["series"]): (r["overall_maps"], r["split_maps"]) for r in
           association.prior_event_features(df, {"overall": 5, "respawn": 3, "snd": 2}).collect()}
    want, hist, pending, current = {}, {}, [], None
    for r in sorted(data, key=lambda r: (r[0], r[2], r[3], r[4])):
        if (r[0], r[3]) != current:
            for p in pending:
                for scope in ("overall", p[5]):
                    hist[(p[0], p[1], scope)] = hist.get((p[0], p[1], scope), 0) + 1
            pending, current = [], (r[0], r[3])
        o, s = hist.get((r[0], r[1], "overall"), 0), hist.get((r[0], r[1], r[5]), 0)
        o, s = (o if o >= 5 else None), (s if s >= {"respawn": 3, "snd": 2}[r[5]] else None)
        if o or s:
            want[(r[0], r[4])] = (o, s)
        pending.append(r)
    assert got == want and want


def test_ballot_weights_average_one(frame):
    ballots = frame("source_id string, ballot_id int, score int", *[("s", i, v) for i, v in enumerate((40, 10, 0, -5, -50, 3, 7, None))])
    total = consensus.ballot_weights(ballots).agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(8.0)


SPACE = similarity.space([(0.5, [("x", False)]), (0.3, [("y", False), ("z", False)]), (0.2, [("w", False)])])


def random_points(spark, n=90, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vec = [rng.choice([None, round(rng.gauss(0, 1), 2)]) if j else round(rng.gauss(0, 1), 2) for j in range(4)]
        if i % 4 == 0:
            vec = [0.5, 0.5, 0.5, 0.5]
        roles = {s: rng.choice(["AR", "SMG", "Flex"]) for s in range(3) if rng.random() < 0.6} or None
        rows.append((i, vec, roles if i % 8 else {1: "AR"}))
    return spark.createDataFrame(rows, "entity long, vec array<double>, roles map<int,string>"), rows


def brute_distance(a, b):
    shared = [j for j in range(4) if a[1][j] is not None and b[1][j] is not None]
    if not shared:
        return 1.0
    w = [f.weight for f in SPACE.features]
    base = sum(w[j] * min(abs(a[1][j] - b[1][j]) / 4, 1) for j in shared) / sum(w[j] for j in shared)
    common = set(a[2] or {}) & set(b[2] or {})
    if not common:
        return base
    step = lambda x, y: 0 if x == y else 0.5 if "Flex" in (x, y) else 1
    return 0.93 * base + 0.07 * sum(step(a[2][s], b[2][s]) for s in common) / len(common)


def test_nearest_is_exact_with_copies_and_missing_values(spark):
    df, rows = random_points(spark)
    got = {}
    for r in neighbours.nearest(df, SPACE, 4).collect():
        got.setdefault(r["entity"], []).append((r["position"], r["other"]))
    for a in rows:
        want = sorted((round(brute_distance(a, b), 9), b[0]) for b in rows if b[0] != a[0])[:4]
        assert [o for _, o in sorted(got[a[0]])] == [o for _, o in want]


def test_within_distance_is_exact(spark):
    df, rows = random_points(spark, 60, 2)
    got = {(r["a"], r["b"]) for r in neighbours.within_distance(df, SPACE, 0.2).collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if round(brute_distance(a, b), 9) <= 0.2}


def test_blocks_of_rows_are_never_broadcast(spark):
    df, _ = random_points(spark, 60, 2)
    for made in (neighbours.within_distance(df, SPACE, 0.2), neighbours.nearest(df, SPACE, 4)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [cell#" in plan and "BroadcastHashJoin [cell#" not in plan.split("SortMergeJoin [cell#")[0]


def test_pairs_within_distance_are_never_shuffled(spark, monkeypatch):
    """Pairs of members leave the task that finds them; copies and tiles of several boxes, and boxes of several tiles, lose none."""
    for name, value in (("TILE", 16), ("HELD", 4), ("STRIPE", 8), ("PAIRS", 32)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    df, rows = random_points(spark, 150, 5)
    made = neighbours.within_distance(df, SPACE, 0.2)
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan[:plan.index("MapInArrow")] and plan.count("offered#") > 0
    got = made.collect()
    found = {(r["a"], r["b"]): r["distance"] for r in got}
    want = {(a[0], b[0]): brute_distance(a, b) for a, b in itertools.combinations(rows, 2) if round(brute_distance(a, b), 9) <= 0.2}
    assert len(got) == len(found) and found == pytest.approx(want)


def test_a_join_sends_a_row_to_near_tiles_only(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(neighbours, "CELL", 8)
    routed = []
    route = neighbours._routed
    monkeypatch.setattr(neighbours, "_routed", lambda *a: routed.append(route(*a)) or routed[-1])
    rows = [(i, [10.0 * (i % 8) + i / 1000] * 4, None) for i in range(160)]
    df = spark.createDataFrame(rows, "entity long, vec array<double>, roles map<int,string>")
    assert neighbours.within_distance(df, SPACE, 0.1).count() == 8 * 190
    sent = [r["cells"] for r in routed[0].collect()]
    assert max(map(len, sent)) <= 4 and max(map(max, sent)) >= 9


def test_medoids_cannot_be_improved_by_a_swap(spark):
    df, rows = random_points(spark, 40, 3)
    labels = clustering.cluster(df, SPACE, 3).collect()
    medoids = {r["medoid"] for r in labels}
    by = {r[0]: r for r in rows}
    cost = lambda ms: sum(min(0.0 if m == r[0] else brute_distance(r, by[m]) for m in ms) for r in rows)
    best = cost(medoids)
    assert len(labels) == 40 and sum(r["distance"] for r in labels) == pytest.approx(best)
    assert all(cost((medoids - {m}) | {h}) >= best - 1e-9 for m in medoids for h in by)


def test_projection_keeps_plane_distances(spark):
    pts = [(i, [float(i % 5) / 5, float(i // 5) / 5, None, None], None) for i in range(25)]
    df = spark.createDataFrame(pts, "entity long, vec array<double>, roles map<int,string>")
    orient = df.select("entity", F.get("vec", F.lit(0)).alias("x_up"), F.lit(0.0).alias("y_down"))
    rows = clustering.project_2d(df, SPACE, orient).collect()
    assert len(rows) == 25 and max(abs(r["x"]) for r in rows) == pytest.approx(1.0) and max(abs(r["y"]) for r in rows) == pytest.approx(1.0)


def test_co_occurrence_collapses_copies(frame):
    rows = [(i, e) for i in range(6) for e in ("a", "b")] + [(10, "a"), (10, "c"), (11, "c")]
    got = {(r["set_id"], r["other_id"]): round(r["jaccard"], 4) for r in joins.co_occurrence(frame("entity int, event string", *rows), 0.15).collect()}
    assert got == {(0, 0): 1.0, (0, 10): 0.3333, (10, 11): 0.5}


def test_a_hot_event_makes_no_pairs_of_large_sets(spark):
    """A third of the sets hold one event: the pairs that only it could link are never made."""
    rng = random.Random(2)
    sets = {i: {f"own{i}x{j}" for j in range(6)} | {f"rare{rng.randrange(60)}"} | ({"hot"} if i % 3 == 0 else set()) for i in range(600)}
    sets |= {1000 + i: {"hot", f"one{i}"} for i in range(5)} | {2000: sets[0] | {"more"}, 2001: set(sets[1])}
    df = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "entity long, event string")
    one = joins.event_sets(df).groupBy("set_id").agg(F.first("events").alias("events")).withColumn("size", F.size("events"))
    hot = sum("hot" in s for s in sets.values())
    made = joins.set_candidates(one, 0.15).count()
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both / len(sets[a] | sets[b]) > 0.15:
            want[a, b] = both / len(sets[a] | sets[b])
    got = {(r["set_id"], r["other_id"]): r["jaccard"] for r in joins.co_occurrence(df, 0.15).collect()}
    assert got.pop((1, 1)) == 1.0 and want.pop((1, 2001)) == 1.0 and all(got[p] == pytest.approx(j) for p, j in want.items() if 2001 not in p)
    assert set(got) == {p for p in want if 2001 not in p} and made < 2 * len(want) + 600 < hot * hot / 8


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scenarios_match_full_rerank(spark, seed):
    rng = random.Random(seed)
    shares = [(i, rng.randrange(0, 60) * 10, rng.choice([0, 1, 2, 3, 4])) for i in range(60)]
    roster = [(t, e) for t, e in zip([rng.choice("ABC") for _ in range(25)], rng.sample(range(70), 25))]
    delta = 90
    sdf = spark.createDataFrame(shares, "entity int, numer int, wins int")
    moves = scenarios.scenario_moves(spark.createDataFrame(roster, "team string, entity int"), sdf, delta)
    ranks = {(r["team"], r["entity"]): (r["rank_before"], r["rank_after"]) for r in scenarios.scenario_ranks(moves, sdf).collect()}
    drops = {}
    for r in scenarios.scenario_drops(moves, sdf).collect():
        drops.setdefault(r["team"], []).append((r["position"], r["entity"], r["rank_delta"]))
    listed = {e: n for e, n, w in shares if w >= 2}
    info = {e: (n, w) for e, n, w in shares}
    before = {e: 1 + sum(v > n for v in listed.values()) for e, n in listed.items()}
    for team in {t for t, _ in roster}:
        mine = [e for t, e in roster if t == team]
        board = dict(listed)
        for e in mine:
            n, w = info.get(e, (0, 0))
            if w >= 1:
                board[e] = n + delta
        after = {e: 1 + sum(v > x for v in board.values()) for e, x in board.items()}
        for e in mine:
            assert ranks[(team, e)] == (before.get(e), after.get(e))
        lost = sorted((before[e] - after[e], before[e], e) for e in listed if e not in mine and after[e] > before[e])[:2]
        assert [(e, d) for _, e, d in sorted(drops.get(team, []))] == [(e, d) for d, _, e in lost]


def test_path_features_keep_the_busier_identity(frame):
    rows = frame("entity int, handle string, event string, date date, team string, place int", (1, "h", "a", "2001-01-01", "T", 1), (1, "h", "b", "2001-02-01", "U", 4),
                 (2, "h", "a", "2001-01-01", "V", 9))
    r = careers.path_features(rows).first()
    assert (r["entity"], r["attendances"], r["distinct_teams"], r["avg_tenure"], r["finals_rate"], r["deep_rate"], r["win_rate"], r["best_place"]) == (1, 2, 2, 1.0, 0.5, 1.0, 0.5, 1)


def test_failed_check_publishes_nothing(spark, frame, tmp_path):
    good = frame("v int", (1,))
    root = str(tmp_path / "out")
    publish.publish_if_valid({"t": good}, root, {})
    with pytest.raises(publish.PublishError):
        publish.publish_if_valid({"t": frame("v int", (2,))}, root, {"no twos": lambda f: f["t"].where("v = 2")})
    assert [r["v"] for r in publish.read_current(spark, root, "t").collect()] == [1]


def test_ingest_resumes_and_quarantines(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(10).select("id", F.when(F.col("id") != 3, F.col("id")).alias("v"))
    df.where("id < 6").coalesce(1).write.parquet(f"{root}/in/a")
    args = (spark, f"{root}/in/*", df.schema, f"{root}/out", f"{root}/cp", ["id"], "v IS NOT NULL")
    ingest.incremental_ingest(*args)
    df.where("id >= 4").coalesce(1).write.parquet(f"{root}/in/b")
    ingest.incremental_ingest(*args)
    ingest.incremental_ingest(*args)
    assert sorted(r["id"] for r in ingest.landed(spark, f"{root}/out", df.schema).collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    progress = ingest.ingest_progress(spark, f"{root}/out").collect()
    assert sorted((r["rows"], r["rejected"]) for r in progress) == [(6, 0), (6, 1)]


def test_ingest_reads_only_new_files_and_looks_keys_up(spark, tmp_path):
    """Keys of earlier batches are found in the state, though the rows that landed are gone."""
    import shutil
    root, df = str(tmp_path), spark.range(20).select("id", F.lit("x").alias("v"))
    df.where("id < 10").coalesce(1).write.parquet(f"{root}/in/a")
    args = (spark, f"{root}/in/*", df.schema, f"{root}/out", f"{root}/cp", ["id"], "v IS NOT NULL")
    ingest.incremental_ingest(*args)
    assert ingest.landed(spark, f"{root}/out", df.schema).count() == 10
    shutil.rmtree(f"{root}/out/rows")
    df.where("id >= 5").union(df.where("id > 17")).coalesce(1).write.parquet(f"{root}/in/b")
    ingest.incremental_ingest(*args)
    assert sorted(r["id"] for r in ingest.landed(spark, f"{root}/out", df.schema).collect()) == list(range(10, 20))
    assert spark.conf.get(ingest.STORE, None) != ingest.ROCKS


def test_as_of_sums_of_a_hot_entity(spark):
    """Many claims on an entity of many facts, under all kinds of lists, against brute force; rows lined up are days and claims."""
    rng = random.Random(4)
    day = lambda d: None if d is None else f"2001-01-{d:02d}"
    facts = [(rng.choice([1, 1, 1, 2, None]), rng.choice([1, 2, 3, None]), rng.choice("ab"), rng.choice("xyz"), rng.choice([None, *range(1, 29)]), rng.randint(0, 9)) for _ in range(800)]
    some = lambda values: rng.choice([None, [], [rng.choice(values)], [*values[:2], values[0]]])
    claims = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(1, 29)]), some([1, 2, 3]), some(["a", "b"]), some(["x", "y", "z"])) for i in range(300)]
    f = spark.createDataFrame([(e, s, v, m, day(d), g) for e, s, v, m, d, g in facts], "entity int, season int, event string, mode string, date string, good int")
    c = spark.createDataFrame([(i, e, day(d), *x) for i, e, d, *x in claims], "id int, entity int, as_of string, seasons array<int>, events array<string>, modes array<string>")
    got = quality.as_of_sums(c, f.withColumn("date", F.col("date").cast("date")), {"seasons": "season", "events": "event", "modes": "mode"}, ["good"])
    allowed = lambda values, v: values is None or v in [x for x in values if x is not None]
    want = {i: float(sum(g for fe, s, v, m, fd, g in facts if e is not None and fe == e and d is not None and (fd or 0) <= d
                         and allowed(ss, s) and allowed(vs, v) and allowed(ms, m))) for i, e, d, ss, vs, ms in claims}
    assert {r["id"]: r["good"] for r in got.collect()} == want


def test_merge_treats_null_and_blank_alike(frame):
    base = frame("k string, v string", ("a", None))
    batch = frame("k string, v string", ("a", ""), ("b", "x"), ("b", "x"))
    assert sorted((r["k"], r["v"]) for r in tables.merge_new(base, batch, ["k", "v"]).collect() if r["k"] == "b") == [("b", "x")]
    assert tables.merge_new(base, batch, ["k", "v"]).count() == 2


def test_slim_drops_rows_without_numbers(frame):
    raw = frame("id string, extra string, good string, bad string", ("1", "x", "24", "20"), ("2", "x", "", "3"), ("3", "x", "9", " "))
    rows = tables.slim_observations(raw, ["id"]).collect()
    assert [tuple(r) for r in rows] == [("1", 24, 20)]


def test_fingerprint_tells_rows_apart(spark, frame):
    from podium.sources.publish import fingerprint
    tables = [frame("a string, b string", r) for r in [("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), (" ", "c"), ("1:c", ""), ("", "1:c")]]
    digests = [fingerprint(t, "x").first()["digest"] for t in tables]
    assert len(set(digests)) == len(digests)


def test_merge_new_is_stable_under_repartition(spark, frame):
    from podium.sources.tables import merge_new
    base, batch = frame("k long, v string", (1, "old")), frame("k long, v string", (1, "new"), (2, "b"), (2, "a"), (2, "c"), (None, "n"), (None, "m"))
    got = [sorted(map(tuple, merge_new(base, batch.repartition(n), ["k"]).collect()), key=repr) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] == sorted([(1, "old"), (2, "a"), (None, "m")], key=repr)


def test_next_event_prefers_one_without_a_winner(frame):
    from podium.operators.scenarios import next_event
    calendar = frame("season int, month int, event string, date string", (2001, 1, "a", "2001-01-05"), (2001, 2, "b", None), (2001, 3, "c", None))
    assert [tuple(r) for r in next_event(calendar).collect()] == [(2001, 2, "b")]
    assert [tuple(r) for r in next_event(calendar, frame("event string", ("b",))).collect()] == [(2001, 3, "c")]
    assert [tuple(r) for r in next_event(calendar, frame("event string", ("b",), ("c",))).collect()] == [(2001, 2, "b")]
    assert next_event(calendar.where("date IS NOT NULL")).count() == 0


def test_selection_carries_placements(frame):
    from podium.operators import scoring
    context = frame("season int, denom int, held int, idx int, pre_epoch boolean", (2000, 4, 4, 0, False), (2001, 2, 2, 1, False))
    seasons = frame("entity int, season int, wins bigint, titles bigint", (1, 2000, 2, 1), (1, 2001, 1, 0), (2, 2001, 1, 1))
    picked = frame("selection_id string, season int", ("all", 2000), ("all", 2001), ("late", 2001))
    placed = frame("entity int, season int, place_x2 bigint", (1, 2000, 2), (1, 2000, 5), (1, 2001, 2), (2, 2001, 2))
    got = {(r["selection_id"], r["entity"]): r for r in scoring.recompute_for_selection(seasons, context, picked, 4, placements=placed).collect()}
    assert (got["all", 1]["first_season"], got["all", 1]["last_season"], got["all", 1]["events"], got["all", 1]["average_place"], got["all", 1]["conversion"]) == (2000, 2001, 3, 1.5, 1.0)
    assert got["late", 2]["average_place"] == 1.0 and got["late", 1]["events"] == 1


def test_teams_without_a_board_do_not_appear(frame):
    shares = frame("entity int, numer long, wins int", (1, 10, 1), (2, 10, 1))
    moves = scenarios.scenario_moves(frame("team string, entity int", ("A", 1), ("B", 3)), shares, 5)
    assert [tuple(r) for r in scenarios.teams_that_move(moves, shares).collect()] == [("A", False, 1)]
    listed = shares.unionByName(frame("entity int, numer long, wins int", (4, 30, 2)))
    moves = scenarios.scenario_moves(frame("team string, entity int", ("A", 1), ("B", 3)), listed, 25)
    assert sorted(tuple(r) for r in scenarios.teams_that_move(moves, listed).collect()) == [("A", True, 1), ("B", False, 0)]


def test_only_contents_that_share_base_fields_are_ranked(spark, frame, distributed, monkeypatch):
    ranked = []
    plain = quality.prefix_counts
    monkeypatch.setattr(quality, "prefix_counts", lambda df, *a, **k: ranked.append(df.count()) or plain(df, *a, **k))
    base = ("E", "e", 2000, "R", "2000-01-01", "1", "2", "m")
    rows = [(*base, 1, g, 0, None) for g in (7, 5, 5)] + [(*base, s, 1, 0, None) for s in range(2, 9)]
    df = frame("entity string, event string, season int, mode string, date string, team string, team_vs string, map string, series int, good int, bad int, stat_id string", *rows)
    got = sorted((r["series"], r["good"], r["occurrence"]) for r in quality.observation_id(df).collect())
    assert got == [(1, 5, 1), (1, 5, 1), (1, 7, 2)] + [(s, 1, 1) for s in range(2, 9)] and ranked == [2]
