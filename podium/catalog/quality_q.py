"""Queries for source quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import split_of
from ..operators import quality
from ..plans import pin
from . import functions_q as fq
from . import proxies as px
from .registry import Tables, cte, query

MAP_KEY = ["season", "event", "series", "mode", "map", "date"]


def pages(t: Tables):
    """Event pages with ids; some names carry two ids and some ids two names."""
    p = px.played(t)
    one = p.select("season", "event", F.concat(F.lit("E/"), "event").alias("event_id"))
    two = p.where("month = 5").select("season", "event", F.concat(F.lit("X/"), "event").alias("event_id"))
    three = p.where("month = 7").select("season", F.concat(F.col("event"), F.lit(" open")).alias("event"), F.concat(F.lit("E/"), "event").alias("event_id"))
    return one, two, three


cte("pages_all", """
SELECT season, event, 'E/' || event AS event_id FROM played UNION SELECT season, event, 'X/' || event FROM played WHERE month = 5
UNION SELECT season, event || ' open', 'E/' || event FROM played WHERE month = 7""")


@query("c01_event_registry", """
SELECT 'event name has several ids' AS kind, season, event AS key, count(DISTINCT event_id) AS n, min(event_id) AS first, max(event_id) AS last
FROM pages_all WHERE season <> 1995 GROUP BY season, event HAVING count(DISTINCT event_id) > 1
UNION ALL SELECT 'event id has several names', season, event_id, count(DISTINCT event), min(event), max(event)
FROM pages_all WHERE season <> 1995 GROUP BY season, event_id HAVING count(DISTINCT event) > 1""")
def c01(t):
    return quality.registry_conflicts(quality.event_registry(pages(t), drop_seasons=[1995]))


@query("c02_attach_event_id", """
WITH r AS (SELECT season, event, min(event_id) AS id FROM pages_all GROUP BY 1, 2), n AS (SELECT season, event_id, min(event) AS name FROM pages_all GROUP BY 1, 2),
o AS (SELECT season, event, CASE month % 3 WHEN 0 THEN 'E/' || event WHEN 1 THEN '' END AS event_id, count(*) AS c FROM obs GROUP BY 1, 2, 3),
x AS (SELECT o.season, o.event, c, coalesce(nullif(o.event_id, ''), r.id, o.event) AS event_id FROM o LEFT JOIN r ON r.season = o.season AND r.event = o.event)
SELECT x.season, x.event, x.event_id, coalesce(n.name, x.event) AS event_name, c AS rows FROM x LEFT JOIN n ON n.season = x.season AND n.event_id = x.event_id""")
def c02(t):
    rows = px.obs(t, opponent=False).withColumn("event_id", F.when(F.col("month") % 3 == 0, F.concat(F.lit("E/"), "event"))
                                                .when(F.col("month") % 3 == 1, F.lit("")))
    per = rows.groupBy("season", "event", "event_id").agg(F.count(F.lit(1)).alias("rows"))
    return quality.attach_event_id(per, quality.event_registry(pages(t)))


def identified(t):
    cols = ["entity", "season", "event", "series", "mode", "map", "date", "team", "team_vs", "good", "bad", "won"]
    return px.obs(t).select(*cols, F.when(F.col("series") % 5 == 0, F.concat_ws("-", "series", "line", F.col("good") % 2)).alias("stat_id"))


cte("ided", """
SELECT entity, season, event, series, mode, map, date, team, team_vs, good, bad, won,
  CASE WHEN series % 5 = 0 THEN series || '-' || line || '-' || (good % 2) END AS stat_id FROM obs""")
cte("signed", r"""
SELECT *, '{"bad":' || bad || ',"date":"' || date || '","entity":' || entity || ',"event":"' || event || '","good":' || good || ',"map":"' || map
  || '","mode":"' || mode || '","season":' || season || ',"series":' || series || coalesce(',"stat_id":"' || stat_id || '"', '') || ',"team":' || team
  || ',"team_vs":' || team_vs || coalesce(',"won":' || won, '') || '}' AS sig,
  '["' || entity || '","' || event || '","' || date || '","' || series || '","' || map || '","' || mode || '","' || team || '","' || team_vs || '"]' AS base
FROM ided""")


@query("c03_observation_id", """
WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY base, stat_id IS NULL ORDER BY sig) AS k FROM signed)
SELECT entity, series, good, bad, CASE WHEN stat_id IS NOT NULL THEN 1 ELSE k END AS occurrence,
  CASE WHEN stat_id IS NOT NULL THEN 'wiki:' || stat_id ELSE 'derived:' || substr(sha256(base || '|' || k), 1, 24) END AS observation_id FROM r""")
def c03(t):
    return quality.observation_id(identified(t)).select("entity", "series", "good", "bad", "occurrence", "observation_id")


@query("c04_observation_conflicts", """
SELECT 'missing required field mode' AS kind, 1 AS keys, count(*) AS n FROM ided WHERE series % 97 = 0 HAVING count(*) > 0
UNION ALL SELECT 'exact duplicate without an upstream id', count(*), CAST(sum(n) AS BIGINT) FROM (
   SELECT count(*) AS n FROM signed WHERE stat_id IS NULL GROUP BY sig HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT CASE WHEN d = 1 THEN 'exact duplicate of an upstream id' ELSE 'conflicting facts for an upstream id' END, count(*), CAST(sum(n) AS BIGINT) FROM (
   SELECT stat_id, count(*) AS n, least(count(DISTINCT sig), 2) AS d FROM signed WHERE stat_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) GROUP BY d""")
def c04(t):
    rows = identified(t).withColumn("mode", F.when(F.col("series") % 97 != 0, F.col("mode")))
    found = quality.observation_conflicts(rows)
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))


def facts(t):
    """Several placements per entity and event, from different modes and teams; a few unreadable."""
    per = px.counted_obs(t, opponent=False).groupBy("entity", "season", "event", "mode").agg(F.sum("good").alias("g"), F.min("team").alias("team"))
    return per.select("entity", "event", F.when(F.col("g") % 101 != 0, (F.col("g") % 8 + 2).cast("int")).alias("place_x2"),
                      F.when(F.col("mode") == "R", F.col("team")).otherwise(F.col("team") + 1).alias("team"))


cte("facts", """
SELECT entity, event, CASE WHEN g % 101 <> 0 THEN CAST(g % 8 + 2 AS INTEGER) END AS place_x2, CASE WHEN mode = 'R' THEN team ELSE team + 1 END AS team
FROM (SELECT entity, season, event, mode, sum(good) AS g, min(team) AS team FROM cobs GROUP BY 1, 2, 3, 4)""")


def decisions(t):
    f = facts(t).where("entity % 2 = 0").groupBy("entity", "event").agg(F.min("team").alias("chosen_team"))
    return f.select("entity", "event", "chosen_team", F.lit("reviewed").alias("rationale"),
                    F.when(F.col("entity") % 6 != 0, "screenshot").otherwise("").alias("evidence"), F.lit("2026-01-01").alias("reviewed_at"))


cte("best", """
SELECT f.entity, f.event, any_value(b.p) AS place_x2, any_value(b.bad) AS bad, any_value(b.n) AS facts, count(*) FILTER (f.place_x2 = b.p) AS tied,
  count(DISTINCT CASE WHEN f.place_x2 = b.p THEN f.team END) AS teams, min(CASE WHEN f.place_x2 = b.p THEN f.team END) AS only_team,
  any_value(b.chosen) AS chosen, count(*) FILTER (f.place_x2 = b.p AND f.team = b.chosen) AS hits
FROM facts f JOIN (SELECT entity, event, min(place_x2) AS p, count(*) - count(place_x2) AS bad, count(*) AS n, min(team) AS chosen FROM facts GROUP BY 1, 2) b
  ON b.entity = f.entity AND b.event = f.event GROUP BY f.entity, f.event""")
cte("best_facts", """
SELECT entity, event, place_x2, facts, CASE WHEN place_x2 IS NOT NULL THEN tied END AS tied, status,
  CASE status WHEN 'single' THEN only_team WHEN 'decided' THEN chosen END AS team
FROM (SELECT *, CASE WHEN bad > 0 THEN 'unparseable' WHEN teams = 1 THEN 'single'
       WHEN hits = 1 AND entity % 2 = 0 AND entity % 6 <> 0 THEN 'decided' ELSE 'conflict' END AS status FROM best)""")


@query("c05_best_fact", "SELECT entity, event, place_x2, team, facts, tied, status FROM best_facts")
def c05(t):
    return quality.best_fact(facts(t), decisions(t))


@query("c06_conflict_ledger", """
SELECT 'participation:' || entity || ':' || event AS id, 'participation' AS subject,
  CASE WHEN status IN ('conflict', 'unparseable') THEN NULL WHEN tied > 1 THEN 'explicitReviewedDecision' ELSE 'bestPlacement' END AS rule,
  CASE WHEN status IN ('conflict', 'unparseable') THEN NULL ELSE 'participation' END AS policy, status NOT IN ('conflict', 'unparseable') AS resolved, facts, competing
FROM best_facts JOIN (SELECT entity, event, string_agg(team || '@' || coalesce(CAST(place_x2 AS VARCHAR), '?'), ',' ORDER BY team || '@' || coalesce(CAST(place_x2 AS VARCHAR), '?')) AS competing
  FROM facts GROUP BY 1, 2) USING (entity, event) WHERE facts > 1
UNION ALL SELECT 'event-identity:' || season || ':' || event, 'event', NULL, NULL, FALSE, count(DISTINCT event_id), NULL FROM pages_all
  WHERE season <> 1995 GROUP BY season, event HAVING count(DISTINCT event_id) > 1
UNION ALL SELECT 'event-identity:' || season || ':' || event, 'event', 'excludedBeforeIdentity', 'exclusions', TRUE, count(DISTINCT event_id), NULL FROM pages_all
  WHERE season = 1995 GROUP BY season, event HAVING count(DISTINCT event_id) > 1""")
def c06(t):
    everything = quality.registry_conflicts(quality.event_registry(pages(t))).where("kind = 'event name has several ids'")
    dropped = everything.where("season = 1995").select(
        F.concat_ws(":", F.lit("event-identity"), F.col("season").cast("string"), "key").alias("id"), F.col("n").alias("facts"))
    return quality.conflict_ledger(quality.best_fact(facts(t), decisions(t)), dropped, everything.where("season <> 1995"), facts(t))


def team_results(t):
    from .observation_q import team_places
    return team_places(t).select("event", F.concat(F.lit("Team "), "team").alias("team"), "place")


@query("c07_reconcile_winners", """
WITH f AS (SELECT event, count(DISTINCT team) AS winners, min('Team ' || team) AS team FROM (SELECT * REPLACE (CASE WHEN event NOT LIKE '%-03' THEN place END AS place) FROM tplace) WHERE place = 1 GROUP BY event),
e AS (SELECT p.event, CASE p.month % 3 WHEN 0 THEN NULL WHEN 1 THEN 'team-' || w.t ELSE 'Team 0' END AS winner FROM played p
  JOIN (SELECT event, min(team) AS t FROM tplace WHERE place = 1 GROUP BY event) w ON w.event = p.event)
SELECT * FROM (SELECT e.event, coalesce(winners, 0) AS winners, winner, CASE WHEN coalesce(winners, 0) <> 1 THEN 'expected one winner'
  WHEN winner IS NOT NULL AND regexp_replace(lower(winner), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(f.team), '[^a-z0-9]', '', 'g') THEN 'stated winner differs' END AS reason
FROM e LEFT JOIN f ON f.event = e.event) WHERE reason IS NOT NULL""")
def c07(t):
    from .observation_q import team_places
    first = team_places(t).where("place = 1").groupBy("event").agg(F.min("team").alias("w"))
    events = px.played(t).join(first, "event").select("event", F.expr(
        "CASE month % 3 WHEN 0 THEN NULL WHEN 1 THEN 'team-' || w ELSE 'Team 0' END AS winner"))
    unknown = F.when(~F.col("event").like("%-03"), F.col("place"))  # some events have results without places
    return quality.reconcile_winners(events, team_results(t).withColumn("place", unknown))


@query("c08_reconcile_sets", """
SELECT entity, event, 'left_only' AS side FROM wins WHERE month % 4 = 0
UNION ALL SELECT entity, event, 'right_only' FROM wins WHERE month % 5 = 0 AND month % 4 <> 0""")
def c08(t):
    w = px.wins(t)
    return quality.reconcile_sets(w.where("month % 5 <> 0 OR month % 4 = 0"), w.where("month % 4 <> 0"), ["entity", "event"])


@query("c09_require_subset", "SELECT DISTINCT entity, event FROM wins WHERE championship AND entity % 2 = 0")
def c09(t):
    w = px.wins(t)
    return quality.require_subset(w.where("championship"), w.where("entity % 2 <> 0 OR NOT championship"), ["entity", "event"])


@query("c10_ambiguous_names", r"""
SELECT DISTINCT name, key FROM (SELECT name, trim(regexp_replace(lower(trim(name)), '\s*\(.*?\)\s*', '', 'g')) AS key0,
  CASE trim(regexp_replace(lower(trim(name)), '\s*\(.*?\)\s*', '', 'g')) WHEN 'small bolt' THEN 'tiny bolt' ELSE
  trim(regexp_replace(lower(trim(name)), '\s*\(.*?\)\s*', '', 'g')) END AS key FROM names)
WHERE trim(regexp_replace(name, '\s*\(.*?\)\s*', '', 'g')) <> trim(name) AND lower(trim(name)) NOT IN ('red ring (brand#5)', 'small bolt')
  AND key IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0)""")
def c10(t):
    listed = t("part").where("p_partkey % 2 = 0").select(F.col("p_name").alias("key"))
    return quality.ambiguous_names(fq.names(t).select("name"), listed, fq.NAME_ALIASES).select("name", "key")


@query("c11_reconstruction_check", """
SELECT s_suppkey AS entity, s_suppkey % 3 AS published, coalesce(w.n, 0) AS derived FROM supplier
LEFT JOIN (SELECT entity, count(*) AS n FROM wins GROUP BY 1) w ON w.entity = s_suppkey WHERE coalesce(w.n, 0) <> s_suppkey % 3""")
def c11(t):
    published = t("supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_suppkey") % 3).alias("published"))
    return quality.reconstruction_check(px.wins(t).groupBy("entity").agg(F.count(F.lit(1)).alias("total")), published)


@query("c12_drift", """
WITH live AS (SELECT entity, count(*) AS value FROM wins WHERE entity % 7 <> 0 GROUP BY 1), pub AS (
  SELECT entity, count(*) AS published FROM wins WHERE entity % 3 = 0 GROUP BY 1)
SELECT 'drift' AS kind, entity, published, value AS live FROM pub LEFT JOIN live USING (entity) WHERE value IS DISTINCT FROM published
UNION ALL (SELECT 'newcomer', entity, NULL, value FROM live WHERE entity NOT IN (SELECT entity FROM pub) AND value >= (SELECT min(published) FROM pub)
  ORDER BY value DESC, entity DESC LIMIT 10)""")
def c12(t):
    counts = px.wins(t).groupBy("entity").agg(F.count(F.lit(1)).alias("value"))
    return quality.drift(counts.where("entity % 7 <> 0"), counts.where("entity % 3 = 0").withColumnRenamed("value", "published"))


def group_obs(t: Tables):
    """Eight observations per order, four a side, with deliberate defects in some orders."""
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                              F.explode(F.sequence(F.lit(0), F.when(F.col("o_orderkey") % 11 == 0, 6).otherwise(7))).alias("i"))
    return rows.selectExpr(
        "o_orderkey AS series", "year(o_orderdate) AS season", "date_format(o_orderdate, 'yyyy-MM') AS event",
        "CASE WHEN o_orderpriority < '3' THEN 'Hardpoint' WHEN o_orderpriority < '5' THEN 'Control' ELSE 'Search & Destroy' END AS mode",
        "'M' || o_orderkey % 5 AS map", "to_date(o_orderdate) AS date",
        "(o_custkey + 37 * CASE WHEN o_orderkey % 13 = 0 AND i = 7 THEN 6 ELSE i END) % 1500 AS entity",
        "CASE WHEN i < 4 THEN 'T' || o_custkey % 12 WHEN o_orderkey % 17 = 0 THEN '' ELSE 'T' || (o_custkey % 12 + 1 + o_orderkey % 11) % 12 END AS team",
        "CASE WHEN o_orderkey % 19 = 0 AND i = 0 THEN 'T99' WHEN i >= 4 THEN 'T' || o_custkey % 12 ELSE 'T' || (o_custkey % 12 + 1 + o_orderkey % 11) % 12 END AS team_vs",
        "CAST(10 + (o_orderkey * 7 + i * 13 + o_custkey) % 25 AS INT) AS good",
        "CAST(CASE WHEN o_orderkey % 23 = 0 AND i = 3 THEN 0 ELSE 8 + (o_orderkey * 5 + i * 11) % 25 END AS INT) AS bad",
        "CASE WHEN o_orderkey % 29 = 0 AND i = 0 THEN (o_orderkey % 3 = 0) ELSE ((i < 4) = (o_orderkey % 3 <> 0)) END AS won")


cte("gobs", """
SELECT o_orderkey AS series, CAST(year(o_orderdate) AS INTEGER) AS season, strftime(o_orderdate, '%Y-%m') AS event,
  CASE WHEN o_orderpriority < '3' THEN 'Hardpoint' WHEN o_orderpriority < '5' THEN 'Control' ELSE 'Search & Destroy' END AS mode,
  'M' || o_orderkey % 5 AS map, CAST(o_orderdate AS DATE) AS date,
  (o_custkey + 37 * CASE WHEN o_orderkey % 13 = 0 AND i = 7 THEN 6 ELSE i END) % 1500 AS entity,
  CASE WHEN i < 4 THEN 'T' || o_custkey % 12 WHEN o_orderkey % 17 = 0 THEN '' ELSE 'T' || (o_custkey % 12 + 1 + o_orderkey % 11) % 12 END AS team,
  CASE WHEN o_orderkey % 19 = 0 AND i = 0 THEN 'T99' WHEN i >= 4 THEN 'T' || o_custkey % 12 ELSE 'T' || (o_custkey % 12 + 1 + o_orderkey % 11) % 12 END AS team_vs,
  CAST(10 + (o_orderkey * 7 + i * 13 + o_custkey) % 25 AS INTEGER) AS good,
  CAST(CASE WHEN o_orderkey % 23 = 0 AND i = 3 THEN 0 ELSE 8 + (o_orderkey * 5 + i * 11) % 25 END AS INTEGER) AS bad,
  CASE WHEN o_orderkey % 29 = 0 AND i = 0 THEN (o_orderkey % 3 = 0) ELSE ((i < 4) = (o_orderkey % 3 <> 0)) END AS won
FROM orders, range(0, 8) AS r(i) WHERE NOT (o_orderkey % 11 = 0 AND i = 7)""")
cte("gteam", """
SELECT series, team, count(*) AS n, count(*) FILTER (won) AS w, count(DISTINCT team_vs) AS nvs, min(team_vs) AS vs FROM gobs GROUP BY 1, 2""")
cte("gcheck", """
SELECT g.series, any_value(e.n) AS rows, any_value(e.d) AS d, any_value(e.w) AS w, count(*) AS teams, count(*) FILTER (team <> '') AS named,
  count(*) FILTER (team <> '' AND g.w > 0 AND g.w < g.n) AS mixed, count(*) FILTER (g.n <> 4) AS uneven,
  bool_and(nvs = 1 AND vs = CASE WHEN team = lo THEN hi ELSE lo END) AS resolves
FROM gteam g JOIN (SELECT series, count(*) AS n, count(DISTINCT entity) AS d, count(*) FILTER (won) AS w, min(team) AS lo, max(team) AS hi FROM gobs GROUP BY 1) e
  ON e.series = g.series GROUP BY g.series""")
cte("greasons", """
SELECT series, rows, concat_ws(',', CASE WHEN d <> rows THEN 'duplicate entity' END, CASE WHEN mixed > 0 THEN 'inconsistent team result' END,
  CASE WHEN teams = 2 AND named = 2 AND NOT resolves THEN 'opponent' END, CASE WHEN rows <> 8 THEN 'row count' END,
  CASE WHEN teams = 2 AND named = 2 AND uneven > 0 THEN 'team size' END, CASE WHEN teams <> 2 OR named <> 2 THEN 'teams' END) AS reasons,
  concat_ws(',', CASE WHEN d <> rows THEN 'duplicate entity' END, CASE WHEN mixed > 0 THEN 'inconsistent team result' END,
  CASE WHEN rows <> 8 THEN 'row count' END, CASE WHEN teams <> 2 OR named <> 2 THEN 'teams' END,
  CASE WHEN w <> 4 OR rows - w <> 4 THEN 'win and loss rows' END) AS entity_reasons FROM gcheck""")


@query("c13_validate_groups", "SELECT series, rows, reasons FROM greasons")
def c13(t):
    return quality.group_violations(group_obs(t), MAP_KEY).select("series", "rows", "reasons")


@query("c13_valid_rows", """
SELECT season, count(*) AS rows, count(DISTINCT series) AS maps, CAST(sum(good) AS BIGINT) AS good FROM gobs
WHERE series IN (SELECT series FROM greasons WHERE entity_reasons = '') GROUP BY season""")
def c13v(t):
    obs = group_obs(t)
    kept = quality.valid_groups(obs, quality.group_violations(obs, MAP_KEY, check_opponent=False), MAP_KEY)
    return kept.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("series").alias("maps"), F.sum("good").alias("good"))


def clean_group_obs(t):
    """Respawn rows of complete maps (both checks), ready for association analysis."""
    obs = group_obs(t).where("mode <> 'Search & Destroy'")
    return quality.valid_groups(obs, quality.group_violations(obs, MAP_KEY), MAP_KEY)


cte("vobs", "SELECT * FROM gobs WHERE mode <> 'Search & Destroy' AND series IN (SELECT series FROM greasons WHERE reasons = '')")


@query("c14_normalize_rejects", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN season NOT IN (1997, 1998, 1999, 2000) THEN 'season' WHEN split <> 'respawn' THEN 'split'
  WHEN won IS NULL OR bad = 0 THEN 'invalid value' ELSE 'kept' END AS reason FROM obs) GROUP BY 1""")
def c14(t):
    rules = [("season", ~F.col("season").isin(1997, 1998, 1999, 2000)), ("split", split_of(
        F.when(F.col("mode") == "R", "Search and Destroy").otherwise("Hardpoint")) != "respawn"),
        ("invalid value", F.col("won").isNull() | (F.col("bad") == 0))]
    kept, rejects = quality.normalize_with_rejects(px.obs(t, opponent=False), rules)
    return rejects.unionByName(kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n")))


RESULT_KEY = ["season", "event", "series", "mode", "map", "date", "team"]


@query("c15_result_index", """
SELECT series, team, bool_or(won) AS won, bool_or(won) <> bool_and(won) AS contradictory FROM gobs WHERE series % 7 <> 0 GROUP BY series, team""")
def c15(t):
    g = group_obs(t)
    return quality.result_index([g.where("series % 7 BETWEEN 1 AND 4"), g.where("series % 7 BETWEEN 3 AND 6")], RESULT_KEY) \
        .select("series", "team", "won", "contradictory")


@query("c15_enrich_results", """
WITH i AS (SELECT series, team, bool_or(won) AS won FROM gobs WHERE series % 7 <> 0 GROUP BY 1, 2 HAVING bool_or(won) = bool_and(won))
SELECT g.season, count(*) FILTER (i.won IS NOT NULL) AS known, count(*) FILTER (i.won) AS won, count(DISTINCT CASE WHEN i.won IS NULL THEN g.series || g.team END) AS missing_keys
FROM gobs g LEFT JOIN i ON i.series = g.series AND i.team = g.team GROUP BY g.season""")
def c15e(t):
    g = group_obs(t)
    rows, missing = quality.enrich_results(g, quality.result_index([g.where("series % 7 <> 0")], RESULT_KEY), RESULT_KEY)
    known = rows.groupBy("season").agg(F.count(F.lit(1)).alias("known"), F.count_if("won").alias("won"))
    return known.join(missing.groupBy("season").agg(F.count(F.lit(1)).alias("missing_keys")), "season", "full").fillna(0)


METRICS = ("raw_wins", "finals_record", "championships", "overall_kd", "kd_delta")


def claims(t):
    key = F.col("s_suppkey")
    metric = F.element_at(F.array(*[F.lit(m) for m in METRICS]), (key % 5 + 1).cast("int"))
    n = lambda e: F.expr(e).cast("double")
    expected = (F.when(key % 5 == 0, F.create_map(F.lit("value"), n("s_suppkey % 3")))
                .when(key % 5 == 1, F.create_map(F.lit("wins"), n("s_suppkey % 2"), F.lit("losses"), n("s_suppkey % 3")))
                .when(key % 5 == 2, F.create_map(F.lit("value"), n("0")))
                .when(key % 5 == 3, F.create_map(F.lit("kd"), F.lit(1.3)))
                .otherwise(F.create_map(F.lit("maps_delta"), n("s_suppkey % 4"), F.lit("kd_delta"), F.lit(0.0))))
    return t("supplier").select(
        key.alias("id"), key.alias("entity"), metric.alias("metric"), F.lit("2000-06-30").cast("date").alias("as_of"),
        F.when(key % 3 == 0, F.array(F.lit(1996), F.lit(1997), F.lit(1998), F.lit(1997))).alias("seasons"),
        F.when(key % 7 == 0, F.array(F.lit("1996-01"), F.lit("1996-02"), F.lit("1997-03"))).alias("events"),
        F.when(key % 8 == 3, F.array(F.lit("R"))).alias("modes"), expected.alias("expected"), F.lit(0.1).alias("tolerance"))


CLAIMED = """date <= DATE '2000-06-30' AND (entity % 3 <> 0 OR season IN (1996, 1997, 1998)) AND (entity % 7 <> 0 OR event IN ('1996-01', '1996-02', '1997-03'))"""


@query("c16_audit_claims", f"""
WITH c AS (SELECT s_suppkey AS id, s_suppkey % 5 AS m FROM supplier),
w AS (SELECT entity, count(*) FILTER (place = 1) AS wins, count(*) FILTER (place = 2) AS losses, count(*) FILTER (place = 1 AND month = 12 - season % 5) AS titles
  FROM placement WHERE {CLAIMED} GROUP BY 1),
k AS (SELECT entity, count(*) AS maps, count(*) FILTER (good % 5 <> 0) AS other_maps, round(CASE WHEN sum(bad) > 0 THEN CAST(sum(good) AS DOUBLE) / sum(bad) END, 3) AS kd,
  round(CASE WHEN sum(bad) FILTER (good % 5 <> 0) > 0 THEN CAST(sum(good) FILTER (good % 5 <> 0) AS DOUBLE) / sum(bad) FILTER (good % 5 <> 0) END, 3) AS other_kd FROM cobs
  WHERE {CLAIMED} AND (entity % 8 <> 3 OR mode = 'R') GROUP BY 1),
r AS (SELECT id, CASE m WHEN 0 THEN 'raw_wins' WHEN 1 THEN 'finals_record' WHEN 2 THEN 'championships' WHEN 3 THEN 'overall_kd' ELSE 'kd_delta' END AS metric,
  CASE m WHEN 0 THEN CAST(coalesce(wins, 0) <> id % 3 AS INTEGER) WHEN 1 THEN CAST(coalesce(wins, 0) <> id % 2 AS INTEGER) + CAST(coalesce(losses, 0) <> id % 3 AS INTEGER)
    WHEN 2 THEN CAST(coalesce(titles, 0) <> 0 AS INTEGER) WHEN 3 THEN CAST(NOT coalesce(abs(kd - 1.3::DOUBLE) <= 0.1::DOUBLE, FALSE) AS INTEGER)
    ELSE CAST(coalesce(maps, 0) - coalesce(other_maps, 0) <> id % 4 AS INTEGER) + CAST(NOT coalesce(abs(round(kd - other_kd, 3)) <= 0.1::DOUBLE, FALSE) AS INTEGER) END AS failed
  FROM c LEFT JOIN w ON w.entity = id LEFT JOIN k ON k.entity = id)
SELECT id, metric, failed = 0 AS ok, CAST(failed AS BIGINT) AS failed FROM r""")
def c16(t):
    placed = px.placement(t).withColumn("championship", F.expr("month = 12 - season % 5"))
    seen = pin(px.counted_obs(t, opponent=False).select("entity", "season", "event", "mode", "date", "good", "bad"))
    return quality.audit_claims(claims(t), placed.where("place = 1"), placed, seen, seen.where("good % 5 <> 0"))


def evidence(t):
    part = t("part")
    sources = part.selectExpr(
        "p_partkey AS source_id", "CASE p_partkey % 10 WHEN 9 THEN 'draft' WHEN 8 THEN 'verification_lead' ELSE 'seeded' END AS status",
        "CASE p_partkey % 4 WHEN 0 THEN 'authored_all_time_ranking' WHEN 1 THEN 'authored_title_ranking' ELSE 'interview' END AS family",
        "CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'https://example.org/' || p_partkey END AS url", "'2020-01-01' AS published_date",
        "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 10 END AS ranking_size", "CAST(1995 + p_size % 7 AS INT) AS season")
    entries = t("lineitem").selectExpr(
        "CASE WHEN l_partkey % 31 = 0 THEN l_partkey + 100000000 ELSE l_partkey END AS source_id", "l_linenumber - 1 AS rank", "l_suppkey AS entity",
        "CASE WHEN l_orderkey % 41 = 0 THEN array() ELSE array('tag' || l_orderkey % 5, 'tag' || l_orderkey % 3) END AS tags")
    made = t("orders").selectExpr("o_custkey AS source_id", "o_orderkey % 100 AS entity", "o_orderpriority AS claimant",
                                  "CASE WHEN o_orderkey % 43 = 0 THEN array() ELSE array('claim' || o_orderkey % 4) END AS tags")
    return sources, entries, made


cte("esrc", """
SELECT p_partkey AS source_id, CASE p_partkey % 10 WHEN 9 THEN 'draft' WHEN 8 THEN 'verification_lead' ELSE 'seeded' END AS status,
  CASE p_partkey % 4 WHEN 0 THEN 'authored_all_time_ranking' WHEN 1 THEN 'authored_title_ranking' ELSE 'interview' END AS family,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'u' END AS url, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 10 END AS ranking_size, 1995 + p_size % 7 AS season FROM part""")
cte("eent", """
SELECT CASE WHEN l_partkey % 31 = 0 THEN l_partkey + 100000000 ELSE l_partkey END AS source_id, l_linenumber - 1 AS rank, l_suppkey AS entity,
  CASE WHEN l_orderkey % 41 = 0 THEN [] ELSE ['tag' || l_orderkey % 5, 'tag' || l_orderkey % 3] END AS tags FROM lineitem""")
cte("ecla", """
SELECT o_custkey AS source_id, o_orderkey % 100 AS entity, o_orderpriority AS claimant, CASE WHEN o_orderkey % 43 = 0 THEN [] ELSE ['claim' || o_orderkey % 4] END AS tags FROM orders""")


@query("c17_validate_evidence", """
WITH s AS (SELECT * FROM esrc WHERE status = 'seeded')
SELECT source_id, 'unknown status' AS problem FROM esrc WHERE status = 'draft'
UNION ALL SELECT source_id, 'seeded source misses fields' FROM s WHERE url = ''
UNION ALL SELECT source_id, 'ranking source needs a size' FROM esrc WHERE family LIKE 'authored%' AND ranking_size IS NULL
UNION ALL SELECT DISTINCT source_id, 'ranking of an unknown source' FROM eent WHERE source_id NOT IN (SELECT source_id FROM esrc)
UNION ALL SELECT DISTINCT source_id, 'ranking source is not seeded' FROM eent WHERE source_id IN (SELECT source_id FROM esrc WHERE status <> 'seeded')
UNION ALL SELECT DISTINCT source_id, 'duplicate rank' FROM (SELECT source_id FROM eent GROUP BY source_id, rank HAVING count(*) > 1)
UNION ALL SELECT DISTINCT source_id, 'duplicate entity' FROM (SELECT source_id FROM eent GROUP BY source_id, entity HAVING count(*) > 1)
UNION ALL SELECT DISTINCT source_id, 'rank must be positive' FROM eent WHERE rank <= 0
UNION ALL SELECT DISTINCT source_id, 'entry needs tags' FROM eent WHERE len(tags) = 0
UNION ALL SELECT source_id, 'seeded ranking source has no entries' FROM s WHERE family LIKE 'authored%' AND source_id NOT IN (SELECT source_id FROM eent)
UNION ALL SELECT DISTINCT source_id, 'claim source is not seeded' FROM ecla WHERE source_id NOT IN (SELECT source_id FROM s)
UNION ALL SELECT DISTINCT source_id, 'claim needs tags' FROM ecla WHERE len(tags) = 0""")
def c17(t):
    return quality.validate_evidence(*evidence(t))


@query("c18_first_violations", "SELECT CAST(entity AS VARCHAR) || ':' || event AS id FROM best_facts WHERE status IN ('conflict', 'unparseable') ORDER BY 1 LIMIT 5")
def c18(t):
    bad = quality.best_fact(facts(t), decisions(t)).where("status IN ('conflict', 'unparseable')")
    return quality.first_violations(bad.withColumn("id", F.concat_ws(":", F.col("entity").cast("string"), "event")))


@query("c19_exclude_groups", """
WITH x AS (SELECT DISTINCT series FROM gobs WHERE team IN ('T3', 'T7') OR team_vs IN ('T3', 'T7'))
SELECT season, count(*) FILTER (series NOT IN (SELECT series FROM x)) AS kept_rows, count(DISTINCT CASE WHEN series IN (SELECT series FROM x) THEN series END) AS dropped_maps
FROM gobs GROUP BY season""")
def c19(t):
    members = t.spark.range(1).select(F.explode(F.array(F.lit("T3"), F.lit("T7"))).alias("member"))
    kept, dropped = quality.exclude_groups(group_obs(t), MAP_KEY, members, ["team", "team_vs"])
    rows = kept.groupBy("season").agg(F.count(F.lit(1)).alias("kept_rows"))
    return rows.join(dropped.groupBy("season").agg(F.count(F.lit(1)).alias("dropped_maps")), "season", "full").fillna(0)


@query("u02_symmetric_difference", """
WITH a AS (SELECT DISTINCT season, entity FROM wins), b AS (SELECT season, entity FROM placement WHERE place = 2 GROUP BY 1, 2)
SELECT season, entity, 'left_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT season, entity, 'right_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u02(t):
    """Entities that won in a season but were never second in it, and the reverse."""
    placed = px.placement(t)
    return quality.reconcile_sets(placed.where("place = 1").select("season", "entity"), placed.where("place = 2").select("season", "entity"), ["season", "entity"])
