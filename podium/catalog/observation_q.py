"""Queries for observation statistics and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.values import half_away, ratio
from ..operators import boards, careers, joins, observation
from ..plans import competition_rank, exact_quantile
from . import proxies as px
from .registry import Tables, cte, query


def team_places(t: Tables):
    """Placement of each nation at each counted event."""
    return t.once("team_places", _team_places)


def _team_places(t: Tables):
    teams = px.entity_event(t).groupBy("season", "event", "team").agg(F.sum("good").alias("good"))
    return competition_rank(teams, ["season", "event"], [("good", False)], "place")


cte("tplace", """
SELECT season, event, team, rank() OVER (PARTITION BY season, event ORDER BY g DESC) AS place
FROM (SELECT season, event, team, sum(good) AS g FROM cobs GROUP BY 1, 2, 3)""")
cte("pobs", """
SELECT o.*, v.place AS opponent_place, w.place AS own_place FROM cobs o
LEFT JOIN tplace v ON v.season = o.season AND v.event = o.event AND v.team = o.team_vs
LEFT JOIN tplace w ON w.season = o.season AND w.event = o.event AND w.team = o.team""")


def placed_obs(t):
    return observation.with_places(px.counted_obs(t), team_places(t))


@query("a09_stat_grains", """
SELECT entity, season, event, mode, split,
  CASE grouping_id(season, event, mode, split) WHEN 15 THEN 'overall' WHEN 14 THEN 'split' WHEN 13 THEN 'mode' WHEN 7 THEN 'season'
    WHEN 6 THEN 'season_split' WHEN 3 THEN 'event' WHEN 2 THEN 'event_split' END AS grain,
  CAST(sum(good) AS BIGINT) AS good, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(good) + sum(bad) AS BIGINT) AS total, count(*) AS maps,
  round(CASE WHEN sum(bad) > 0 THEN CAST(sum(good) AS DOUBLE) / sum(bad) END, 3) AS ratio, count(*) FILTER (won) AS wins,
  count(won) - count(*) FILTER (won) AS losses,
  CASE WHEN count(won) > 0 THEN count(*) FILTER (won) / count(won) END AS win_rate,
  CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
  count(DISTINCT ev) AS events, count(DISTINCT team) AS teams
FROM (SELECT *, event AS ev FROM cobs) GROUP BY GROUPING SETS ((entity), (entity, split), (entity, mode), (entity, season), (entity, season, split),
  (entity, season, event), (entity, season, event, split))""")
def a09(t):
    rows = observation.stat_grains(px.counted_obs(t, opponent=False))
    return rows.withColumn("first_date", F.col("first_date").cast("string")).withColumn("last_date", F.col("last_date").cast("string"))


def legacy(t):
    """Pre-aggregated rows for early seasons, one per map so events repeat."""
    return (px.counted_obs(t, opponent=False).where("season < 1998").groupBy("entity", "season", "event", "map", "month")
            .agg(F.count(F.lit(1)).alias("maps"), ratio(F.sum("good"), F.sum("bad")).alias("ratio")).where("ratio IS NOT NULL"))


cte("legacy", """
SELECT entity, season, event, map, month, count(*) AS maps, CAST(sum(good) AS DOUBLE) / sum(bad) AS ratio FROM cobs WHERE season < 1998
GROUP BY 1, 2, 3, 4, 5 HAVING sum(bad) > 0""")
cte("legacy_last", "SELECT * FROM legacy QUALIFY row_number() OVER (PARTITION BY entity, season, event ORDER BY map DESC) = 1")


@query("a10_legacy_events", "SELECT entity, season, event, maps, ratio FROM legacy_last")
def a10(t):
    return observation.legacy_events(legacy(t), ["map"]).select("entity", "season", "event", "maps", "ratio")


@query("a10_legacy_totals", """
SELECT entity, season, count(DISTINCT event) AS events, CAST(sum(maps) AS BIGINT) AS maps FROM legacy
GROUP BY ROLLUP (entity, season) HAVING entity IS NOT NULL""")
def a10t(t):
    return observation.legacy_totals(legacy(t))


cte("buckets", """
SELECT season, split, entity, count(*) AS maps, CAST(sum(good) AS BIGINT) AS good, CAST(sum(bad) AS BIGINT) AS bad,
  count(DISTINCT event) AS events, median(opponent_place) AS median_opponent, count(opponent_place) AS opponent_maps,
  count(*) FILTER (opponent_place <= 8) AS strong, CAST(sum(good) AS DOUBLE) / count(*) AS rate FROM pobs GROUP BY 1, 2, 3""")
cte("fit", "SELECT * FROM buckets WHERE maps >= CASE split WHEN 'respawn' THEN 28 ELSE 10 END")
cte("ror", """
SELECT f.*, r.replacement, r.qualified, s.with_maps, round(f.rate - r.replacement, 9) AS value,
  row_number() OVER (PARTITION BY f.season, f.split ORDER BY round(f.rate - r.replacement, 3) DESC, f.maps DESC, f.entity) AS rank
FROM fit f JOIN (SELECT season, split, quantile_cont(rate, 0.25) AS replacement, count(*) AS qualified FROM fit GROUP BY 1, 2) r
  ON r.season = f.season AND r.split = f.split
JOIN (SELECT season, split, count(*) AS with_maps FROM buckets GROUP BY 1, 2) s ON s.season = f.season AND s.split = f.split""")


def replacement(t):
    return observation.rate_over_replacement(placed_obs(t))


@query("a11_rate_over_replacement", """
SELECT season, split, entity, maps, good, bad, events, median_opponent, opponent_maps, rate, round(replacement, 9) AS replacement,
  qualified, with_maps, value, round((rate - replacement) * maps, 8) AS total_value, CASE WHEN bad > 0 THEN CAST(good AS DOUBLE) / bad END AS ratio,
  CASE WHEN opponent_maps > 0 THEN strong / opponent_maps END AS strong_share, rank,
  CASE WHEN season BETWEEN 1995 + entity % 3 AND 1998 + entity % 4 THEN CASE entity % 3 WHEN 0 THEN 'AR' WHEN 1 THEN 'Flex' ELSE 'SMG' END
       ELSE 'Unknown' END AS role FROM ror""")
def a11(t):
    keys = px.entity_event(t).select("entity", "season").distinct()
    roles = joins.role_by_season(keys, px.stints(t), 1995, 2001)
    out = observation.rate_over_replacement(placed_obs(t), roles)
    for c, digits in (("replacement", 9), ("value", 9), ("total_value", 8)):
        out = out.withColumn(c, F.round(c, digits))
    return out


CONFIG = [("good", "overall", tier, n) for tier, n in (("low", 14), ("base", 20), ("high", 40))] \
    + [(m, "respawn", tier, n) for m in ("good", "total") for tier, n in (("low", 10), ("base", 14), ("high", 28))] \
    + [("good", "snd", tier, n) for tier, n in (("low", 3), ("base", 5), ("high", 10))]


def config(t):
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s).alias("split"), F.lit(r).alias("tier"), F.lit(n).alias("min_maps"))
                     for m, s, r, n in CONFIG])
    return t.spark.range(1).select(F.explode(rows).alias("c")).select("c.*")


cte("config", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{s}', '{r}', {n})" for m, s, r, n in CONFIG)
    + ") AS c(metric, split, tier, min_maps)")
cte("variants", """
SELECT b.season, c.metric, b.split, c.tier, b.entity, b.maps, b.events, b.wins, b.good, b.bad,
  CASE WHEN c.metric = 'good' THEN good ELSE good + bad END / b.maps AS rate
FROM (SELECT season, sp AS split, entity, count(*) AS maps, CAST(sum(good) AS BIGINT) AS good, CAST(sum(bad) AS BIGINT) AS bad,
        count(*) FILTER (won) AS wins, count(DISTINCT event) AS events
      FROM (SELECT *, unnest([split, 'overall']) AS sp FROM cobs) GROUP BY 1, 2, 3) b
JOIN config c ON c.split = b.split AND b.maps >= c.min_maps""")
cte("scored_variants", """
SELECT v.*, round(rate - replacement, 9) AS value, replacement FROM variants v
JOIN (SELECT season, metric, split, tier, quantile_cont(rate, 0.25) AS replacement FROM variants GROUP BY 1, 2, 3, 4) r
  USING (season, metric, split, tier)""")


def variants(t):
    return observation.metric_over_replacement(px.counted_obs(t, opponent=False), config(t))


@query("a12_replacement_variants", """
SELECT season, metric, split, tier, entity, maps, events, wins, rate, round(replacement, 9) AS replacement, value,
  rank() OVER (PARTITION BY season, metric, split, tier ORDER BY value DESC, entity) AS rank FROM scored_variants""")
def a12(t):
    return observation.ranked_variants(variants(t)).select(
        "season", "metric", "split", "tier", "entity", "maps", "events", "wins", "rate", F.round("replacement", 9).alias("replacement"),
        F.round("value", 9).alias("value"), "rank")


@query("a13_threshold_stability", """
SELECT season, metric, split, entity, max(CASE WHEN tier = 'low' THEN rank END) AS rank_low, max(CASE WHEN tier = 'base' THEN rank END) AS rank_base,
  max(CASE WHEN tier = 'high' THEN rank END) AS rank_high FROM (
  SELECT *, row_number() OVER (PARTITION BY season, metric, split, tier ORDER BY value DESC, entity) AS rank FROM scored_variants)
WHERE rank <= 10 GROUP BY 1, 2, 3, 4""")
def a13(t):
    return observation.threshold_stability(variants(t), ["low", "base", "high"])


@query("a14_event_trace", """
SELECT p.season, p.split, p.entity, p.event, CAST(min(p.date) AS VARCHAR) AS date, CAST(sum(p.good) AS BIGINT) AS good,
  CAST(sum(p.bad) AS BIGINT) AS bad, count(*) AS maps, max(own_place) AS own_place
FROM pobs p SEMI JOIN fit f ON f.season = p.season AND f.split = p.split AND f.entity = p.entity GROUP BY 1, 2, 3, 4""")
def a14(t):
    o = placed_obs(t)
    return observation.event_trace(o, qualified(o)).withColumn("date", F.col("date").cast("string"))


def qualified(o):
    minimum = F.when(F.col("split") == "respawn", 28).otherwise(10)
    return o.groupBy("season", "split", "entity").agg(F.count(F.lit(1)).alias("maps")).where(F.col("maps") >= minimum)


@query("a14_map_trace", """
SELECT p.season, p.split, p.entity, p.event, CAST(p.date AS VARCHAR) AS date, p.series, p.line, p.good, p.bad,
  rank() OVER (PARTITION BY p.season, p.split, p.entity, p.event ORDER BY p.date, p.series, p.line, p.good, p.bad) AS position
FROM cobs p SEMI JOIN fit f ON f.season = p.season AND f.split = p.split AND f.entity = p.entity""")
def a14m(t):
    o = px.counted_obs(t, opponent=False)
    return observation.map_trace(o, qualified(o)).withColumn("date", F.col("date").cast("string"))


@query("w03_all_season_rank", """
SELECT split, season, entity, value, maps, row_number() OVER (PARTITION BY split ORDER BY round(value, 3) DESC, maps DESC, entity, season) AS rank FROM ror""")
def w03(t):
    rows = replacement(t).drop("rank").withColumn("value", F.round("value", 9)).withColumn("shown", half_away(F.col("value"), 3))
    ranked = competition_rank(rows, ["split"], [("shown", False), ("maps", False), ("entity", True), ("season", True)])
    return ranked.select("split", "season", "entity", "value", "maps", "rank")


@query("t08_baseline_row", """
SELECT season, split, CAST(entity AS VARCHAR) AS name, value, rate, rank, FALSE AS baseline FROM ror
UNION ALL SELECT season, split, 'replacement', 0.0, round(any_value(replacement), 9), NULL, TRUE FROM ror GROUP BY season, split""")
def t08(t):
    board = replacement(t)
    rows = board.select("season", "split", F.col("entity").cast("string").alias("name"), F.round("value", 9).alias("value"), "rate", "rank",
                        F.lit(False).alias("baseline"))
    base = board.groupBy("season", "split").agg(F.max("replacement").alias("_r")).select(
        "season", "split", F.lit("replacement").alias("name"), F.lit(0.0).alias("value"), F.round("_r", 9).alias("rate"),
        F.lit(True).alias("baseline"))
    return observation.with_baseline(rows, base)


def lane_obs(t):
    return px.counted_obs(t, opponent=False).where("NOT (season < 1998 AND month % 3 = 0)")


def lane_events(t):
    return lane_obs(t).groupBy("entity", "season", "event").agg(
        F.greatest(F.count(F.lit(1)) - F.col("entity") % 2, F.lit(1)).alias("maps"), ratio(F.sum("good"), F.sum("bad")).alias("ratio"))


cte("lane", """
SELECT entity, season, event, greatest(count(*) - entity % 2, 1) AS maps, CASE WHEN sum(bad) > 0 THEN CAST(sum(good) AS DOUBLE) / sum(bad) END AS ratio
FROM cobs WHERE NOT (season < 1998 AND month % 3 = 0) GROUP BY 1, 2, 3""")


@query("u01_union_lanes", """
SELECT l.entity, l.season, l.event, l.maps, l.ratio, 'mapRows' AS source_type, CASE WHEN g.maps > l.maps THEN g.maps END AS legacy_maps,
  CASE WHEN g.maps > l.maps THEN g.ratio END AS legacy_ratio FROM lane l LEFT JOIN legacy_last g USING (entity, season, event)
UNION ALL SELECT entity, season, event, maps, ratio, 'legacyAggregate', NULL, NULL FROM legacy_last g
WHERE NOT EXISTS (SELECT 1 FROM lane l WHERE l.entity = g.entity AND l.season = g.season AND l.event = g.event)""")
def u01(t):
    older = observation.legacy_events(legacy(t), ["map"]).select("entity", "season", "event", "maps", "ratio")
    return observation.union_lanes(lane_events(t), older)


@query("a34_histogram", """
WITH e AS (SELECT season, split, min(value) AS lo, max(value) AS hi FROM ror GROUP BY 1, 2)
SELECT r.season, r.split, CAST(least(17, floor((value - lo) / CASE WHEN hi > lo THEN (hi - lo) / 18 ELSE 1.0 END)) AS INTEGER) AS bin, count(*) AS n
FROM ror r JOIN e ON e.season = r.season AND e.split = r.split GROUP BY 1, 2, 3""")
def a34(t):
    return observation.histogram(replacement(t).withColumn("value", F.round("value", 9)), ["season", "split"], "value")


@query("a35_quantiles", """
SELECT season, split, round(quantile_cont(rate, 0.25), 9) AS p25, round(quantile_cont(rate, 0.5), 9) AS median, round(quantile_cont(rate, 0.9), 9) AS p90
FROM buckets GROUP BY 1, 2""")
def a35(t):
    rows = px.counted_obs(t, opponent=False).groupBy("season", "split", "entity").agg(ratio(F.sum("good"), F.count(F.lit(1))).alias("rate"))
    out = exact_quantile(rows, ["season", "split"], "rate", {"p25": 0.25, "median": 0.5, "p90": 0.9})
    return out.select("season", "split", *[F.round(c, 9).alias(c) for c in ("p25", "median", "p90")])


@query("j01_place_lookup", """
SELECT entity, season, count(opponent_place) AS known, CAST(sum(opponent_place) AS BIGINT) AS opponent_sum, CAST(sum(own_place) AS BIGINT) AS own_sum
FROM pobs GROUP BY 1, 2""")
def j01(t):
    return placed_obs(t).groupBy("entity", "season").agg(F.count("opponent_place").alias("known"), F.sum("opponent_place").alias("opponent_sum"),
                                                        F.sum("own_place").alias("own_sum"))


@query("j02_alias_join", """
WITH a AS (SELECT season, event, event AS alias FROM played UNION SELECT season, event, 'page/' || event FROM played),
o AS (SELECT season, CASE WHEN series % 2 = 0 THEN event ELSE 'page/' || event END AS event, team FROM cobs)
SELECT o.season, o.team, count(*) AS maps, count(p.place) AS matched, CAST(sum(p.place) AS BIGINT) AS place_sum
FROM o LEFT JOIN (SELECT a.season, a.alias, tp.team, tp.place FROM a JOIN tplace tp ON tp.season = a.season AND tp.event = a.event) p
  ON p.season = o.season AND p.alias = o.event AND p.team = o.team GROUP BY 1, 2""")
def j02(t):
    aliases = px.played(t).select("season", "event", F.concat(F.lit("page/"), F.col("event")).alias("alias"))
    rows = px.counted_obs(t, opponent=False).withColumn(
        "event", F.when(F.col("series") % 2 == 0, F.col("event")).otherwise(F.concat(F.lit("page/"), F.col("event"))))
    per = rows.groupBy("season", "event", "team").agg(F.count(F.lit(1)).alias("n"))
    joined = joins.alias_join(per, team_places(t).select("season", "event", "team", "place"), aliases, ["team"])
    return joined.groupBy("season", "team").agg(
        F.sum("n").alias("maps"), F.sum(F.when(F.col("place").isNotNull(), F.col("n"))).alias("matched"),
        F.sum(F.col("place") * F.col("n")).alias("place_sum"))


@query("j03_allowed_keys", """
SELECT entity, count(*) AS maps FROM obs SEMI JOIN (SELECT DISTINCT entity AS e FROM wins) w ON w.e = entity
SEMI JOIN played p ON p.season = obs.season AND p.event = obs.event GROUP BY entity""")
def j03(t):
    return (px.obs(t, opponent=False).join(px.wins(t).select("entity"), "entity", "left_semi")
            .join(px.played(t), ["season", "event"], "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("maps")))


@query("j04_fill_missing_wins", """
WITH p AS (SELECT entity, season, event, place FROM placement WHERE entity % 3 <> 0)
SELECT * FROM p UNION ALL SELECT entity, season, event, 1 FROM wins w WHERE NOT EXISTS (
  SELECT 1 FROM p WHERE p.entity = w.entity AND p.season = w.season AND p.event = w.event)""")
def j04(t):
    placed = px.placement(t).select("entity", "season", "event", "place")
    return joins.fill_missing(placed.where("entity % 3 <> 0"), placed.where("place = 1"), ["entity", "season", "event"], {"place": 1})


def messy_stints(t):
    """Stints with open ends, second stints and overlaps."""
    base = px.stints(t)
    first = base.select("entity", "role", F.expr("CASE WHEN entity % 7 = 0 THEN NULL ELSE start_season END AS start_season"),
                        F.expr("CASE WHEN entity % 11 = 0 THEN NULL ELSE end_season END AS end_season"))
    second = base.where("entity % 5 = 0").select("entity", F.expr("CASE WHEN entity % 2 = 0 THEN 'Flex' ELSE 'Coach' END AS role"),
                                                F.expr("CAST(1999 + entity % 4 AS INT) AS start_season"), F.expr("CAST(2001 + entity % 3 AS INT) - CAST(entity % 20 / 5 AS INT) AS end_season"))
    return first.unionByName(second)


cte("mstints", """
SELECT entity, role, CASE WHEN entity % 7 = 0 THEN NULL ELSE start_season END AS start_season,
  CASE WHEN entity % 11 = 0 THEN NULL ELSE end_season END AS end_season FROM stints
UNION ALL SELECT entity, CASE WHEN entity % 2 = 0 THEN 'Flex' ELSE 'Coach' END, CAST(1999 + entity % 4 AS INTEGER),
  CAST(2001 + entity % 3 - (entity % 20) // 5 AS INTEGER) FROM stints WHERE entity % 5 = 0""")
cte("role_hits", """
SELECT e.entity, e.season, m.role, coalesce(m.start_season, 1995) AS s, coalesce(m.end_season, 2001) AS x
FROM (SELECT DISTINCT entity, season FROM cobs) e LEFT JOIN mstints m ON m.entity = e.entity
  AND e.season BETWEEN coalesce(m.start_season, 1995) AND coalesce(m.end_season, 2001)""")


@query("j05_role_intervals", """
SELECT entity, season, coalesce(arg_min(role, s * 1000000 + x * 100 + ascii(role)), 'Unknown') AS first_role,
  CASE WHEN count(role) = 1 THEN min(role) ELSE 'Unknown' END AS unique_role FROM role_hits GROUP BY 1, 2""")
def j05(t):
    keys = px.counted_obs(t, opponent=False).select("entity", "season").distinct()
    first = joins.role_by_season(keys, messy_stints(t), 1995, 2001).withColumnRenamed("role", "first_role")
    unique = joins.role_by_season(keys, messy_stints(t), 1995, 2001, "unique").withColumnRenamed("role", "unique_role")
    return first.join(unique, ["entity", "season"])


@query("j06_stint_violations", """
WITH m AS (SELECT *, coalesce(start_season, 1995) AS s, coalesce(end_season, 2001) AS x FROM mstints),
f AS (SELECT *, lag(x) OVER (PARTITION BY entity ORDER BY s, x, role) AS px FROM m),
r AS (SELECT entity, role, start_season, end_season, concat_ws(',', CASE WHEN entity NOT IN (SELECT entity FROM wins) THEN 'unknown entity' END,
  CASE WHEN role NOT IN ('AR', 'Flex', 'SMG') THEN 'unknown role' END,
  CASE WHEN s NOT BETWEEN 1995 AND 2001 OR x NOT BETWEEN 1995 AND 2001 THEN 'unknown season' END,
  CASE WHEN s > x THEN 'starts after it ends' END, CASE WHEN s <= px THEN 'overlap' END) AS reasons FROM f)
SELECT * FROM r WHERE reasons <> ''""")
def j06(t):
    return joins.stint_violations(messy_stints(t), px.wins(t), ["AR", "Flex", "SMG"], 1995, 2001)


@query("j07_fallback_match", r"""
WITH k AS (SELECT DISTINCT p_name || ' ' || (p_partkey % 50) || CASE WHEN p_partkey % 2 = 0 THEN ' 2014' ELSE '' END AS key FROM part WHERE p_partkey % 7 = 0),
r AS (SELECT p_partkey AS id, [p_name || ' ' || (p_partkey % 50), p_name || ' ' || (p_partkey % 50) || ' 2013', p_name || ' ' || (p_partkey % 50) || ' 2014',
   p_name || ' ' || (p_partkey % 30), p_name || ' ' || (p_partkey % 30) || ' 2013', p_name || ' ' || (p_partkey % 30) || ' 2014'] AS keys FROM part),
x AS (SELECT id, unnest(keys) AS key, generate_subscripts(keys, 1) - 1 AS pos FROM r)
SELECT r.id, h.key AS match_key, CAST(h.pos AS INTEGER) AS match_position FROM r LEFT JOIN (
  SELECT id, arg_min(x.key, pos) AS key, min(pos) AS pos FROM x JOIN k ON k.key = x.key GROUP BY id) h ON h.id = r.id""")
def j07(t):
    known = t("part").where("p_partkey % 7 = 0").selectExpr(
        "p_name || ' ' || (p_partkey % 50) || CASE WHEN p_partkey % 2 = 0 THEN ' 2014' ELSE '' END AS key").distinct()
    rows = t("part").select(F.col("p_partkey").alias("id"), F.expr("p_name || '_' || (p_partkey % 50)").alias("target"),
                            F.expr("p_name || ' ' || (p_partkey % 30)").alias("label"))
    years = [F.lit(y) for y in ("", " 2013", " 2014")]
    keys = F.array(*[text.title_key(F.concat(F.col(c), y)) for c in ("target", "label") for y in years])
    return joins.fallback_match(rows.withColumn("keys", keys), "keys", known, "key", "id").select("id", "match_key", "match_position")


cte("podium_sets", """
SELECT min(entity) AS set_id, events, count(*) AS n FROM (
  SELECT entity, list_sort(list(DISTINCT event)) AS events FROM placement WHERE place <= 8 GROUP BY entity) GROUP BY events""")


@query("j08_co_occurrence", """
WITH p AS (SELECT a.set_id, b.set_id AS other_id, a.n, b.n AS other_n,
  CAST(len(list_intersect(a.events, b.events)) AS DOUBLE) / (len(a.events) + len(b.events) - len(list_intersect(a.events, b.events))) AS jaccard
  FROM podium_sets a JOIN podium_sets b ON a.set_id < b.set_id)
SELECT * FROM p WHERE jaccard > 0.1 UNION ALL SELECT set_id, set_id, n, n, 1.0 FROM podium_sets WHERE n > 1""")
def j08(t):
    return joins.co_occurrence(px.placement(t).where("place <= 8").select("entity", "event"), 0.1)


@query("j11_latest_roster", """
SELECT season, entity, event, team FROM totals t SEMI JOIN (SELECT season AS s, max(event) AS e FROM totals GROUP BY 1) m ON m.s = t.season AND m.e = t.event""")
def j11(t):
    return joins.latest_rows(px.entity_event(t).withColumn("date", F.trunc("date", "month")), ["season"]).select("season", "entity", "event", "team")


cte("compared", """
SELECT entity, season, event, l.maps, l.ratio, g.maps AS other_maps, g.ratio AS other_ratio,
  CASE WHEN l.maps IS NULL THEN 'other_only' WHEN g.maps IS NULL THEN 'local_only' ELSE 'overlap' END AS status,
  l.maps - g.maps AS maps_delta, round(l.ratio - g.ratio, 3) AS ratio_delta
FROM lane l FULL JOIN legacy_last g USING (entity, season, event)""")


def compared(t):
    older = observation.legacy_events(legacy(t), ["map"])
    return joins.compare_sources(lane_events(t), older, ["entity", "season", "event"])


@query("j12_two_sources", "SELECT * FROM compared")
def j12(t):
    return compared(t)


@query("a33_match_summary", """
SELECT count(*) AS rows, count(other_maps) AS usable, count(*) FILTER (status = 'overlap') AS overlaps, count(*) FILTER (status = 'other_only') AS other_only,
  count(*) FILTER (status = 'other_only' AND season = 1996) AS scope_other_only, count(*) FILTER (status = 'overlap' AND maps_delta < 0) AS more_maps,
  count(*) FILTER (status = 'overlap' AND maps_delta < 0 AND season = 1996) AS scope_more_maps FROM compared""")
def a33(t):
    return joins.match_summary(compared(t), "season = 1996")


@query("u03_intersect_size", """
SELECT season, count(*) FILTER (t = 2) AS shared, count(*) AS either FROM (SELECT season, entity, count(*) AS t FROM (
  SELECT season, entity FROM es UNION ALL SELECT DISTINCT season, entity FROM fit WHERE split = 'snd') GROUP BY 1, 2) GROUP BY season""")
def u03(t):
    winners = px.entity_seasons(t).select("season", "entity")
    steady = qualified(px.counted_obs(t, opponent=False)).where("split = 'snd'").select("season", "entity")
    shared = winners.intersect(steady).groupBy("season").agg(F.count(F.lit(1)).alias("shared"))
    either = winners.union(steady).distinct().groupBy("season").agg(F.count(F.lit(1)).alias("either"))
    return either.join(shared, "season", "left").fillna(0, ["shared"])


@query("u04_ordered_teams", """
SELECT entity, string_agg(CAST(team AS VARCHAR), ',' ORDER BY d, team) AS teams, count(*) AS n_teams FROM (
  SELECT entity, team_vs AS team, min(date) AS d FROM cobs GROUP BY 1, 2) GROUP BY entity""")
def u04(t):
    return careers.teams_in_order(px.counted_obs(t).select("entity", F.col("team_vs").alias("team"), "date"))


@query("u07_role_summary", """
WITH r AS (SELECT entity, season, coalesce(arg_min(role, s * 1000000 + x * 100 + ascii(role)), 'Unknown') AS role FROM role_hits GROUP BY 1, 2)
SELECT entity, CASE count(DISTINCT CASE WHEN role <> 'Unknown' THEN role END) WHEN 0 THEN 'Unknown' WHEN 1 THEN min(CASE WHEN role <> 'Unknown' THEN role END)
   ELSE 'Mixed' END AS selection_role, CASE count(DISTINCT CASE WHEN role <> 'Unknown' THEN role END) WHEN 1 THEN min(CASE WHEN role <> 'Unknown' THEN role END)
   ELSE 'Unknown' END AS primary_role FROM r GROUP BY entity""")
def u07(t):
    keys = px.counted_obs(t, opponent=False).select("entity", "season").distinct()
    roles = joins.role_by_season(keys, messy_stints(t), 1995, 2001)
    mixed = careers.role_summary(roles, ["entity"]).withColumnRenamed("role", "selection_role")
    return mixed.join(careers.role_summary(roles, ["entity"], several="Unknown").withColumnRenamed("role", "primary_role"), "entity")
