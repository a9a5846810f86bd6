"""Queries for scoring, careers and boards (A01-A08, A15, A16, A36-A38, W01-W06, W10, W12, T, U05-U07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards, careers, scoring
from ..plans import competition_rank
from . import functions_q as fq
from . import proxies as px
from .registry import Tables, cte, query


def shares(t: Tables):
    return scoring.opportunity_share(px.entity_seasons(t), px.context(t))


cte("scored", """
SELECT entity, numer, numer_post, wins, titles, seasons, numer / 3960 * mean_all AS adjusted,
       numer_post / 3960 * mean_post AS adjusted_post FROM share, means""")
cte("board", """
SELECT *, rank() OVER (ORDER BY wins DESC) AS raw_rank, rank() OVER (ORDER BY numer DESC) AS adjusted_rank,
       rank() OVER (ORDER BY numer_post DESC) AS post_rank FROM scored""")


@query("a01_season_context", """
WITH x AS (SELECT *, CASE WHEN season = 1996 THEN 10 ELSE scheduled END AS d FROM ctx)
SELECT season, held, scheduled, CAST(d AS BIGINT) AS denom, CAST(first_date AS VARCHAR) AS first_date, idx, pre_epoch,
  (SELECT sum(d) / count(*) FROM x) AS mean_all, (SELECT sum(d) / count(*) FROM x WHERE NOT pre_epoch) AS mean_post FROM x""")
def a01(t):
    ctx = scoring.season_context(px.calendar(t), epoch=px.EPOCH, overrides={1996: 10})
    return ctx.withColumn("first_date", F.col("first_date").cast("string")).crossJoin(scoring.mean_denominators(ctx))


@query("a02_entity_season", """
SELECT w.entity, w.season, count(*) AS wins, any_value(c.denom) AS denom, any_value(c.held) AS held,
  count(*) / any_value(c.denom) AS share, any_value(c.pre_epoch) AS pre_epoch,
  string_agg(w.event || '@' || w.team, ',' ORDER BY w.event) AS won_events
FROM wins w JOIN ctx c ON w.season = c.season GROUP BY w.entity, w.season""")
def a02(t):
    won = scoring.won_events(px.wins(t))
    return (px.entity_seasons(t).join(won, ["entity", "season"])
            .select("entity", "season", "wins", "denom", "held", (F.col("wins") / F.col("denom")).alias("share"),
                    "pre_epoch", F.array_join(F.transform("won", lambda e: F.concat_ws("@", e["event"], e["team"])), ",").alias("won_events")))


@query("a03_opportunity_share", "SELECT entity, numer, numer_post, adjusted, adjusted_post, wins, titles, seasons FROM scored")
def a03(t):
    return shares(t).drop("multiple").withColumn("numer", F.col("numer").cast("bigint")) \
        .withColumn("numer_post", F.col("numer_post").cast("bigint"))


cte("sel", """
SELECT season, CASE WHEN pre_epoch THEN 'early' WHEN season >= 2000 THEN 'late' ELSE 'middle' END AS selection_id FROM ctx
UNION ALL SELECT season, 'all' FROM ctx UNION ALL SELECT season, 'post' FROM ctx WHERE NOT pre_epoch""")
SELECTED = """
WITH rows0 AS ({rows}),
pl AS (SELECT selection_id, entity, count(*) AS events, CAST(sum(place) * 2 AS BIGINT) AS x2 FROM placement JOIN sel USING (season) GROUP BY 1, 2),
sc AS (SELECT selection_id, sum(denom) AS dsum, count(*) AS g FROM sel JOIN ctx USING (season) GROUP BY 1),
p AS (SELECT selection_id, r.entity, CAST(sum(r.wins) AS BIGINT) AS wins, CAST(sum(r.titles) AS BIGINT) AS titles,
        CAST(sum(r.wins * (3960 // c.denom)) AS BIGINT) AS numer, count(*) FILTER (r.wins > 0) AS eras,
        min(r.season) FILTER (r.wins > 0) AS first_season, max(r.season) FILTER (r.wins > 0) AS last_season,
        arg_max(r.season, r.wins * (3960 // c.denom) * 1000 - c.idx) AS peak_season, max(r.wins * (3960 // c.denom)) AS peak_numer
      FROM rows0 r JOIN ctx c ON r.season = c.season JOIN sel s ON s.season = r.season GROUP BY 1, 2 HAVING sum(r.wins) > 0),
q AS (SELECT p.*, sc.dsum, sc.g, CAST(numer AS HUGEINT) * dsum + titles * 2 * 3960 * g AS wkey FROM p JOIN sc USING (selection_id)),
k AS (SELECT *, rank() OVER (PARTITION BY selection_id ORDER BY wkey DESC) AS adjusted_rank,
             rank() OVER (PARTITION BY selection_id ORDER BY wins DESC) AS raw_rank FROM q)
SELECT selection_id, entity, wins, titles, numer, eras, peak_season, numer / 3960 * (dsum / g) AS adjusted,
  peak_numer / 3960 * (dsum / g) AS peak, numer / 3960 * (dsum / g) + titles * 2 AS weighted, CAST(wkey AS BIGINT) AS weighted_key,
  adjusted_rank, raw_rank, raw_rank - adjusted_rank AS rank_change, first_season, last_season, events,
  (x2 * 100 + events) // (events * 2) / 100.0 AS average_place, wins / events AS conversion FROM k LEFT JOIN pl USING (selection_id, entity)"""


def _selected(t, bonus=None):
    ctx = px.context(t)
    out = scoring.recompute_for_selection(px.entity_seasons(t), ctx, scoring.era_selection(ctx, 2000),
                                          scoring.common_multiple(ctx), ring_weight=3, bonus=bonus,
                                          placements=px.placement(t).select("entity", "season", (F.col("place") * 2).alias("place_x2")))
    return out.withColumn("numer", F.col("numer").cast("bigint")).withColumn("weighted_key", F.col("weighted_key").cast("bigint"))


@query("a04_recompute_selection", SELECTED.format(rows="SELECT entity, season, wins, titles FROM es"))
def a04(t):
    return _selected(t)


def bonus(t):
    return t("supplier").where("s_suppkey % 10 = 0").select(
        F.col("s_suppkey").alias("entity"), F.lit(2001).alias("season"), F.lit(1).cast("bigint").alias("wins"),
        F.when(F.col("s_suppkey") % 20 == 0, 1).otherwise(0).cast("bigint").alias("titles"))


@query("m05_what_if_bonus", SELECTED.format(rows="""SELECT entity, season, sum(wins) AS wins, sum(titles) AS titles FROM (
  SELECT entity, season, wins, titles FROM es UNION ALL SELECT s_suppkey, 2001, 1, CASE WHEN s_suppkey % 20 = 0 THEN 1 ELSE 0 END
  FROM supplier WHERE s_suppkey % 10 = 0) GROUP BY 1, 2"""))
def m05(t):
    return _selected(t, bonus(t))


@query("a05_peak_season", """
SELECT entity, season AS peak_season, wins AS peak_wins, denom AS peak_denom, wins / denom AS peak_share
FROM es QUALIFY row_number() OVER (PARTITION BY entity ORDER BY wins * (3960 // denom) DESC, idx) = 1""")
def a05(t):
    return scoring.peak_season(px.entity_seasons(t), scoring.common_multiple(px.context(t)))


@query("a06_win_span", """
SELECT entity, CAST(min(year(date)) AS INTEGER) AS first_year, CAST(max(year(date)) AS INTEGER) AS last_year,
  CAST(max(year(date)) - min(year(date)) + 1 AS INTEGER) AS span_years, count(DISTINCT season) AS seasons_won FROM wins GROUP BY entity""")
def a06(t):
    return scoring.win_span(px.wins(t))


cte("careers", """
SELECT entity, min(date) AS first_date, max(date) AS last_date,
  CAST(year(max(date)) - year(min(date)) AS INTEGER) AS career_years, count(*) AS events_entered FROM totals GROUP BY entity""")


@query("a07_career_span", """
SELECT entity, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, career_years, events_entered FROM careers""")
def a07(t):
    return scoring.career_span(px.entity_event(t)).withColumn("first_date", F.col("first_date").cast("string")) \
        .withColumn("last_date", F.col("last_date").cast("string"))


cte("psum", """
SELECT entity, season, count(*) AS events, CAST(sum(2 * place) AS BIGINT) AS place_x2_sum, count(*) FILTER (place = 1) AS wins,
  count(*) FILTER (place <= 2) AS finals, count(*) FILTER (place <= 4) AS deep_runs FROM placement GROUP BY ROLLUP (entity, season)
HAVING entity IS NOT NULL""")


@query("a08_placement_summary", """
SELECT *, ((place_x2_sum * 100 + events) // (2 * events)) / 100.0::DOUBLE AS average_place, wins / events AS win_rate,
  finals / events AS finals_rate, deep_runs / events AS deep_rate FROM psum""")
def a08(t):
    return scoring.placement_summary(px.placement(t).withColumn("place_x2", F.col("place") * 2))


@query("a15_season_cards", """
WITH w AS (SELECT season, event, min(date) AS date, string_agg(DISTINCT CAST(team AS VARCHAR), ',' ORDER BY CAST(team AS VARCHAR)) AS winner
           FROM wins GROUP BY season, event),
top AS (SELECT season, string_agg(entity || ':' || wins, ',' ORDER BY wins DESC, entity) AS top_winners FROM (
    SELECT season, entity, wins FROM es QUALIFY row_number() OVER (PARTITION BY season ORDER BY wins DESC, entity) <= 8) GROUP BY season)
SELECT w.season, w.event, CAST(w.date AS VARCHAR) AS date, w.winner, 1 / c.denom AS weight, c.held, top.top_winners
FROM w JOIN ctx c ON w.season = c.season JOIN top ON top.season = w.season""")
def a15(t):
    won = px.wins(t)
    return boards.season_cards(won, px.entity_seasons(t), px.context(t), 8) \
        .withColumn("date", F.col("date").cast("string"))


@query("a16_wins_by_season", "SELECT season, entity, count(*) AS wins FROM wins GROUP BY season, entity")
def a16(t):
    return px.wins(t).groupBy("season", "entity").agg(F.count(F.lit(1)).alias("wins"))


@query("a36_titles_by_year", """
SELECT entity, count(*) AS titles, string_agg(season || ':' || event, ',' ORDER BY season, event) AS titles_won
FROM wins WHERE championship GROUP BY entity""")
def a36(t):
    return careers.titles_by_year(px.wins(t).where("championship"))


@query("a37_honors", """
WITH a AS (SELECT entity, award, year, date, CASE WHEN event = '' THEN page ELSE event END AS event FROM typed_awards
           WHERE kept AND award IS NOT NULL)
SELECT entity, count(*) AS honors, count(*) FILTER (award = 'event_mvp') AS event_mvps,
  count(*) FILTER (award = 'season_mvp') AS season_mvps, count(DISTINCT award) AS kinds, min(year) AS first_year, max(year) AS last_year
FROM a GROUP BY entity""")
def a37(t):
    return careers.honor_counts(fq.typed_awards(t).where("kept AND award IS NOT NULL"))


@query("a37_honor_list", """
WITH a AS (SELECT entity, id, award, year, date, CASE WHEN event = '' THEN page ELSE event END AS event FROM typed_awards
           WHERE kept AND award IS NOT NULL)
SELECT entity, id, award, year, event, row_number() OVER (PARTITION BY entity ORDER BY date, award, event, id) AS position FROM a""")
def a37_list(t):
    return careers.honor_list(fq.typed_awards(t).where("kept AND award IS NOT NULL"))


@query("a38_dataset_summary", """
SELECT count(*) AS seasons, CAST(sum(held) AS BIGINT) AS events, any_value(mean_all) AS mean_all, any_value(mean_post) AS mean_post,
  string_agg(CASE WHEN pre_epoch THEN CAST(season AS VARCHAR) END, ',' ORDER BY idx) AS pre_epoch,
  CAST((SELECT max(date) FROM cobs) AS VARCHAR) AS as_of FROM ctx, means""")
def a38(t):
    return careers.dataset_summary(px.context(t), px.counted_obs(t, opponent=False))


@query("w01_competition_rank", """
SELECT entity, numer, wins, adjusted, raw_rank, adjusted_rank, post_rank, raw_rank - adjusted_rank AS rank_change FROM board""")
def w01(t):
    return scoring.leaderboard(shares(t)).select(
        "entity", F.col("numer").cast("bigint").alias("numer"), "wins", "adjusted", "raw_rank", "adjusted_rank", "post_rank", "rank_change")


@query("w02_rank_rounded", """
SELECT entity, season, score, rank() OVER (PARTITION BY season ORDER BY score DESC) AS rank FROM (
  SELECT entity, season, round(CAST(sum(good) AS DOUBLE) / count(*), 1) AS score FROM cobs GROUP BY entity, season)""")
def w02(t):
    rows = px.counted_obs(t, opponent=False).groupBy("entity", "season").agg(
        F.round(F.sum("good") / F.count(F.lit(1)), 1).alias("score"))
    return competition_rank(rows, ["season"], [("score", False)])


@query("w04_rank_deltas", "SELECT entity, raw_rank - adjusted_rank AS rank_change, raw_rank - post_rank AS post_change, adjusted - wins AS value_change FROM board")
def w04(t):
    return scoring.leaderboard(shares(t)).select(
        "entity", "rank_change", (F.col("raw_rank") - F.col("post_rank")).alias("post_change"), "value_change")


cte("path", """
SELECT entity, season, idx, wins / denom * mean_all AS step,
  sum(wins / denom * mean_all) OVER (PARTITION BY entity ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cumulative FROM es, means""")


@query("w05_trajectory", "SELECT entity, season, idx, step, round(cumulative, 6) AS cumulative FROM path")
def w05(t):
    return scoring.trajectory(px.entity_seasons(t), px.context(t)).withColumn("cumulative", F.round("cumulative", 6))


@query("w05_trajectory_shape", """
SELECT entity, round(sum(step), 6) AS total, max(idx) - min(idx) AS run, round(sum(step) / greatest(1, max(idx) - min(idx)), 6) AS slope
FROM path GROUP BY entity""")
def w05s(t):
    shape = scoring.trajectory_shape(scoring.trajectory(px.entity_seasons(t), px.context(t)))
    return shape.select("entity", F.round("total", 6).alias("total"), "run", F.round("slope", 6).alias("slope"))


cte("gaps", "SELECT entity, date_diff('day', lag(date) OVER (PARTITION BY entity ORDER BY date, event), date) AS gap FROM wins")


@query("w06_longest_drought", "SELECT entity, CAST(max(gap) AS INTEGER) AS longest_drought, count(*) AS wins FROM gaps GROUP BY entity")
def w06(t):
    return careers.longest_drought(px.wins(t))


@query("w10_contiguous_runs", """
WITH o AS (SELECT c.season, c.idx, CASE WHEN pre_epoch THEN 'early' WHEN season >= 2000 THEN 'late' ELSE 'middle' END AS era FROM ctx c),
f AS (SELECT *, CASE WHEN era = lag(era) OVER (ORDER BY idx) THEN 0 ELSE 1 END AS start FROM o),
r AS (SELECT *, sum(start) OVER (ORDER BY idx) AS run FROM f)
SELECT CAST(run AS BIGINT) AS run, era, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM r GROUP BY run, era""")
def w10(t):
    era = F.when(F.col("pre_epoch"), "early").when(F.col("season") >= 2000, "late").otherwise("middle")
    rows = px.context(t).select("idx", era.alias("era"))
    return boards.contiguous_runs(rows, [], "idx", ["era"]).groupBy("run", "era").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))


@query("w10_event_runs", """
WITH d AS (SELECT entity, event, place <= 10 AS top FROM placement),
f AS (SELECT *, CASE WHEN top IS NOT DISTINCT FROM lag(top) OVER (PARTITION BY entity ORDER BY event) THEN 0 ELSE 1 END AS start FROM d),
r AS (SELECT *, sum(start) OVER (PARTITION BY entity ORDER BY event) AS run FROM f)
SELECT entity, CAST(run AS BIGINT) AS run, top, count(*) AS events, min(event) AS first_event FROM r GROUP BY entity, run, top""")
def w10e(t):
    rows = px.placement(t).select("entity", "event", (F.col("place") <= 10).alias("top"))
    return boards.contiguous_runs(rows, ["entity"], "event", ["top"]).groupBy("entity", "run", "top").agg(
        F.count(F.lit(1)).alias("events"), F.min("event").alias("first_event"))


cte("career", """
SELECT s.entity, s.adjusted, s.adjusted_post, s.wins, s.titles, s.seasons, p.events, p.place_x2_sum, p.finals, p.deep_runs,
  c.career_years, p.wins / p.events AS win_rate, pk.wins / pk.denom AS peak_share
FROM scored s JOIN psum p ON p.entity = s.entity AND p.season IS NULL JOIN careers c ON c.entity = s.entity
JOIN (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY entity ORDER BY wins * (3960 // denom) DESC, idx) = 1) pk ON pk.entity = s.entity""")


def career_table(t):
    """One row per winning entity with the figures the boards filter and order by."""
    seasons, ctx = px.entity_seasons(t), px.context(t)
    multiple = scoring.common_multiple(ctx)
    placed = scoring.placement_summary(px.placement(t).withColumn("place_x2", F.col("place") * 2)) \
        .where("season IS NULL").select("entity", "events", "place_x2_sum", "finals", "deep_runs", "win_rate")
    return (scoring.opportunity_share(seasons, ctx, multiple)
            .select("entity", "adjusted", "adjusted_post", "wins", "titles", "seasons")
            .join(placed, "entity")
            .join(scoring.career_span(px.entity_event(t)).select("entity", "career_years"), "entity")
            .join(scoring.peak_season(seasons, multiple).select("entity", "peak_share"), "entity"))


@query("w12_best_in_row", """
WITH m AS (UNPIVOT (SELECT entity, adjusted, CAST(wins AS DOUBLE) AS wins, CAST(titles AS DOUBLE) AS titles, win_rate,
    place_x2_sum / events AS average_x2, peak_share FROM career) ON adjusted, wins, titles, win_rate, average_x2, peak_share INTO NAME metric VALUE value),
b AS (SELECT metric, CASE WHEN metric = 'average_x2' THEN min(value) ELSE max(value) END AS best,
  count(*) AS compared FROM m GROUP BY metric)
SELECT metric, round(best, 6) AS best, compared, (SELECT count(*) FROM m WHERE m.metric = b.metric AND m.value = b.best) AS holders FROM b""")
def w12(t):
    long = boards.metric_table(career_table(t).withColumn("average_x2", F.col("place_x2_sum") / F.col("events")), "entity",
                               ["adjusted", "wins", "titles", "win_rate", "average_x2", "peak_share"])
    return boards.best_in_row(long, lower_is_better=["average_x2"]).withColumn("best", F.round("best", 6))


@query("w12_leader_margin", """
SELECT max(adjusted) AS leader_value, (SELECT arg_max(entity, adjusted * 1e6 - entity * 1e-3) FROM scored) AS leader,
  max(adjusted) - (SELECT adjusted FROM scored ORDER BY adjusted DESC LIMIT 1 OFFSET 1) >= 0.05 AS decisive FROM scored""")
def w12m(t):
    return boards.leader_margin(shares(t), "adjusted", "entity", 0.05)


@query("t01_top_k_per_group", """
SELECT season, entity, wins, row_number() OVER (PARTITION BY season ORDER BY wins DESC, entity) AS position FROM es
QUALIFY position <= 8""")
def t01(t):
    return boards.top_k(px.entity_seasons(t).select("season", "entity", "wins"), ["season"], [("wins", False), ("entity", True)], 8)


@query("t02_top_k_with_ties", """
WITH r AS (SELECT entity, round(win_rate, 2) AS shown, row_number() OVER (ORDER BY win_rate DESC, entity) AS n FROM career)
SELECT entity, shown FROM r WHERE n <= 6 OR shown = (SELECT shown FROM r WHERE n = 6)""")
def t02(t):
    return boards.top_k_with_ties(career_table(t), [], "win_rate", 6, 2).select("entity", "shown")


@query("t05_named_presets", """
WITH s AS (SELECT c.*, p.run, p.slope, l.late FROM career c JOIN (SELECT entity, max(idx) - min(idx) AS run,
    sum(step) / greatest(1, max(idx) - min(idx)) AS slope FROM path GROUP BY entity) p ON p.entity = c.entity
  JOIN (SELECT entity, max(season) >= 2000 AS late FROM es GROUP BY entity) l ON l.entity = c.entity),
l AS (SELECT 'top' AS board, entity, adjusted AS value, -adjusted AS k FROM s
  UNION ALL SELECT 'fast', entity, slope, -slope FROM s WHERE adjusted >= 1
  UNION ALL SELECT 'slow', entity, slope, slope FROM s WHERE adjusted >= 1 AND run >= 2
  UNION ALL SELECT 'late', entity, adjusted, -adjusted FROM s WHERE late
  UNION ALL SELECT 'titles', entity, titles * 1000.0 + adjusted, -(titles * 1000.0 + adjusted) FROM s WHERE titles > 0)
SELECT board, entity, round(value, 6) AS value, position FROM (
  SELECT *, row_number() OVER (PARTITION BY board ORDER BY round(k, 9), entity) AS position FROM l) WHERE position <= 8""")
def t05(t):
    seasons = px.entity_seasons(t)
    shape = scoring.trajectory_shape(scoring.trajectory(seasons, px.context(t))).select("entity", "run", "slope")
    late = seasons.groupBy("entity").agg((F.max("season") >= 2000).alias("late"))
    presets = [("top", "adjusted", "TRUE", False), ("fast", "slope", "adjusted >= 1", False),
               ("slow", "slope", "adjusted >= 1 AND run >= 2", True), ("late", "adjusted", "late", False),
               ("titles", "titles * 1000.0D + adjusted", "titles > 0", False)]
    table = career_table(t).join(shape, "entity").join(late, "entity")
    return boards.filtered_boards(table, "entity", presets, 8).withColumn("value", F.round("value", 6))


@query("t06_label_candidates", """
SELECT entity FROM (SELECT entity FROM career ORDER BY round(adjusted, 9) DESC, entity LIMIT 16)
UNION SELECT entity FROM (SELECT entity FROM career ORDER BY peak_share DESC, entity LIMIT 1)
UNION SELECT entity FROM (SELECT entity FROM career ORDER BY seasons DESC, entity LIMIT 1)""")
def t06(t):
    return boards.label_candidates(career_table(t), "entity", [("adjusted", 16), ("peak_share", 1), ("seasons", 1)])


@query("u05_season_matrix", """
SELECT entity, """ + ", ".join(f"max(CASE WHEN season = {y} THEN wins / denom END) AS s{y}" for y in range(1995, 2002)) + ", "
       + ", ".join(f"coalesce(bool_or(CASE WHEN season = {y} THEN titles > 0 END), FALSE) AS title{y}" for y in range(1995, 2002))
       + " FROM es GROUP BY entity")
def u05(t):
    return boards.season_matrix(px.entity_seasons(t), list(range(1995, 2002)))


@query("u05_comparison_matrix", """
SELECT entity, season, wins, events AS entered, wins / events AS share, wins > 0 AND wins / events = best AS is_best FROM (
  SELECT *, max(wins / events) OVER (PARTITION BY season) AS best FROM psum WHERE season IS NOT NULL)""")
def u05c(t):
    summary = scoring.placement_summary(px.placement(t).withColumn("place_x2", F.col("place") * 2)).where("season IS NOT NULL")
    return boards.comparison_matrix(summary)


# Metrics of the comparison table beyond those of the career table; shown, but not ranked, are the plain volumes.
SKILL = {"kd": "sum(good) / sum(bad)", "good_per_map": "sum(good) / count(1)", "bad_per_map": "sum(bad) / count(1)", "total_per_map": "(sum(good) + sum(bad)) / count(1)",
         "stat_maps": "count(1)", "stat_events": "count(DISTINCT event)",
         "respawn_kd": "sum(CASE WHEN split = 'respawn' THEN good END) / sum(CASE WHEN split = 'respawn' THEN bad END)",
         "snd_kd": "sum(CASE WHEN split = 'snd' THEN good END) / sum(CASE WHEN split = 'snd' THEN bad END)"}
UNRANKED = ["events", "events_entered", "good_per_map", "bad_per_map", "total_per_map", "stat_maps", "stat_events"]
COMPARED = ["adjusted", "adjusted_post", "wins", "titles", "win_rate", "finals_rate", "deep_rate", "peak_share", "seasons", "events", "events_entered", "average_x2",
            "career_years", *SKILL]


@query("u06_metric_table", f"""
WITH k AS (SELECT entity, {", ".join(f"{e} AS {n}" for n, e in SKILL.items())} FROM cobs GROUP BY entity),
v AS (SELECT c.*, c.finals / c.events AS finals_rate, c.deep_runs / c.events AS deep_rate, c.place_x2_sum / c.events AS average_x2, p.events_entered, {", ".join(f"k.{n}" for n in SKILL)}
  FROM career c JOIN careers p ON p.entity = c.entity LEFT JOIN k ON k.entity = c.entity)
SELECT entity, metric, round(value, 6) AS value, metric = 'average_x2' AS lower_is_better, metric IN ({", ".join(f"'{m}'" for m in UNRANKED)}) AS no_best FROM (
  UNPIVOT (SELECT entity, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in COMPARED)} FROM v)
  ON COLUMNS(* EXCLUDE entity) INTO NAME metric VALUE value)""")
def u06(t):
    skill = px.counted_obs(t, opponent=False).groupBy("entity").agg(*[F.expr(e.replace(" / ", " * 1.0D / ")).alias(n) for n, e in SKILL.items()])
    entered = scoring.career_span(px.entity_event(t)).select("entity", "events_entered")
    table = (career_table(t).join(entered, "entity").join(skill, "entity", "left")
             .withColumn("finals_rate", F.col("finals") / F.col("events")).withColumn("deep_rate", F.col("deep_runs") / F.col("events"))
             .withColumn("average_x2", F.col("place_x2_sum") / F.col("events")))
    return boards.metric_table(table, "entity", COMPARED).select(
        "entity", "metric", F.round("value", 6).alias("value"), (F.col("metric") == "average_x2").alias("lower_is_better"),
        F.col("metric").isin(UNRANKED).alias("no_best"))
