"""Queries for association and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..functions.stats import pearson
from ..functions.values import ratio
from ..operators import association, boards, careers, observation, scoring
from . import functions_q as fq
from . import proxies as px
from .observation_q import config
from .quality_q import MAP_KEY, clean_group_obs, group_obs
from .registry import cte, query
from .scoring_q import career_table, shares


def corr(x, y, where="TRUE", digits=8):
    """Guarded correlation in SQL: complete pairs, three or more, variation on both sides."""
    f = f"FILTER (({x}) IS NOT NULL AND ({y}) IS NOT NULL AND {where})"
    return (f"CASE WHEN count(*) {f} >= 3 AND min({x}) {f} < max({x}) {f} AND min({y}) {f} < max({y}) {f}"
            f" THEN round(covar_pop(CAST({y} AS DOUBLE), CAST({x} AS DOUBLE)) {f} / (stddev_pop(CAST({x} AS DOUBLE)) {f} * stddev_pop(CAST({y} AS DOUBLE)) {f}), {digits}) END")


def rounded(df, digits=8, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


cte("ppath", """
SELECT c.entity, c.entity % 60 AS handle, c.event, min(c.date) AS date, min(c.team_vs) AS team, any_value(p.place) AS place
FROM cobs c JOIN placement p ON p.entity = c.entity AND p.event = c.event GROUP BY c.entity, c.event, c.map""")


@query("a24_path_features", """
WITH u AS (SELECT * FROM ppath QUALIFY row_number() OVER (PARTITION BY entity, event ORDER BY date, team, place) = 1),
r AS (SELECT entity, handle, count(*) AS attendances, count(DISTINCT team) AS distinct_teams, min(place) AS best_place,
  round(count(*) / count(DISTINCT team), 2) AS avg_tenure, round(count(*) FILTER (place <= 2) / count(*), 3) AS finals_rate,
  round(count(*) FILTER (place <= 4) / count(*), 3) AS deep_rate, round(count(*) FILTER (place = 1) / count(*), 3) AS win_rate FROM u GROUP BY 1, 2)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY handle ORDER BY attendances DESC, entity) = 1""")
def a24(t):
    rows = px.counted_obs(t).groupBy("entity", "event", "map").agg(F.min("date").alias("date"), F.min("team_vs").alias("team"))
    rows = rows.join(px.placement(t).select("entity", "event", "place"), ["entity", "event"]).withColumn("handle", F.col("entity") % 60)
    return careers.path_features(rows)


cte("sigfull", """
SELECT m.*, b.y AS best_year, b.n AS best_year_wins, c.adjusted, c.adjusted_post, c.peak_share, r.raw_rank, r.adjusted_rank, r.raw_rank - r.adjusted_rank AS rank_change,
  m.last_year - m.first_year + 1 AS win_span, round(m.titles / c.adjusted, 8) AS ring_rate, round(c.peak_share / c.adjusted, 8) AS peak_concentration,
  round(m.wins / c.adjusted, 8) AS inflation, CASE WHEN m.career_years >= 1 THEN round(c.adjusted / m.career_years, 8) END AS density FROM (
  SELECT entity, count(*) AS wins, count(*) FILTER (championship) AS titles, count(DISTINCT season) AS seasons, count(*) FILTER (pre) / count(*) AS pre_share,
   count(*) FILTER (kind LIKE '%Offline%') / count(*) AS offline_share, count(*) FILTER (kind = 'Online') / count(*) AS online_share,
   count(*) FILTER (region = 'International') / count(*) AS international_share, count(DISTINCT region) AS regions, count(*) / count(DISTINCT season) AS wins_per_season,
   CASE WHEN count(*) >= 2 THEN round(avg(pos), 8) END AS timing, CASE WHEN count(*) >= 2 THEN CAST(max(gap) AS INTEGER) END AS longest_drought,
   coalesce(max(season) FILTER (championship) - min(season) FILTER (championship), 0) AS title_span, coalesce(string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) FILTER (championship), '') AS ring_years,
   CAST(year(min(date)) AS INTEGER) AS first_year, CAST(year(max(date)) AS INTEGER) AS last_year, CAST(any_value(first_date) AS VARCHAR) AS first_played, CAST(any_value(last_date) AS VARCHAR) AS last_played,
   CASE WHEN count(*) >= 2 THEN CAST(date_diff('day', any_value(first_date), any_value(last_date)) AS INTEGER) END AS career_days, any_value(career_years) AS career_years FROM (
    SELECT w.*, e.kind, e.region, w.season < 1997 AS pre, c.career_years, c.first_date, c.last_date,
     date_diff('day', lag(w.date) OVER (PARTITION BY w.entity ORDER BY w.date, w.event), w.date) AS gap,
     CASE WHEN c.last_date > c.first_date THEN least(greatest(date_diff('day', c.first_date, w.date) / date_diff('day', c.first_date, c.last_date), 0.0), 1.0) END AS pos
     FROM wins w LEFT JOIN (SELECT event, CASE month % 3 WHEN 0 THEN 'Online' WHEN 1 THEN 'Offline' ELSE 'Offline/LAN' END AS kind,
       CASE month % 4 WHEN 0 THEN 'International' WHEN 1 THEN 'Europe' WHEN 2 THEN 'North America' END AS region FROM played) e ON e.event = w.event
     JOIN careers c ON c.entity = w.entity) GROUP BY entity) m
JOIN (SELECT * FROM (SELECT entity, CAST(year(date) AS INTEGER) AS y, count(*) AS n FROM wins GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, y) = 1) b ON b.entity = m.entity
JOIN career c ON c.entity = m.entity JOIN board r ON r.entity = m.entity""")
RATIOS = ("timing", "ring_rate", "peak_concentration", "inflation", "density")


def profiles(t):
    """Signatures of winners with their standings."""
    events = px.played(t).selectExpr("event", "CASE month % 3 WHEN 0 THEN 'Online' WHEN 1 THEN 'Offline' ELSE 'Offline/LAN' END AS kind",
                                     "CASE month % 4 WHEN 0 THEN 'International' WHEN 1 THEN 'Europe' WHEN 2 THEN 'North America' END AS region")
    won = px.wins(t).withColumn("pre_epoch", F.col("season") < px.EPOCH)
    sig = careers.signatures(won, scoring.career_span(px.entity_event(t)).drop("events_entered"), events)
    ranks = scoring.leaderboard(shares(t)).select("entity", "raw_rank", "adjusted_rank", "rank_change")
    out = careers.career_profiles(sig, career_table(t).select("entity", "adjusted", "adjusted_post", "peak_share").join(ranks, "entity"))
    return out.withColumn("first_played", F.col("first_played").cast("string")).withColumn("last_played", F.col("last_played").cast("string"))


SIGNATURES = ["entity", "wins", "titles", "seasons", "pre_share", "offline_share", "online_share", "international_share", "regions", "wins_per_season", "timing",
              "longest_drought", "title_span", "ring_years", "first_year", "last_year", "first_played", "last_played", "career_days", "career_years", "best_year",
              "best_year_wins", "raw_rank", "adjusted_rank", "rank_change", "win_span", "ring_rate", "peak_concentration", "inflation", "density"]


@query("a25_signatures", f"SELECT {', '.join(SIGNATURES)}, round(adjusted, 8) AS adjusted, round(adjusted_post, 8) AS adjusted_post, round(peak_share, 8) AS peak_share FROM sigfull")
def a25(t):
    return rounded(profiles(t).select(*SIGNATURES, "adjusted", "adjusted_post", "peak_share"), 8, *RATIOS, "adjusted", "adjusted_post", "peak_share")


# (board, metric, filter, ascending)
BOARDS = [
    ("ring_rate", "titles / adjusted", "titles >= 1 AND adjusted >= 1", False),
    ("ringless", "adjusted", "titles = 0", False),
    ("peak_heavy", "peak_share / adjusted", "adjusted >= 1", False),
    ("even_career", "peak_share / adjusted", "adjusted >= 2", True),
    ("deflated", "wins / adjusted", "wins >= 2", False),
    ("density", "adjusted / career_years", "adjusted >= 1 AND career_years >= 2", False),
    ("journeymen", "CAST(seasons AS DOUBLE)", "TRUE", False),
    ("specialists", "wins / seasons", "wins >= 2", False),
    ("converters", "win_rate", "events >= 10", False),
    ("finalists", "finals / events", "events >= 10", False),
    ("boosted", "CAST(rank_change AS DOUBLE)", "TRUE", False),
    ("penalised", "CAST(rank_change AS DOUBLE)", "TRUE", True),
    ("early_share", "pre_share", "wins >= 3", False),
    ("offline_heavy", "offline_share", "wins >= 4", False),
    ("online_heavy", "online_share", "wins >= 3", False),
    ("many_regions", "CAST(regions AS DOUBLE)", "wins >= 4", False),
    ("late_bloomers", "timing", "wins >= 4", False),
    ("prodigies", "timing", "wins >= 4", True),
    ("droughts", "CAST(longest_drought AS DOUBLE)", "wins >= 4", False),
    ("best_years", "CAST(best_year_wins AS DOUBLE)", "TRUE", False),
    ("longest_careers", "CAST(career_days AS DOUBLE)", "TRUE", False),
    ("ring_longevity", "CAST(title_span AS DOUBLE)", "titles >= 2", False),
    ("peaks", "peak_share", "TRUE", False),
]
MORE = ["win_rate", "events", "finals"]


@query("t03_filtered_boards", "WITH f AS (SELECT s.*, " + ", ".join(f"c.{m}" for m in MORE) + " FROM sigfull s JOIN career c ON c.entity = s.entity), l AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS board, entity, CAST({e} AS DOUBLE) AS value, {'1' if a else '-1'} * CAST({e} AS DOUBLE) AS k FROM f WHERE {w}"
    for n, e, w, a in BOARDS) + """)
SELECT board, entity, round(value, 6) AS value, position FROM (
  SELECT *, row_number() OVER (PARTITION BY board ORDER BY round(k, 9), entity) AS position FROM l WHERE value IS NOT NULL) WHERE position <= 8""")
def t03(t):
    table = rounded(profiles(t), 8, "timing").join(career_table(t).select("entity", *MORE), "entity")
    return boards.filtered_boards(table, "entity", BOARDS, 8).withColumn("value", F.round("value", 6))


KD = "CASE WHEN bad > 0 THEN CAST(good AS DOUBLE) / bad END"
Y = "CAST(won AS INTEGER)"
cte("rated", f"""
SELECT entity, coalesce(mode, 'all') AS mode, count(*) AS maps, count(*) FILTER (won) AS wins, CAST(sum(good) AS BIGINT) AS good, CAST(sum(bad) AS BIGINT) AS bad,
  count(DISTINCT season) AS seasons, count(*) FILTER (good > bad) AS up_maps, count(*) FILTER (good > bad AND won) AS up_wins, count(*) FILTER (good = bad) AS even_maps,
  count(*) FILTER (good = bad AND won) AS even_wins, count(*) FILTER (good < bad) AS down_maps, count(*) FILTER (good < bad AND won) AS down_wins,
  count(*) FILTER (bad > 0) AS known, {corr(KD, Y, digits=15)} AS exact_corr, {corr(KD, Y)} AS ratio_corr, {corr("good", Y)} AS good_corr, {corr("bad", Y)} AS bad_corr,
  count(DISTINCT won) AS outcomes, count(DISTINCT {KD}) AS vals
FROM vobs GROUP BY GROUPING SETS ((entity), (entity, mode))""")


@query("a26_conditional_rates", """
WITH r AS (SELECT entity, mode, known, exact_corr, maps, wins, good, bad, seasons, up_maps, up_wins, even_maps, even_wins, down_maps, down_wins, ratio_corr, good_corr, bad_corr,
  wins / maps AS win_rate, up_wins / nullif(up_maps, 0) AS win_given_up, even_wins / nullif(even_maps, 0) AS win_given_even, down_wins / nullif(down_maps, 0) AS win_given_down,
  (even_wins + down_wins) / nullif(even_maps + down_maps, 0) AS win_given_not_up, up_wins / nullif(wins, 0) AS up_given_win,
  (up_maps - up_wins) / nullif(maps - wins, 0) AS up_given_loss, down_wins / nullif(wins, 0) AS down_given_win,
  CASE WHEN outcomes < 2 THEN 'unavailable — no outcome variation' WHEN vals < 2 THEN 'unavailable — no K/D variation' WHEN maps < 10 THEN 'unstable — very small sample'
    WHEN maps < 25 THEN 'unstable — small sample' ELSE 'descriptive — larger sample' END AS status,
  CASE WHEN maps < 10 THEN 'very small sample' WHEN maps < 25 THEN 'small sample' ELSE 'descriptive' END AS stability FROM rated)
SELECT * EXCLUDE (known, exact_corr), win_given_up - win_given_not_up AS uplift, up_given_win - up_given_loss AS rate_gap,
  CASE WHEN known >= 4 AND abs(exact_corr) < 1 THEN round(tanh(atanh(exact_corr) - 1.96 / sqrt(known - 3)), 6) END AS corr_low,
  CASE WHEN known >= 4 AND abs(exact_corr) < 1 THEN round(tanh(atanh(exact_corr) + 1.96 / sqrt(known - 3)), 6) END AS corr_high FROM r""")
def a26(t):
    out = rounded(association.conditional_rates(clean_group_obs(t)), 8, "ratio_corr", "good_corr", "bad_corr")
    return rounded(out, 6, "corr_low", "corr_high")


@query("a26_overall_rates", f"""
SELECT count(*) AS rows, count(DISTINCT entity) AS entities, count(DISTINCT event) AS events, count(DISTINCT season) AS seasons, count(*) FILTER (good > bad) AS up_maps,
  count(*) FILTER (good = bad) AS even_maps, count(*) FILTER (good < bad) AS down_maps, count(*) FILTER (good > bad AND won) / count(*) FILTER (good > bad) AS win_given_up,
  count(*) FILTER (good = bad AND won) / count(*) FILTER (good = bad) AS win_given_even, count(*) FILTER (good < bad AND won) / count(*) FILTER (good < bad) AS win_given_down,
  {corr(KD, Y)} AS ratio_corr, {corr("good", Y)} AS good_corr, {corr("bad", Y)} AS bad_corr, count(DISTINCT series) AS maps FROM vobs""")
def a26o(t):
    return rounded(association.overall_rates(clean_group_obs(t), MAP_KEY), 8, "ratio_corr", "good_corr", "bad_corr")


cte("tmaps", """
SELECT a.*, b.good AS opponent_good, a.good - b.good AS difference FROM (
  SELECT series, season, mode, team, min(team_vs) AS opponent, CAST(sum(good) AS BIGINT) AS good, bool_and(won) AS won FROM vobs GROUP BY 1, 2, 3, 4) a
JOIN (SELECT series, team, CAST(sum(good) AS BIGINT) AS good FROM vobs GROUP BY 1, 2) b ON b.series = a.series AND b.team = a.opponent""")


@query("a27_team_maps", "SELECT series, team, opponent, good, opponent_good, difference, won FROM tmaps")
def a27m(t):
    return association.team_maps(clean_group_obs(t), MAP_KEY).select("series", "team", "opponent", "good", "opponent_good", "difference", "won")


@query("a27_team_rates", """
SELECT team, coalesce(mode, 'all') AS mode, count(*) AS maps, count(*) FILTER (won) AS wins, count(*) FILTER (difference > 0) AS up_maps,
  count(*) FILTER (difference > 0 AND won) AS up_wins, count(*) FILTER (difference = 0) AS tied_maps, count(*) FILTER (difference = 0 AND won) AS tied_wins,
  count(*) FILTER (difference < 0) AS down_maps, count(*) FILTER (difference < 0 AND won) AS down_wins, avg(difference) AS mean_diff, median(difference) AS median_diff,
  avg(difference) FILTER (won) AS mean_win_diff, median(difference) FILTER (won) AS median_win_diff, avg(difference) FILTER (NOT won) AS mean_loss_diff,
  median(difference) FILTER (NOT won) AS median_loss_diff, count(*) FILTER (won) / count(*) AS win_rate,
  count(*) FILTER (difference > 0 AND won) / nullif(count(*) FILTER (difference > 0), 0) AS win_given_up,
  count(*) FILTER (difference > 0 AND NOT won) / nullif(count(*) FILTER (difference > 0), 0) AS up_failure_rate,
  count(*) FILTER (difference = 0 AND won) / nullif(count(*) FILTER (difference = 0), 0) AS win_given_tied,
  count(*) FILTER (difference < 0 AND won) / nullif(count(*) FILTER (difference < 0), 0) AS win_given_down,
  count(*) FILTER (difference <= 0 AND won) / nullif(count(*) FILTER (difference <= 0), 0) AS win_given_not_up,
  count(*) FILTER (difference > 0 AND won) / nullif(count(*) FILTER (won), 0) AS up_given_win,
  count(*) FILTER (difference > 0 AND NOT won) / nullif(count(*) FILTER (NOT won), 0) AS up_given_loss,
  count(*) FILTER (difference > 0 AND won) / nullif(count(*) FILTER (difference > 0), 0) - count(*) FILTER (difference <= 0 AND won) / nullif(count(*) FILTER (difference <= 0), 0) AS uplift,
  CASE WHEN count(*) < 10 THEN 'very small sample' WHEN count(*) < 25 THEN 'small sample' ELSE 'descriptive' END AS stability
FROM tmaps GROUP BY GROUPING SETS ((team), (team, mode))""")
def a27(t):
    return association.team_rates(association.team_maps(clean_group_obs(t), MAP_KEY))


@query("a28_entity_bands", """
SELECT entity, band, CAST(list_position(['Below 0.80', '0.80–0.99', 'Exactly 1.00', '1.01–1.19', '1.20+', 'No deaths'], band) - 1 AS INTEGER) AS band_order, count(*) AS maps,
  count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, count(*) FILTER (won) / count(*) AS win_rate FROM (
  SELECT *, CASE WHEN bad = 0 THEN 'No deaths' WHEN good = bad THEN 'Exactly 1.00' WHEN good / bad < 0.8 THEN 'Below 0.80' WHEN good < bad THEN '0.80–0.99'
   WHEN good / bad < 1.2 THEN '1.01–1.19' ELSE '1.20+' END AS band FROM vobs) GROUP BY 1, 2""")
def a28(t):
    g, b = F.col("good"), F.col("bad")
    return association.band_rates(clean_group_obs(t), "entity", bands.ratio_band(g, b), bands.ratio_band_index(g, b))


@query("a28_team_bands", """
SELECT team, band, CAST(any_value(o) AS INTEGER) AS band_order, count(*) AS maps, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses,
  count(*) FILTER (won) / count(*) AS win_rate FROM (SELECT *, ['-20 or worse', '-19 to -10', '-9 to -1', 'Tied (0)', '+1 to +9', '+10 to +19', '+20 or better'][o + 1] AS band FROM (
   SELECT *, CASE WHEN difference <= -20 THEN 0 WHEN difference <= -10 THEN 1 WHEN difference < 0 THEN 2 WHEN difference = 0 THEN 3 WHEN difference < 10 THEN 4
     WHEN difference < 20 THEN 5 ELSE 6 END AS o FROM tmaps)) GROUP BY 1, 2""")
def a28t(t):
    d = F.col("difference")
    return association.band_rates(association.team_maps(clean_group_obs(t), MAP_KEY), "team", bands.difference_band(d), bands.difference_band_index(d))


@query("a29_pearson", f"""
SELECT entity, {corr("good", "bad")} AS good_bad, {corr(KD, Y)} AS ratio_win, {corr("CAST(1 AS INTEGER)", "bad")} AS constant_side, count(*) AS n FROM obs GROUP BY entity""")
def a29(t):
    rows = px.obs(t, opponent=False).groupBy("entity").agg(
        pearson(F.col("good"), F.col("bad")).alias("good_bad"), pearson(ratio(F.col("good"), F.col("bad")), F.col("won").cast("int")).alias("ratio_win"),
        pearson(F.lit(1), F.col("bad")).alias("constant_side"), F.count(F.lit(1)).alias("n"))
    return rounded(rows, 8, "good_bad", "ratio_win", "constant_side")


MINIMUM = {"overall": 10, "respawn": 8, "snd": 3}


def split_obs(t):
    return group_obs(t).withColumn("split", F.when(F.col("mode") == "Search & Destroy", "snd").otherwise("respawn"))


cte("shared", """
SELECT g.*, CASE WHEN mode = 'Search & Destroy' THEN 'snd' ELSE 'respawn' END AS split, s.n AS team_rows, CASE WHEN ok THEN g.good / s.g END AS good_share,
  CASE WHEN ok THEN g.bad / s.b END AS bad_share, CASE WHEN ok THEN (g.good + g.bad) / (s.g + s.b) END AS total_share FROM gobs g
JOIN (SELECT series, team, count(*) AS n, CAST(sum(good) AS DOUBLE) AS g, CAST(sum(bad) AS DOUBLE) AS b, count(*) >= 4 AND sum(good) > 0 AND sum(bad) > 0 AS ok
      FROM gobs GROUP BY 1, 2) s ON s.series = g.series AND s.team = g.team""")


@query("w08_team_shares", "SELECT series, entity, team, good, bad, team_rows, good_share, bad_share, total_share FROM shared")
def w08(t):
    return association.team_shares(group_obs(t), MAP_KEY).select("series", "entity", "team", "good", "bad", "team_rows", "good_share", "bad_share", "total_share")


cte("emetrics", """
SELECT * FROM (SELECT season, sp AS split, entity, count(*) AS maps, count(*) FILTER (won) AS wins, count(*) FILTER (won) / count(*) AS win_rate, sum(good) / count(*) AS good_rate,
  sum(bad) / count(*) AS bad_rate, (sum(good) + sum(bad)) / count(*) AS total_rate, CASE WHEN sum(bad) > 0 THEN sum(good) / sum(bad) END AS ratio,
  avg(good_share) AS good_share, avg(bad_share) AS bad_share, avg(total_share) AS total_share
  FROM (SELECT *, unnest([split, 'overall']) AS sp FROM shared) GROUP BY 1, 2, 3)
WHERE maps >= CASE split WHEN 'overall' THEN 10 WHEN 'respawn' THEN 8 ELSE 3 END""")


def entity_metrics(t):
    return association.entity_metrics(association.team_shares(split_obs(t), MAP_KEY), MINIMUM)


@query("a30_metric_vs_outcome", f"""
SELECT season, split, metric, {corr("value", "win_rate")} AS r, count(value) AS n FROM (
  SELECT season, split, entity, win_rate, unnest(['good_rate', 'bad_rate', 'total_rate', 'ratio', 'good_share', 'bad_share', 'total_share']) AS metric,
    unnest([good_rate, bad_rate, total_rate, ratio, good_share, bad_share, total_share]) AS value FROM emetrics) GROUP BY 1, 2, 3""")
def a30(t):
    return rounded(association.metric_vs_outcome(entity_metrics(t)), 8, "r")


def fixed_sql(metric, group):
    return f"""
WITH c AS (SELECT season, split, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y, count(*) OVER g AS n, min(x) OVER g < max(x) OVER g AS vx, min(y) OVER g < max(y) OVER g AS vy
  FROM (SELECT *, CAST({metric} AS DOUBLE) AS x, CAST({Y} AS DOUBLE) AS y FROM shared WHERE ({metric}) IS NOT NULL) WINDOW g AS (PARTITION BY season, split, {group}))
SELECT season, split, CASE WHEN bool_or(vx) AND bool_or(vy) THEN round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 8) END AS r, count(*) AS n FROM c WHERE n >= 4 GROUP BY 1, 2"""


@query("a31_same_map_effect", fixed_sql(KD, "series"))
def a31(t):
    rows = split_obs(t).withColumn("ratio", ratio(F.col("good"), F.col("bad")))
    return rounded(association.fixed_effect_corr(rows, ["season", "split"], MAP_KEY, "ratio", F.col("won").cast("int")), 8, "r")


@query("a31_event_mode_effect", fixed_sql("good_share", "event, mode, map"))
def a31e(t):
    rows = association.team_shares(split_obs(t), MAP_KEY)
    return rounded(association.fixed_effect_corr(rows, ["season", "split"], ["season", "event", "mode", "map"], "good_share", F.col("won").cast("int")), 8, "r")


cte("outcomes", """
SELECT season, entity, count(*) AS events, count(*) FILTER (place = 1) AS wins, count(*) FILTER (place <= 2) AS finals, count(*) FILTER (place <= 4) AS top4,
  sum(place) / count(*) AS average_place FROM placement GROUP BY 1, 2""")
cte("season_awards", """
SELECT CAST(substr(date, 1, 4) AS INTEGER) AS season, entity, count(*) AS awards FROM typed_awards WHERE kept AND award IS NOT NULL GROUP BY 1, 2""")


def outcomes(t):
    p = F.col("place")
    return px.placement(t).groupBy("season", "entity").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(p == 1).alias("wins"), F.count_if(p <= 2).alias("finals"), F.count_if(p <= 4).alias("top4"),
        ratio(F.sum("place"), F.count(F.lit(1))).alias("average_place"))


def season_awards(t):
    kept = fq.typed_awards(t).where("kept AND award IS NOT NULL")
    return kept.groupBy(F.substring("date", 1, 4).cast("int").alias("season"), "entity").agg(F.count(F.lit(1)).alias("awards"))


@query("a32_top_overlap", f"""
WITH v AS (SELECT season, entity, value FROM scored_variants WHERE metric = 'good' AND split = 'overall' AND tier = 'base'),
b AS (SELECT season, entity FROM v QUALIFY row_number() OVER (PARTITION BY season ORDER BY value DESC, entity) <= 10),
w AS (SELECT season, entity FROM outcomes WHERE events >= 2 QUALIFY row_number() OVER (PARTITION BY season ORDER BY wins DESC, finals DESC, average_place, entity) <= 10),
p AS (SELECT season, entity FROM outcomes WHERE events >= 2 QUALIFY row_number() OVER (PARTITION BY season ORDER BY average_place, wins DESC, entity) <= 10),
j AS (SELECT v.season, v.entity, value, average_place, coalesce(wins, 0) AS wins, coalesce(top4, 0) AS top4, coalesce(awards, 0) AS awards FROM v
  LEFT JOIN outcomes o ON o.season = v.season AND o.entity = v.entity LEFT JOIN season_awards a ON a.season = v.season AND a.entity = v.entity)
SELECT season, {corr("value", "-average_place")} AS r_place, {corr("value", "wins")} AS r_wins, {corr("value", "top4")} AS r_top4, {corr("value", "awards")} AS r_awards,
  count(*) AS n, (SELECT count(*) FROM b JOIN w USING (season, entity) WHERE b.season = j.season) AS wins_overlap,
  (SELECT count(*) FROM b JOIN p USING (season, entity) WHERE b.season = j.season) AS place_overlap,
  (SELECT count(*) FROM b JOIN season_awards USING (season, entity) WHERE b.season = j.season) AS award_overlap FROM j GROUP BY season""")
def a32(t):
    base = config(t).where("metric = 'good' AND split = 'overall' AND tier = 'base'")
    scores = observation.metric_over_replacement(px.counted_obs(t, opponent=False), base).select("season", "entity", "value")
    return rounded(association.top_overlap(scores, outcomes(t), season_awards(t)), 8, "r_place", "r_wins", "r_top4", "r_awards")


PRIOR = {"overall": 20, "respawn": 14, "snd": 5}


def run_obs(t):
    """Observations with a result, whose events alternate so that they form several runs."""
    return px.obs(t, opponent=False).where("won IS NOT NULL").withColumn("event", F.concat_ws("-", "event", (F.col("series") % 2).cast("string")))


cte("robs", """
SELECT entity, season, event || '-' || (series % 2) AS event, date, series, line, mode, map, split, good, bad, won FROM obs WHERE won IS NOT NULL""", materialized=True)
cte("runs", """
SELECT season, date, event, sum(n) OVER (PARTITION BY season ORDER BY date, event ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT season, date, event, CASE WHEN event = lag(event) OVER (PARTITION BY season ORDER BY date, event) THEN 0 ELSE 1 END AS n
  FROM (SELECT DISTINCT season, date, event FROM robs))""", materialized=True)
cte("prior", """
SELECT * EXCLUDE (oc, osg, osb, sc, ssg, ssb), CASE WHEN oc >= 20 THEN oc END AS om, CASE WHEN oc >= 20 THEN osg END AS og, CASE WHEN oc >= 20 THEN osb END AS ob,
  CASE WHEN sc >= least_maps THEN sc END AS sm, CASE WHEN sc >= least_maps THEN ssg END AS sg, CASE WHEN sc >= least_maps THEN ssb END AS sb FROM (
  SELECT r.*, u.run, CASE r.split WHEN 'snd' THEN 5 ELSE 14 END AS least_maps, count(*) OVER o AS oc, sum(good) OVER o AS osg, sum(bad) OVER o AS osb,
    count(*) OVER s AS sc, sum(good) OVER s AS ssg, sum(bad) OVER s AS ssb FROM robs r JOIN runs u ON u.season = r.season AND u.date = r.date AND u.event = r.event
  WINDOW o AS (PARTITION BY r.season, r.entity ORDER BY u.run RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    s AS (PARTITION BY r.season, r.entity, r.split ORDER BY u.run RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")


@query("w07_prior_features", """
SELECT entity, season, series, line, CAST(run AS BIGINT) AS run, CAST(om AS BIGINT) AS overall_maps, og / om AS overall_good_rate, ob / om AS overall_bad_rate, og / nullif(ob, 0) AS overall_ratio,
  CAST(sm AS BIGINT) AS split_maps, sg / sm AS split_good_rate, (sg + sb) / sm AS split_total_rate, sg / nullif(sb, 0) AS split_ratio FROM prior WHERE om IS NOT NULL OR sm IS NOT NULL""")
def w07(t):
    return association.prior_event_features(run_obs(t), PRIOR).select(
        "entity", "season", "series", "line", "run", "overall_maps", "overall_good_rate", "overall_bad_rate", "overall_ratio",
        "split_maps", "split_good_rate", "split_total_rate", "split_ratio")


@query("w07_prior_correlations", f"""
WITH x AS (SELECT season, series, og / nullif(ob, 0) AS v, {Y} AS y FROM prior WHERE om IS NOT NULL OR sm IS NOT NULL),
c AS (SELECT season, v - avg(v) OVER g AS v, y - avg(y) OVER g AS y, count(*) OVER g AS n, min(v) OVER g < max(v) OVER g AS vx, min(y) OVER g < max(y) OVER g AS vy FROM x WHERE v IS NOT NULL WINDOW g AS (PARTITION BY season, series))
SELECT s.season, s.simple, s.n, f.same_map, f.same_map_n FROM (SELECT season, {corr("v", "y")} AS simple, count(*) AS n FROM x GROUP BY 1) s
LEFT JOIN (SELECT season, CASE WHEN bool_or(vx) AND bool_or(vy) THEN round(sum(v * y) / sqrt(sum(v * v) * sum(y * y)), 8) END AS same_map, count(*) AS same_map_n FROM c WHERE n >= 4 GROUP BY 1) f ON f.season = s.season""")
def w07c(t):
    rows = association.prior_event_features(run_obs(t), PRIOR)
    y = F.col("won").cast("int")
    simple = rows.groupBy("season").agg(pearson(F.col("overall_ratio"), y).alias("simple"), F.count(F.lit(1)).alias("n"))
    within = association.fixed_effect_corr(rows, ["season"], ["season", "series"], "overall_ratio", y) \
        .withColumnsRenamed({"r": "same_map", "n": "same_map_n"})
    return rounded(simple.join(within, "season", "left"), 8, "simple", "same_map")


@query("w09_shared_percentile", """
SELECT season, entity, good, CASE WHEN count(*) OVER s = 1 THEN 100.0 ELSE (rank() OVER (PARTITION BY season ORDER BY good) - 1 + (count(*) OVER (PARTITION BY season, good) - 1) / 2)
  / (count(*) OVER s - 1) * 100 END AS percentile FROM (SELECT season, entity, CAST(sum(good) // 100 AS BIGINT) AS good FROM cobs GROUP BY 1, 2) WINDOW s AS (PARTITION BY season)""")
def w09(t):
    rows = px.counted_obs(t, opponent=False).groupBy("season", "entity").agg(F.expr("sum(good) div 100").alias("good"))
    return association.shared_percentile(rows, ["season"], "good")


@query("t07_extreme_examples", """
SELECT 'busy' AS board, season, entity, maps, win_rate, good_rate, total_rate, position FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY total_rate DESC, win_rate, entity) AS position
  FROM emetrics WHERE split = 'respawn') WHERE position <= 8
UNION ALL SELECT 'strong', season, entity, maps, win_rate, good_rate, total_rate, position FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY good_rate DESC, win_rate DESC, entity) AS position
  FROM emetrics WHERE split = 'respawn') WHERE position <= 8""")
def t07(t):
    return association.extreme_examples(entity_metrics(t).where("split = 'respawn'"))
