"""Queries for composite scoring and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, scenarios, scoring
from . import proxies as px
from .consensus_q import consensus_table
from .registry import Tables, cte, query


def lane_table(t: Tables):
    ctx = px.context(t)
    ranked = consensus_table(t).select("entity", "season", "rank")
    entities = t("supplier").select(F.col("s_suppkey").alias("entity"))
    return scenarios.lanes(entities, px.entity_seasons(t), ctx, px.entity_event(t), ranked, scoring.era_selection(ctx, 2000))


cte("consp", "SELECT entity, season, rank, pow(greatest(0.0, (31 - rank) / 30.0), 2.5) AS points FROM cons")
cte("titles_in", """
SELECT selection_id, m.mean, idx, season, entity, wins, titles, points, coalesce(wins / denom * mean, 0) + coalesce(titles, 0) * 2 AS title_input, coalesce(wins / denom * mean, 0) AS title_adjusted
FROM (SELECT entity, season, e.wins, e.titles, c.points FROM es e FULL JOIN consp c USING (entity, season)) JOIN sel USING (season)
JOIN (SELECT season, denom, idx FROM ctx) USING (season) JOIN (SELECT selection_id, sum(denom) / count(*) AS mean FROM sel JOIN ctx USING (season) GROUP BY 1) m USING (selection_id)""")
cte("peaks", """
SELECT *, (coalesce(CASE WHEN mi > 0 THEN greatest(0, title_input / mi * 100) END, 50) + coalesce(CASE WHEN mp > 0 AND points IS NOT NULL THEN greatest(0, points / mp * 100) END, 50)) / 2 AS peak_score
FROM (SELECT *, max(title_input) OVER (PARTITION BY selection_id) AS mi, max(points) OVER (PARTITION BY selection_id) AS mp FROM titles_in)""")
cte("lane_in", """
SELECT x.selection_id, s.s_suppkey AS entity, coalesce(p.adjusted, 0) AS adjusted, coalesce(p.titles, 0) AS titles, p.skill_input, coalesce(p.ws, 0) AS winning_seasons, coalesce(p.rs, 0) AS ranked_seasons,
  p.peak, p.peak_season, coalesce(n.n, 0) AS longevity_input, coalesce(p.adjusted, 0) + coalesce(p.titles, 0) * 2 AS resume_input
FROM supplier s CROSS JOIN (SELECT DISTINCT selection_id FROM sel) x
LEFT JOIN (SELECT selection_id, entity, round(sum(title_adjusted), 9) AS adjusted, CAST(sum(coalesce(titles, 0)) AS BIGINT) AS titles, sum(points) AS skill_input, count(wins) AS ws, count(points) AS rs,
   max(peak_score) AS peak, arg_max(season, round(peak_score, 9) * 1000 - idx * 1e-9) AS peak_season FROM peaks GROUP BY 1, 2) p ON p.selection_id = x.selection_id AND p.entity = s.s_suppkey
LEFT JOIN (SELECT selection_id, entity, count(DISTINCT season) AS n FROM totals JOIN sel USING (season) GROUP BY 1, 2) n ON n.selection_id = x.selection_id AND n.entity = s.s_suppkey""")
cte("laned", """
SELECT *, coalesce(CASE WHEN max(resume_input) OVER s > 0 THEN resume_input / max(resume_input) OVER s * 100 END, 50) AS resume,
  coalesce(CASE WHEN max(skill_input) OVER s > 0 THEN skill_input / max(skill_input) OVER s * 100 END, 50) AS skill,
  coalesce(CASE WHEN max(longevity_input) OVER s > 0 THEN longevity_input / max(longevity_input) OVER s * 100 END, 50) AS longevity, coalesce(peak, 50) AS peak_lane
FROM lane_in WINDOW s AS (PARTITION BY selection_id)""")


@query("m01_composite_score", """
WITH z AS (SELECT *, round(resume * 0.5 + skill * 0.3 + longevity * 0.1 + peak_lane * 0.1, 9) AS sc FROM laned WHERE winning_seasons > 0 OR ranked_seasons > 0)
SELECT selection_id, entity, round(adjusted, 6) AS adjusted, titles, round(resume, 8) AS resume, round(skill, 8) AS skill, round(longevity, 8) AS longevity, round(peak_lane, 8) AS peak, peak_season,
  round(sc, 6) AS score, row_number() OVER (PARTITION BY selection_id ORDER BY sc DESC, adjusted DESC, entity) AS position FROM z""")
def m01(t):
    rows = scenarios.composite_score(lane_table(t))
    return rows.select("selection_id", "entity", F.round("adjusted", 6).alias("adjusted"), "titles",
                       *[F.round(c, 8).alias(c) for c in ("resume", "skill", "longevity", "peak")], "peak_season", F.round("score", 6).alias("score"), "position")


@query("m02_consensus_index", """
SELECT entity, count(*) AS ranked_seasons, round(sum(points), 8) AS points, round(sum(points) / count(*), 8) AS quality, min(rank) AS best_rank, 31 - min(rank) AS best_rank_score,
  count(*) FILTER (rank <= 3) / count(*) AS top3_rate, count(*) FILTER (rank <= 5) / count(*) AS top5_rate FROM consp GROUP BY entity""")
def m02(t):
    rows = scenarios.consensus_index(consensus_table(t))
    return rows.withColumn("points", F.round("points", 8)).withColumn("quality", F.round("quality", 8))


@query("m03_lane_leaders", """
WITH l AS (SELECT selection_id, entity, unnest(['resume', 'skill', 'longevity', 'peak']) AS lane, unnest([resume_input, round(skill_input, 9), longevity_input, round(peak_lane, 9)]) AS value FROM laned)
SELECT selection_id, lane, entity AS leader, round(value, 6) AS value FROM l WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY selection_id, lane ORDER BY value DESC, entity) = 1""")
def m03(t):
    return scenarios.lane_leaders(lane_table(t)).withColumn("value", F.round("value", 6))


def scenario(t: Tables):
    """Rosters of the season's latest event, career shares, and what one more win adds."""
    ctx = px.context(t)
    multiple = scoring.common_multiple(ctx)
    shares = scoring.opportunity_share(px.entity_seasons(t), ctx, multiple).select("entity", "numer", "wins")
    target = scenarios.next_event(px.calendar(t), px.wins(t)).first()
    if target is None:  # nothing to come: no team can move
        roster = px.entity_event(t).select("team", "entity").where(F.lit(False))
        return scenarios.scenario_moves(roster, shares, 0), shares
    denom = ctx.where(F.col("season") == target["season"]).first()["denom"]
    entered = px.entity_event(t).where(F.col("season") == target["season"]).withColumn("date", F.trunc("date", "month"))
    roster = joins.latest_rows(entered).select("team", "entity")
    return scenarios.scenario_moves(roster, shares, multiple // denom), shares


cte("nextev", "SELECT s.season, s.month, s.event FROM sched s LEFT JOIN played p ON p.event = s.event WHERE p.event IS NULL ORDER BY s.event LIMIT 1")
cte("smoves", """
SELECT t.team, t.entity, coalesce(s.wins, 0) AS wins, coalesce(s.wins, 0) >= 2 AS ranked, coalesce(s.wins, 0) = 1 AS enters, CASE WHEN s.wins >= 2 THEN s.numer END AS before,
  CASE WHEN s.wins >= 1 THEN s.numer + (SELECT CAST(3960 // denom AS BIGINT) FROM ctx WHERE season = (SELECT season FROM nextev)) END AS after
FROM totals t LEFT JOIN share s ON s.entity = t.entity WHERE t.event = (SELECT max(event) FROM totals WHERE season = (SELECT season FROM nextev))""")
cte("listed", "SELECT entity, numer, rank() OVER (ORDER BY numer DESC) AS rank_before FROM share WHERE wins >= 2")
cte("boards_after", """
SELECT x.team, l.entity, coalesce(m.after, l.numer) AS value, l.rank_before, m.entity IS NOT NULL AS member FROM (SELECT DISTINCT team FROM smoves) x CROSS JOIN listed l
LEFT JOIN smoves m ON m.team = x.team AND m.entity = l.entity UNION ALL SELECT team, entity, after, NULL, TRUE FROM smoves WHERE enters""")
cte("reranked", "SELECT *, rank() OVER (PARTITION BY team ORDER BY value DESC) AS rank_after FROM boards_after")


@query("m04_scenario_ranks", """
SELECT m.team, m.entity, m.wins, m.ranked, m.enters, r.rank_before, r.rank_after, r.rank_before - r.rank_after AS rank_delta FROM smoves m LEFT JOIN reranked r ON r.team = m.team AND r.entity = m.entity AND r.member""")
def m04(t):
    moves, shares = scenario(t)
    return scenarios.scenario_ranks(moves, shares).select("team", "entity", "wins", "ranked", "enters", "rank_before", "rank_after", "rank_delta")


@query("m04_scenario_summary", """
SELECT m.team, count(*) AS players, count(*) FILTER (m.ranked) AS ranked_players, count(*) FILTER (m.enters) AS entrants, max(coalesce(r.rank_before - r.rank_after, 0)) AS best_gain
FROM smoves m LEFT JOIN reranked r ON r.team = m.team AND r.entity = m.entity AND r.member GROUP BY m.team""")
def m04s(t):
    return scenarios.scenario_summary(scenarios.scenario_ranks(*scenario(t)))


@query("m04_scenario_drops", """
SELECT team, entity, rank_before, rank_after, rank_before - rank_after AS rank_delta, row_number() OVER (PARTITION BY team ORDER BY rank_before - rank_after, rank_before, entity) AS position
FROM reranked WHERE NOT member AND rank_after > rank_before QUALIFY position <= 2""")
def m04d(t):
    return scenarios.scenario_drops(*scenario(t))


@query("j10_scenario_join", """
SELECT team, count(*) FILTER (NOT member AND rank_after > rank_before) > 0 AS moves_others, (SELECT count(*) FROM smoves m WHERE m.team = r.team AND after IS NOT NULL) AS movers FROM reranked r GROUP BY team""")
def j10(t):
    moves, shares = scenario(t)
    return scenarios.teams_that_move(moves, shares)
