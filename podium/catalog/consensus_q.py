"""Queries for consensus and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, weights
from ..operators import consensus
from ..plans import competition_rank
from . import proxies as px
from .quality_q import evidence
from .registry import Tables, cte, query

KIND = ("CASE WHEN priority LIKE '1%' THEN 'community_aggregate_survey' WHEN priority < '4' THEN 'community_thread_cluster'"
        " ELSE 'single_community_ballot' END")
TIMING = "CASE season % 4 WHEN 0 THEN 'contemporaneous' WHEN 1 THEN 'near_contemporaneous' WHEN 2 THEN 'late_retrospective' ELSE '' END"
COVERAGE = "CASE season % 3 WHEN 0 THEN 'end_of_title' WHEN 1 THEN 'late_season' ELSE 'mid_season' END"


def all_ballots(t: Tables):
    return t.once("all_ballots", _all_ballots)


def _all_ballots(t: Tables):
    """One ballot per order with lines; sources are (season, priority), and each single ballot is a source of its own."""
    placed = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = t("orders").join(placed, "o_orderkey", "left_semi").selectExpr(
        "o_orderkey AS ballot_id", "year(o_orderdate) AS season", "o_orderpriority AS priority",
        "CAST(floor(o_totalprice) AS INT) % 101 - 50 AS score")
    source = f"concat(season, ':', priority, CASE WHEN {KIND} = 'single_community_ballot' THEN concat(':', ballot_id) ELSE '' END)"
    return rows.selectExpr(f"{source} AS source_id", "ballot_id", "season", "priority", "score", f"{KIND} AS kind")


def ballots(t: Tables):
    """All ballots but the surveys' answers, which are tallied as votes."""
    return all_ballots(t).where("kind <> 'community_aggregate_survey'")


cte("allballots", f"""
SELECT season || ':' || priority || CASE WHEN {KIND} = 'single_community_ballot' THEN ':' || ballot_id ELSE '' END AS source_id, *, {KIND} AS kind FROM (
  SELECT o_orderkey AS ballot_id, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority AS priority, CAST(floor(o_totalprice) AS INTEGER) % 101 - 50 AS score
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
cte("ballots", "SELECT * FROM allballots WHERE kind <> 'community_aggregate_survey'")


def votes(t: Tables, chosen):
    lines = t("lineitem").select(F.col("l_orderkey").alias("ballot_id"), F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("position"))
    return lines.join(chosen.select("ballot_id", "source_id"), "ballot_id")


cte("entries", """
SELECT *, (size + 1 - rank) / size AS points FROM (
  SELECT source_id, ballot_id, entity, row_number() OVER (PARTITION BY ballot_id ORDER BY p, entity) AS rank, count(*) OVER (PARTITION BY ballot_id) AS size
  FROM (SELECT b.source_id, b.ballot_id, l_suppkey AS entity, min(l_linenumber) AS p FROM lineitem JOIN ballots b ON b.ballot_id = l_orderkey GROUP BY 1, 2, 3))""")
cte("bweights", """
WITH m AS (SELECT source_id, greatest(max(score), 0) AS pos, greatest(-min(score), 0) AS neg FROM ballots GROUP BY 1),
r AS (SELECT b.*, CASE WHEN score > 0 THEN least(1.25, greatest(0.75, 1 + 0.25 * ln(1 + score) / ln(1 + pos)))
   WHEN score < 0 THEN least(1.25, greatest(0.75, 1 - 0.25 * ln(1 - score) / ln(1 + neg))) ELSE 1.0::DOUBLE END AS raw_weight FROM ballots b JOIN m USING (source_id))
SELECT r.*, raw_weight / avg(raw_weight) OVER (PARTITION BY source_id) AS weight FROM r""")
cte("bscores", """
SELECT e.source_id, e.entity, sum(points * weight) / any_value(t.total) AS score, any_value(t.n) AS ballots FROM entries e
JOIN bweights w ON w.ballot_id = e.ballot_id JOIN (SELECT source_id, sum(weight) AS total, count(*) AS n FROM bweights GROUP BY 1) t ON t.source_id = e.source_id
GROUP BY e.source_id, e.entity""")


def ballot_scores(t):
    chosen = ballots(t)
    return consensus.weighted_ballots(consensus.ballot_entries(votes(t, chosen)), consensus.ballot_weights(chosen))


@query("a17_ballot_entries", "SELECT source_id, ballot_id, entity, rank, size, points FROM entries")
def a17e(t):
    return consensus.ballot_entries(votes(t, ballots(t))).drop("position")


@query("w11_ballot_weights", "SELECT source_id, ballot_id, score, round(raw_weight, 8) AS raw_weight, round(weight, 8) AS weight FROM bweights")
def w11(t):
    rows = consensus.ballot_weights(ballots(t))
    return rows.select("source_id", "ballot_id", "score", F.round("raw_weight", 8).alias("raw_weight"), F.round("weight", 8).alias("weight"))


@query("w11_scale_by_max", """
SELECT season, entity, round(good / max(good) OVER (PARTITION BY season) * 100, 8) AS lane FROM (
  SELECT season, entity, CAST(sum(good) AS DOUBLE) AS good FROM cobs GROUP BY 1, 2)""")
def w11m(t):
    rows = px.counted_obs(t, opponent=False).groupBy("season", "entity").agg(F.sum("good").cast("double").alias("good"))
    best = rows.groupBy("season").agg(F.max("good").alias("best"))
    return rows.join(best, "season").select("season", "entity", F.round(F.col("good") / F.col("best") * 100, 8).alias("lane"))


@query("a17_weighted_ballots", "SELECT source_id, entity, round(score, 8) AS score, ballots FROM bscores")
def a17(t):
    return ballot_scores(t).withColumn("score", F.round("score", 8))


def survey_votes(t):
    """Surveys: every line is a vote, ranked by votes within the source."""
    chosen = all_ballots(t).where("kind = 'community_aggregate_survey'")
    tally = votes(t, chosen).groupBy("source_id", "entity").agg(
        F.count(F.lit(1)).alias("votes"), F.count_distinct("ballot_id").alias("inclusions"))
    asked = chosen.groupBy("source_id").agg(F.count(F.lit(1)).alias("respondents"))
    return competition_rank(tally.join(asked, "source_id"), ["source_id"], [("votes", False)])


cte("survey", """
SELECT *, rank() OVER (PARTITION BY source_id ORDER BY votes DESC) AS rank, count(*) OVER (PARTITION BY source_id) AS size FROM (
  SELECT b.source_id, l_suppkey AS entity, count(*) AS votes, count(DISTINCT b.ballot_id) AS inclusions, any_value(r.n) AS respondents
  FROM lineitem JOIN allballots b ON b.ballot_id = l_orderkey AND b.kind = 'community_aggregate_survey'
  JOIN (SELECT source_id, count(*) AS n FROM allballots GROUP BY 1) r ON r.source_id = b.source_id GROUP BY 1, 2)""")


@query("a20_survey_shares", """
SELECT source_id, entity, votes, votes / coalesce(CASE WHEN source_id LIKE '1996%' THEN 10000 END, sum(votes) OVER (PARTITION BY source_id)) AS vote_share,
  inclusions / respondents AS inclusion_share FROM survey""")
def a20(t):
    rows = survey_votes(t).withColumn("total_votes", F.when(F.col("source_id").startswith("1996"), 10000))
    return consensus.survey_shares(rows).select("source_id", "entity", "votes", "vote_share", "inclusion_share")


def sources(t):
    rows = all_ballots(t).groupBy("source_id", "season", "priority", "kind").agg(F.count(F.lit(1)).alias("n"))
    return rows.selectExpr(
        "source_id", "season", "kind", f"{TIMING} AS timing", f"{COVERAGE} AS season_coverage", "season * 7 % 60 AS votes",
        "CASE WHEN season % 2 = 0 THEN n END AS sample", "season = 1997 AS has_notes", "CASE WHEN season % 3 = 0 THEN 1.1D END AS quality")


def weighted_sources(t):
    counts = ballots(t).groupBy("source_id").agg(F.count(F.lit(1)).alias("ballots"))
    return consensus.source_weights(sources(t), counts)


cte("sweights", f"""
WITH s AS (SELECT source_id, season, kind, any_value(season * 7 % 60) AS votes, CASE WHEN season % 2 = 0 THEN count(*) END AS sample, season = 1997 AS notes,
   CASE WHEN season % 3 = 0 THEN 1.1 ELSE 1.0 END::DOUBLE AS quality, any_value({TIMING}) AS timing, any_value({COVERAGE}) AS cov FROM allballots GROUP BY source_id, season, kind),
c AS (SELECT source_id, count(*) AS n FROM ballots GROUP BY 1),
v AS (SELECT s.*, coalesce(c.n, 0) AS ballots, CASE WHEN votes >= 50 THEN 1.3 WHEN votes >= 25 THEN 1.2 WHEN votes >= 10 THEN 1.1 WHEN votes >= 3 THEN 1.05 ELSE 1.0 END::DOUBLE AS vm,
   CASE timing WHEN 'contemporaneous' THEN 1.2 WHEN 'near_contemporaneous' THEN 1.15 WHEN 'late_retrospective' THEN 0.9 ELSE 1.0 END::DOUBLE AS tm,
   CASE cov WHEN 'end_of_title' THEN 1.0 WHEN 'late_season' THEN 0.85 ELSE 0.6 END::DOUBLE AS cm FROM s LEFT JOIN c USING (source_id))
SELECT *, base_weight * tm * cm AS weight FROM (SELECT *, CASE kind WHEN 'community_thread_cluster' THEN least(1.5, sqrt(ballots) / 2) * vm
  WHEN 'single_community_ballot' THEN 0.5 * vm ELSE CASE WHEN sample > 0 THEN least(3.0, greatest(1.5, sqrt(sample) / 10)) WHEN notes THEN 1.75 ELSE 1.5 END * quality END AS base_weight FROM v)""")


@query("a18_source_weight", "SELECT source_id, season, kind, ballots, round(base_weight, 8) AS base_weight, round(weight, 8) AS weight, kind = 'x' AS is_problem FROM sweights")
def a18(t):
    rows = weighted_sources(t)
    return rows.select("source_id", "season", "kind", "ballots", F.round("base_weight", 8).alias("base_weight"), F.round("weight", 8).alias("weight"),
                       F.col("problem").isNotNull().alias("is_problem"))


cte("cons", """
SELECT *, rank() OVER (PARTITION BY season ORDER BY score DESC) AS rank FROM (
  SELECT w.season, s.entity, round(sum(s.score * w.weight), 3) AS score, count(DISTINCT s.source_id) AS sources,
    count(*) FILTER (w.kind = 'community_aggregate_survey') AS surveys, count(*) FILTER (w.kind = 'community_thread_cluster') AS clusters,
    count(*) FILTER (w.kind = 'single_community_ballot') AS singles
  FROM (SELECT source_id, entity, score FROM bscores UNION ALL SELECT source_id, entity, (size + 1 - rank) / size FROM survey) s
  JOIN sweights w ON w.source_id = s.source_id GROUP BY 1, 2)""")


def consensus_table(t):
    scores = ballot_scores(t).select("source_id", "entity", "score").unionByName(consensus.survey_points(survey_votes(t)))
    return consensus.consensus(scores, weighted_sources(t))


@query("a19_consensus", """
SELECT *, CASE WHEN surveys > 0 OR sources >= 5 THEN 'high' WHEN sources >= 3 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN rank = 1 THEN 'top_1' WHEN rank <= 3 THEN 'top_3' WHEN rank <= 5 THEN 'top_5' WHEN rank <= 10 THEN 'top_10' ELSE 'ranked' END AS tier FROM cons""")
def a19(t):
    return consensus_table(t)


@query("a21_alias_merge", r"""
WITH n AS (SELECT source_id, CASE entity % 3 WHEN 0 THEN 'E' || (entity % 40) WHEN 1 THEN 'e' || (entity % 40) || ' ' ELSE 'e' || (entity % 40) || ' (x)' END AS name, score FROM bscores)
SELECT source_id, name_key, round(sum(score), 8) AS score, count(*) AS merged FROM (SELECT source_id, score, CASE WHEN lower(trim(name)) = 'e5 (x)' THEN 'e5' ELSE lower(trim(name)) END AS name_key FROM n) GROUP BY 1, 2""")
def a21(t):
    named = ballot_scores(t).withColumn("name", F.expr(
        "CASE entity % 3 WHEN 0 THEN 'E' || (entity % 40) WHEN 1 THEN 'e' || (entity % 40) || ' ' ELSE 'e' || (entity % 40) || ' (x)' END"))
    merged = consensus.alias_merge(named, text.entity_key(F.col("name"), {"e5 (x)": "e5"}))
    return merged.withColumn("score", F.round("score", 8))


cte("rollup0", """
SELECT r.*, coalesce(p.events, 0) AS events, coalesce(w.wins, 0) AS wins, greatest(coalesce(p.played, 0), ranked_seasons) AS played_seasons FROM (
  SELECT entity, sum(pow(greatest(0.0, (31 - rank) / 30.0), 2.5)) AS overall, count(*) AS ranked_seasons, CAST(sum(rank) AS BIGINT) AS rsum,
    count(*) FILTER (rank = 1) AS top_1, count(*) FILTER (rank <= 3) AS top_3, count(*) FILTER (rank <= 5) AS top_5, count(*) FILTER (rank <= 10) AS top_10,
    coalesce(string_agg(CASE WHEN rank <= 10 THEN season || '#' || rank END, ',' ORDER BY season), '') AS placements FROM cons GROUP BY entity) r
LEFT JOIN (SELECT entity, count(DISTINCT season) AS played, count(DISTINCT event) AS events FROM cobs GROUP BY 1) p ON p.entity = r.entity
LEFT JOIN (SELECT entity, count(*) AS wins FROM wins GROUP BY 1) w ON w.entity = r.entity""")
cte("rolled", """
SELECT entity, ranked_seasons, top_1, top_3, top_5, top_10, placements, events, wins, played_seasons, round(overall, 9) AS overall,
  rsum / ranked_seasons AS mean_rank_ranked, (rsum + (played_seasons - ranked_seasons) * 31) / played_seasons AS mean_rank_played,
  round(overall / played_seasons, 9) AS per_played, round(overall / ranked_seasons, 9) AS per_ranked FROM rollup0""")


def rollup(t):
    return consensus.cross_season_rollup(consensus_table(t), px.entity_event(t).select("entity", "season", "event"), px.wins(t))


@query("a22_cross_season_rollup", "SELECT * FROM rolled")
def a22(t):
    rows = rollup(t)
    for c in ("overall", "per_played", "per_ranked"):
        rows = rows.withColumn(c, F.round(c, 9))
    return rows


@query("t04_rollup_orders", """
SELECT entity, row_number() OVER (ORDER BY overall DESC, top_1 DESC, top_3 DESC, top_5 DESC, top_10 DESC, mean_rank_ranked, wins DESC, entity) AS by_total,
  row_number() OVER (ORDER BY per_played DESC, overall DESC, top_1 DESC, top_3 DESC, mean_rank_ranked, entity) AS by_played,
  row_number() OVER (ORDER BY per_ranked DESC, overall DESC, top_1 DESC, top_3 DESC, mean_rank_ranked, entity) AS by_ranked FROM rolled""")
def t04(t):
    return consensus.rollup_orders(rollup(t))


@query("a23_evidence_summary", """
WITH s AS (SELECT * FROM esrc WHERE status = 'seeded'),
f AS (SELECT s.source_id, family, season, entity, rank, tags, FALSE AS claim FROM eent e JOIN s USING (source_id)
  UNION ALL SELECT s.source_id, family, season, entity, NULL, tags, TRUE FROM ecla e JOIN s USING (source_id)),
m AS (SELECT entity, count(DISTINCT source_id) AS sources, count(DISTINCT family) AS families, count(*) FILTER (NOT claim) AS rankings, count(*) FILTER (claim) AS claims,
  count(*) FILTER (NOT claim AND family = 'authored_all_time_ranking') AS all_time_lists,
  min(rank) FILTER (family = 'authored_all_time_ranking') AS best_rank, median(rank) FILTER (family = 'authored_all_time_ranking') AS median_rank FROM f GROUP BY 1),
g AS (SELECT entity, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT entity, unnest(tags) AS tag FROM f) GROUP BY 1),
h AS (SELECT entity, string_agg(season || '#' || rank, ',' ORDER BY season) AS title_ranks FROM (SELECT entity, season, min(rank) AS rank FROM f
   WHERE family = 'authored_title_ranking' AND NOT claim GROUP BY 1, 2) GROUP BY 1)
SELECT m.*, g.tags, h.title_ranks, row_number() OVER (ORDER BY all_time_lists DESC, coalesce(best_rank, 999), m.entity) AS position
FROM m LEFT JOIN g ON g.entity = m.entity LEFT JOIN h ON h.entity = m.entity""")
def a23(t):
    return consensus.evidence_summary(*evidence(t))


@query("a23_evidence_leads", """
WITH s AS (SELECT source_id, status FROM esrc WHERE status <> 'seeded'),
f AS (SELECT source_id, entity FROM eent UNION ALL SELECT source_id, entity FROM ecla)
SELECT entity, count(*) AS leads, count(DISTINCT source_id) AS sources, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM f JOIN s USING (source_id) GROUP BY entity""")
def a23l(t):
    return consensus.evidence_leads(*evidence(t))
