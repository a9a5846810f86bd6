"""Weighted consensus from ballots and surveys, cross-season rollups, authored evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands, weights
from ..functions.values import ratio
from ..plans import competition_rank, competition_ranks, exact_quantile, pin, row_rank


def ballot_entries(votes: DataFrame) -> DataFrame:
    """votes(source_id, ballot_id, entity, position) -> one entry per ballot and entity with its rank and ballot size."""
    best = votes.groupBy("source_id", "ballot_id", "entity").agg(F.min("position").alias("position"))
    ranked = row_rank(best, ["ballot_id"], [("position", True), ("entity", True)])
    sizes = ranked.groupBy("ballot_id").agg(F.count(F.lit(1)).alias("size"))
    return ranked.join(sizes, "ballot_id").withColumn("points", weights.ballot_points(F.col("rank"), F.col("size")))


def ballot_weights(ballots: DataFrame) -> DataFrame:
    """ballots(source_id, ballot_id, score) -> reception weight, normalised to mean 1 in the source."""
    extremes = ballots.groupBy("source_id").agg(
        F.coalesce(F.max(F.when(F.col("score") > 0, F.col("score"))), F.lit(0)).alias("_pos"),
        F.coalesce(F.max(F.when(F.col("score") < 0, -F.col("score"))), F.lit(0)).alias("_neg"))
    raw = ballots.join(extremes, "source_id").withColumn(
        "raw_weight", weights.reception_raw(F.col("score"), F.col("_pos"), F.col("_neg"))).drop("_pos", "_neg")
    means = raw.groupBy("source_id").agg(F.avg("raw_weight").alias("_mean"))
    return raw.join(means, "source_id").withColumn("weight", F.col("raw_weight") / F.col("_mean")).drop("_mean")


def weighted_ballots(entries: DataFrame, ballot_weight: DataFrame) -> DataFrame:
    """Average ballot score per (source, entity); ballots that leave the entity out count as zero."""
    ballot_weight = pin(ballot_weight)  # one row per ballot, used twice
    totals = ballot_weight.groupBy("source_id").agg(F.sum("weight").alias("_total"), F.count(F.lit(1)).alias("ballots"))
    summed = (entries.join(ballot_weight.select("ballot_id", "weight"), "ballot_id")
              .groupBy("source_id", "entity").agg(F.sum(F.col("points") * F.col("weight")).alias("_sum")))
    return summed.join(totals, "source_id").select(
        "source_id", "entity", (F.col("_sum") / F.col("_total")).alias("score"), "ballots")


def survey_points(ranked: DataFrame) -> DataFrame:
    """ranked(source_id, entity, rank, ranking_size?) -> list points over the stated or counted size."""
    sizes = ranked.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    size = F.coalesce(F.col("ranking_size"), F.col("_n")) if "ranking_size" in ranked.columns else F.col("_n")
    return ranked.join(sizes, "source_id").select(
        "source_id", "entity", weights.ballot_points(F.col("rank"), size).alias("score"))


def survey_shares(details: DataFrame) -> DataFrame:
    """Vote share against the stated or summed total, inclusion share against the respondents."""
    totals = details.groupBy("source_id").agg(F.sum("votes").alias("_sum"))
    return details.join(totals, "source_id").withColumn(
        "vote_share", ratio(F.col("votes"), F.coalesce("total_votes", "_sum"))).withColumn(
        "inclusion_share", ratio(F.col("inclusions"), F.col("respondents"))).drop("_sum")


def source_weights(sources: DataFrame, ballot_counts: DataFrame) -> DataFrame:
    """Weight of each scored source and what is wrong with it, if anything."""
    rows = sources.join(ballot_counts, "source_id", "left").withColumn("ballots", F.coalesce("ballots", F.lit(0).cast("long")))
    base = weights.source_base_weight(F.col("kind"), F.col("ballots"), F.col("votes"), F.col("sample"),
                                      F.col("has_notes"), F.col("quality"))
    problem = (F.when(~F.col("kind").isin(weights.SURVEY, weights.CLUSTER, weights.SINGLE), "unknown kind")
               .when((F.col("kind") == weights.SINGLE) & (F.col("ballots") != 1), "needs exactly one ballot"))
    return (rows.withColumn("base_weight", base).withColumn("problem", problem)
            .withColumn("weight", F.col("base_weight") * weights.timing_multiplier(F.col("timing"))
                        * weights.season_coverage_multiplier(F.col("season_coverage"))))


def consensus(scores: DataFrame, sources: DataFrame) -> DataFrame:
    """Sum of weighted source scores per (season, entity), ranked on the score rounded to three decimals.

    scores(source_id, entity, score); sources(source_id, season, kind, weight).
    """
    rows = scores.join(sources.select("source_id", "season", "kind", "weight"), "source_id")
    def of(kind):
        return F.count_if(F.col("kind") == kind)
    total = rows.groupBy("season", "entity").agg(
        F.round(F.sum(F.col("score") * F.col("weight")), 3).alias("score"), F.count_distinct("source_id").alias("sources"),
        of(weights.SURVEY).alias("surveys"), of(weights.CLUSTER).alias("clusters"), of(weights.SINGLE).alias("singles"))
    ranked = competition_rank(total, ["season"], [("score", False)])
    return (ranked.withColumn("confidence", bands.confidence(F.col("surveys"), F.col("sources")))
            .withColumn("tier", bands.tier(F.col("rank"))))


def alias_merge(scores: DataFrame, key) -> DataFrame:
    """Scores of names that share a canonical key add up; ``key`` is a column expression over ``name``."""
    return scores.withColumn("name_key", key).groupBy("source_id", "name_key").agg(
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("merged"))


def cross_season_rollup(ranked: DataFrame, participation: DataFrame, wins: DataFrame) -> DataFrame:
    """Career consensus: season points, top-n counts, mean ranks, played seasons, wins and events."""
    rank = F.col("rank")
    per = ranked.groupBy("entity").agg(
        F.sum(weights.season_points(rank)).alias("overall"), F.count(F.lit(1)).alias("ranked_seasons"),
        F.sum(rank).alias("_rank_sum"), F.count_if(rank == 1).alias("top_1"), F.count_if(rank <= 3).alias("top_3"),
        F.count_if(rank <= 5).alias("top_5"), F.count_if(rank <= 10).alias("top_10"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(rank <= 10, F.struct("season", "rank")))),
                                 lambda s: F.concat_ws("#", s["season"], s["rank"])), ",").alias("placements"))
    seen = participation.groupBy("entity").agg(F.count_distinct("season").alias("_played"), F.count_distinct("season", "event").alias("events"))
    won = wins.groupBy("entity").agg(F.count(F.lit(1)).alias("wins"))
    rows = per.join(seen, "entity", "left").join(won, "entity", "left").fillna(0, ["_played", "events", "wins"]) \
              .withColumn("played_seasons", F.greatest("_played", "ranked_seasons"))
    unranked = F.col("played_seasons") - F.col("ranked_seasons")
    return (rows.withColumn("mean_rank_ranked", ratio(F.col("_rank_sum"), F.col("ranked_seasons")))
            .withColumn("mean_rank_played", ratio(F.col("_rank_sum") + unranked * weights.RANK_FLOOR, F.col("played_seasons")))
            .withColumn("per_played", F.col("overall") / F.col("played_seasons"))
            .withColumn("per_ranked", F.col("overall") / F.col("ranked_seasons")).drop("_rank_sum", "_played"))


# Sort keys of the three rollup orders: (column, ascending).
ROLLUP_ORDERS = {
    "by_total": [("overall", False), ("top_1", False), ("top_3", False), ("top_5", False), ("top_10", False),
                 ("mean_rank_ranked", True), ("wins", False), ("entity", True)],
    "by_played": [("per_played", False), ("overall", False), ("top_1", False), ("top_3", False), ("mean_rank_ranked", True), ("entity", True)],
    "by_ranked": [("per_ranked", False), ("overall", False), ("top_1", False), ("top_3", False), ("mean_rank_ranked", True), ("entity", True)],
}


def rollup_orders(rollup: DataFrame) -> DataFrame:
    """Position of every entity in each of the three orders."""
    stable = rollup
    for c in ("overall", "per_played", "per_ranked"):
        stable = stable.withColumn(c, F.round(c, 9))
    stable = competition_ranks(stable, [], ROLLUP_ORDERS)
    return stable.select("entity", *ROLLUP_ORDERS)


def evidence_leads(sources: DataFrame, entries: DataFrame, claims: DataFrame) -> DataFrame:
    """Unverified leads per entity, apart from the evidence: how many facts of how many sources wait, and of which status."""
    waiting = sources.where("status <> 'seeded'").select("source_id", "status")
    facts = entries.select("source_id", "entity").unionByName(claims.select("source_id", "entity")).join(waiting, "source_id")
    return facts.groupBy("entity").agg(F.count(F.lit(1)).alias("leads"), F.count_distinct("source_id").alias("sources"),
                                       F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"))


def evidence_summary(sources: DataFrame, entries: DataFrame, claims: DataFrame, name_key=None) -> DataFrame:
    """Authored evidence per entity: sources, families, list ranks, claims and tags; leads stay out.

    sources(source_id, status, family, season); entries(source_id, entity, rank, tags); claims(source_id, entity, tags).
    """
    seeded = sources.where("status = 'seeded'").select("source_id", "family", "season")
    listed = entries.join(seeded, "source_id").withColumn("is_claim", F.lit(False))
    claimed = claims.join(seeded, "source_id").withColumn("is_claim", F.lit(True)).withColumn("rank", F.lit(None).cast("int"))
    cols = ["source_id", "family", "season", "entity", "rank", "tags", "is_claim"]
    facts = listed.select(*cols).unionByName(claimed.select(*cols))
    facts = pin(facts)  # feeds four aggregations
    all_time = (F.col("family") == "authored_all_time_ranking") & ~F.col("is_claim")
    in_title = (F.col("family") == "authored_title_ranking") & ~F.col("is_claim")
    main = facts.groupBy("entity").agg(
        F.count_distinct("source_id").alias("sources"), F.count_distinct("family").alias("families"),
        F.count_if(~F.col("is_claim")).alias("rankings"), F.count_if("is_claim").alias("claims"),
        F.count_if(all_time).alias("all_time_lists"), F.min(F.when(all_time, F.col("rank"))).alias("best_rank"))
    medians = exact_quantile(facts.where(all_time), ["entity"], "rank", {"median_rank": 0.5})
    tags = facts.select("entity", F.explode("tags").alias("tag")).distinct().groupBy("entity").agg(
        F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    titles = facts.where(in_title).groupBy("entity", "season").agg(F.min("rank").alias("rank")).groupBy("entity").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("season", "rank"))),
                                 lambda s: F.concat_ws("#", s["season"], s["rank"])), ",").alias("title_ranks"))
    joined = main.join(medians, "entity", "left").join(tags, "entity", "left").join(titles, "entity", "left")
    keyed = joined.withColumn("_best", F.coalesce("best_rank", F.lit(999)))
    return row_rank(keyed, [], [("all_time_lists", False), ("_best", True), ("entity", True)], "position").drop("_best")
