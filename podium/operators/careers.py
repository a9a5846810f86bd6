"""Titles, honors, droughts, teams, roles and per-entity profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import career_position, ratio
from ..plans import row_rank
from .scoring import mean_denominators


def titles_by_year(titles: DataFrame) -> DataFrame:
    """Championship events in year order with their count; one entry per season at most per entity."""
    return titles.groupBy("entity").agg(
        F.count(F.lit(1)).alias("titles"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("season", "event"))),
                                 lambda s: F.concat_ws(":", s["season"], s["event"])), ",").alias("titles_won"))


def honor_counts(awards: DataFrame) -> DataFrame:
    return awards.groupBy("entity").agg(
        F.count(F.lit(1)).alias("honors"), F.count_if(F.expr("award = 'event_mvp'")).alias("event_mvps"),
        F.count_if(F.expr("award = 'season_mvp'")).alias("season_mvps"), F.count_distinct("award").alias("kinds"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def honor_list(awards: DataFrame) -> DataFrame:
    """Every kept award with its place in the entity's list ordered by date, label, event."""
    rows = awards.withColumn("event", F.coalesce(F.nullif("event", F.lit("")), "page"))
    ordered = row_rank(rows, ["entity"], [("date", True), ("award", True), ("event", True), ("id", True)], "position")
    return ordered.select("entity", "id", "award", "year", "event", "position")


def dataset_summary(context: DataFrame, observations: DataFrame) -> DataFrame:
    early = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("pre_epoch"), F.struct("idx", "season")))),
                                     lambda s: s["season"].cast("string")), ",")
    summary = context.agg(F.count(F.lit(1)).alias("seasons"), F.sum("held").alias("events"), early.alias("pre_epoch"))
    last = observations.agg(F.max("date").cast("string").alias("as_of"))
    return summary.crossJoin(mean_denominators(context)).crossJoin(last)


def longest_drought(wins: DataFrame) -> DataFrame:
    """Longest gap in days between consecutive wins; an entity wins at most one row per event."""
    previous = F.lag("date").over(W.partitionBy("entity").orderBy("date", "event"))
    return (wins.withColumn("_gap", F.date_diff("date", previous)).groupBy("entity")
            .agg(F.max("_gap").alias("longest_drought"), F.count(F.lit(1)).alias("wins")))


def teams_in_order(rows: DataFrame) -> DataFrame:
    """Distinct teams by first appearance (name breaks a tie)."""
    firsts = rows.where("team IS NOT NULL").groupBy("entity", "team").agg(F.min("date").alias("first_date"))
    return firsts.groupBy("entity").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_date", "team"))),
                                 lambda s: s["team"].cast("string")), ",").alias("teams"),
        F.count(F.lit(1)).alias("n_teams"))


def role_summary(roles: DataFrame, keys: list[str], several: str = "Mixed", unknown: str = "Unknown") -> DataFrame:
    """One known role -> it; several -> ``several``; none -> ``unknown``."""
    known = F.when(F.col("role") != unknown, F.col("role"))
    return roles.groupBy(*keys).agg(
        F.when(F.count_distinct(known) == 0, unknown).when(F.count_distinct(known) == 1, F.min(known))
        .otherwise(several).alias("role"))


def path_features(participation: DataFrame) -> DataFrame:
    """participation(entity, handle, event, date, team, place) -> path figures per handle.

    A repeated event keeps its earliest row; identities that share a handle keep the more active one.
    """
    first = F.min_by(F.struct("date", "team", "place"), F.struct("date", "team", "place"))
    once = participation.groupBy("entity", "handle", "event").agg(first.alias("r")).select(
        "entity", "handle", "event", "r.*")
    place = F.col("place")
    per = once.groupBy("entity", "handle").agg(
        F.count(F.lit(1)).alias("attendances"), F.count_distinct("team").alias("distinct_teams"),
        F.count_if(place <= 2).alias("_finals"), F.count_if(place <= 4).alias("_deep"),
        F.count_if(place == 1).alias("_wins"), F.min("place").alias("best_place"))
    rates = per.select(
        "entity", "handle", "attendances", "distinct_teams", "best_place",
        F.round(F.coalesce(ratio(F.col("attendances"), F.col("distinct_teams")), F.lit(0.0)), 2).alias("avg_tenure"),
        F.round(ratio(F.col("_finals"), F.col("attendances")), 3).alias("finals_rate"),
        F.round(ratio(F.col("_deep"), F.col("attendances")), 3).alias("deep_rate"),
        F.round(ratio(F.col("_wins"), F.col("attendances")), 3).alias("win_rate"))
    fields = [c for c in rates.columns if c != "handle"]
    busiest = F.max_by(F.struct(*fields), F.struct("attendances", -F.col("entity")))
    return rates.groupBy("handle").agg(busiest.alias("r")).select("handle", "r.*")


def signatures(wins: DataFrame, career: DataFrame, events: DataFrame) -> DataFrame:
    """Career signatures from wins(entity, season, event, date, pre_epoch, championship), career
    (entity, first_date, last_date, career_years) and events(event, kind, region)."""
    w = W.partitionBy("entity").orderBy("date", "event")
    rows = (wins.join(events, "event", "left").join(career, "entity")
            .withColumn("gap", F.date_diff("date", F.lag("date").over(w)))
            .withColumn("position", career_position(F.col("first_date"), F.col("date"), F.col("last_date"))))
    n = F.count(F.lit(1))
    main = rows.groupBy("entity").agg(
        n.alias("wins"), F.count_if("championship").alias("titles"), F.count_distinct("season").alias("seasons"),
        ratio(F.count_if("pre_epoch"), n).alias("pre_share"),
        ratio(F.count_if(F.col("kind").contains("Offline")), n).alias("offline_share"),
        ratio(F.count_if(F.col("kind") == "Online"), n).alias("online_share"),
        ratio(F.count_if(F.col("region") == "International"), n).alias("international_share"),
        F.count_distinct("region").alias("regions"),
        ratio(n, F.count_distinct("season")).alias("wins_per_season"),
        F.when(n >= 2, F.avg("position")).alias("timing"),
        F.when(n >= 2, F.max("gap")).alias("longest_drought"),
        F.max(F.when(F.col("championship"), F.col("season"))).alias("_last_title"),
        F.min(F.when(F.col("championship"), F.col("season"))).alias("_first_title"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("championship"), F.col("season")))).cast("array<string>"), ",").alias("ring_years"),
        F.year(F.min("date")).alias("first_year"), F.year(F.max("date")).alias("last_year"),
        F.first("first_date").alias("first_played"), F.first("last_date").alias("last_played"),
        F.when(n >= 2, F.date_diff(F.first("last_date"), F.first("first_date"))).alias("career_days"),
        F.first("career_years").alias("career_years"))
    yearly = rows.groupBy("entity", F.year("date").alias("year")).agg(n.alias("n"))
    best = yearly.groupBy("entity").agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("best_year"),
                                        F.max("n").alias("best_year_wins"))
    return (main.join(best, "entity")
            .withColumn("title_span", F.coalesce(F.col("_last_title") - F.col("_first_title"), F.lit(0)))
            .drop("_last_title", "_first_title"))


def career_profiles(sig: DataFrame, board: DataFrame) -> DataFrame:
    """Signatures with the standings of board(entity, adjusted, adjusted_post, peak_share, raw_rank, adjusted_rank, rank_change)
    and the ratios of both."""
    adjusted, career = F.nullif(F.col("adjusted"), F.lit(0.0)), F.col("career_years")
    return (sig.join(board.select("entity", "adjusted", "adjusted_post", "peak_share", "raw_rank", "adjusted_rank", "rank_change"), "entity")
            .withColumn("win_span", F.col("last_year") - F.col("first_year") + 1)
            .withColumn("ring_rate", F.coalesce(F.try_divide(F.col("titles"), adjusted), F.lit(0.0)))
            .withColumn("peak_concentration", F.coalesce(F.try_divide(F.col("peak_share"), adjusted), F.lit(0.0)))
            .withColumn("inflation", F.coalesce(F.try_divide(F.col("wins"), adjusted), F.lit(0.0)))
            .withColumn("density", F.when(career >= 1, F.col("adjusted") / career)))
