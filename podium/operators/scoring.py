"""Opportunity-normalised scoring: season context, exact shares, peaks, ranks, selections.

A season's wins are divided by the events that could be won in it.  Shares are kept as
integer numerators over one common denominator, so equal careers tie exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import average_from_x2, ratio
from ..plans import competition_ranks

EXACT = "decimal(38,0)"


def season_context(events: DataFrame, epoch: int | None = None,
                   overrides: Mapping[int, int] | None = None,
                   as_of: str | None = None) -> DataFrame:
    """events(season, event, date) -> one row per season with a played event.

    ``held`` counts events played by the cut-off, ``scheduled`` all of them, ``denom`` is
    the override or the schedule.  A null date is still to come unless ``as_of`` is given,
    when it counts as already played.
    """
    done = F.col("date").isNotNull() if as_of is None else (
        F.col("date").isNull() | (F.col("date") <= F.lit(as_of).cast("date")))
    seasons = (events.groupBy("season")
               .agg(F.count_if(done).alias("held"), F.count(F.lit(1)).alias("scheduled"),
                    F.min(F.when(done, F.col("date"))).alias("first_date"))
               .where("held > 0"))
    override = F.lit(None).cast("bigint")
    if overrides:
        pairs = [F.lit(x) for item in overrides.items() for x in item]
        override = F.try_element_at(F.create_map(*pairs), F.col("season")).cast("bigint")
    # One row per season: a calendar-sized table, so a single-partition window is bounded.
    order = W.orderBy(F.col("first_date").asc_nulls_last(), "season")
    return (seasons
            .withColumn("denom", F.coalesce(override, F.col("scheduled")))
            .withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
            .withColumn("pre_epoch", F.lit(False) if epoch is None else F.col("season") < epoch))


def mean_denominators(context: DataFrame) -> DataFrame:
    """One row: mean denominator over all seasons and over post-epoch seasons."""
    return context.agg(
        ratio(F.sum("denom"), F.count(F.lit(1))).alias("mean_all"),
        ratio(F.sum(F.when(~F.col("pre_epoch"), F.col("denom"))), F.count_if(~F.col("pre_epoch"))).alias("mean_post"))


def common_multiple(context: DataFrame) -> int:
    """Least common multiple of the distinct denominators (a handful of scalars)."""
    values = [r[0] for r in context.select("denom").distinct().collect()]
    multiple = math.lcm(*[int(v) for v in values]) if values else 1
    if multiple >= 10 ** 18:
        raise ValueError("denominators have no usable common multiple")
    return multiple


def entity_season(wins: DataFrame, context: DataFrame) -> DataFrame:
    """wins(entity, season, championship) -> wins, titles and denominator per entity and season."""
    counted = wins.groupBy("entity", "season").agg(
        F.count(F.lit(1)).alias("wins"), F.count_if("championship").alias("titles"))
    return counted.join(context.select("season", "denom", "held", "idx", "pre_epoch"), "season")


def exact_numerator(multiple: int) -> Column:
    return F.expr(f"wins * ({multiple}L div denom)").cast(EXACT)


def opportunity_share(seasons: DataFrame, context: DataFrame, multiple: int | None = None) -> DataFrame:
    """Exact career share per entity: numerators over ``multiple`` for all and post-epoch seasons."""
    multiple = multiple or common_multiple(context)
    part = exact_numerator(multiple)
    total = seasons.groupBy("entity").agg(
        F.sum(part).cast(EXACT).alias("numer"),
        F.coalesce(F.sum(F.when(~F.col("pre_epoch"), part)), F.lit(0)).cast(EXACT).alias("numer_post"),
        F.sum("wins").alias("wins"), F.sum("titles").alias("titles"), F.count(F.lit(1)).alias("seasons"))
    return (total.crossJoin(F.broadcast(mean_denominators(context)))  # one row
            .withColumn("multiple", F.lit(multiple))
            .withColumn("adjusted", F.col("numer").cast("double") / multiple * F.col("mean_all"))
            .withColumn("adjusted_post", F.col("numer_post").cast("double") / multiple * F.col("mean_post"))
            .drop("mean_all", "mean_post"))


def leaderboard(shares: DataFrame) -> DataFrame:
    """Competition ranks on exact values plus the movement against the raw ranking."""
    ranked = competition_ranks(shares, [], {"raw_rank": [("wins", False)], "adjusted_rank": [("numer", False)], "post_rank": [("numer_post", False)]})
    return (ranked.withColumn("rank_change", F.col("raw_rank") - F.col("adjusted_rank"))
            .withColumn("value_change", F.col("adjusted") - F.col("wins")))


def peak_season(seasons: DataFrame, multiple: int, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Best single-season share; the earliest season wins a tie."""
    key = F.struct(exact_numerator(multiple), -F.col("idx"))
    return seasons.groupBy(*by).agg(
        F.max_by(F.struct("season", "wins", "denom"), key).alias("best")).select(
        *by, F.col("best.season").alias("peak_season"), F.col("best.wins").alias("peak_wins"),
        F.col("best.denom").alias("peak_denom"),
        ratio(F.col("best.wins"), F.col("best.denom")).alias("peak_share"))


def recompute_for_selection(seasons: DataFrame, context: DataFrame, selection: DataFrame,
                            multiple: int, ring_weight: int = 1,
                            bonus: DataFrame | None = None,
                            placements: DataFrame | None = None) -> DataFrame:
    """Scores of every entity under many season selections at once.

    selection(selection_id, season); bonus(entity, season, wins, titles) adds hypothetical
    results; placements(entity, season, place_x2) adds events entered, average place and wins an event, which
    the bonus does not change.  The mean denominator covers the selected seasons only; entities without a win
    in the selection are dropped.  ``weighted_key`` orders exactly when championships count
    ``ring_weight`` times.
    """
    cols = ["entity", "season", "wins", "titles"]
    rows = seasons.select(*cols)
    if bonus is not None:
        rows = rows.unionByName(bonus.select(*cols)).groupBy("entity", "season").agg(
            F.sum("wins").alias("wins"), F.sum("titles").alias("titles"))
    rows = rows.join(context.select("season", "denom", "idx"), "season")
    chosen = selection.join(context.select("season", "denom"), "season")
    scale = chosen.groupBy("selection_id").agg(F.sum("denom").alias("denom_sum"), F.count(F.lit(1)).alias("n_seasons"))
    part = exact_numerator(multiple)
    key = F.struct(part, -F.col("idx"))
    per = (rows.join(selection, "season").groupBy("selection_id", "entity")
           .agg(F.sum("wins").alias("wins"), F.sum("titles").alias("titles"),
                F.sum(part).cast(EXACT).alias("numer"), F.count_if(F.expr("wins > 0")).alias("eras"),
                F.max_by("season", key).alias("peak_season"),
                F.min(F.when(F.col("wins") > 0, F.col("season"))).alias("first_season"), F.max(F.when(F.col("wins") > 0, F.col("season"))).alias("last_season"),
                F.max(part).cast(EXACT).alias("peak_numer"))
           .where("wins > 0").join(scale, "selection_id"))
    mean = ratio(F.col("denom_sum"), F.col("n_seasons"))
    extra = F.lit(ring_weight - 1)
    scored = (per
              .withColumn("adjusted", F.col("numer").cast("double") / multiple * mean)
              .withColumn("peak", F.col("peak_numer").cast("double") / multiple * mean)
              .withColumn("weighted", F.col("adjusted") + F.col("titles") * extra)
              .withColumn("weighted_key", (F.col("numer") * F.col("denom_sum") + F.col("titles") * extra
                                           * F.lit(multiple) * F.col("n_seasons")).cast(EXACT))
              .drop("denom_sum", "n_seasons", "peak_numer"))
    scored = competition_ranks(scored, ["selection_id"], {"adjusted_rank": [("weighted_key", False)], "raw_rank": [("wins", False)]})
    scored = scored.withColumn("rank_change", F.col("raw_rank") - F.col("adjusted_rank"))
    if placements is None:
        return scored
    entered = placements.join(selection, "season").groupBy("selection_id", "entity").agg(F.count(F.lit(1)).alias("events"), F.sum("place_x2").alias("_x2"))
    return (scored.join(entered, ["selection_id", "entity"], "left").withColumn("average_place", average_from_x2(F.col("_x2"), F.col("events")))
            .withColumn("conversion", ratio(F.col("wins"), F.col("events"))).drop("_x2"))


def win_span(wins: DataFrame, date: str = "date") -> DataFrame:
    """Years from first to last win inclusive and number of seasons won."""
    year = F.year(date)
    return wins.groupBy("entity").agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        (F.max(year) - F.min(year) + 1).alias("span_years"), F.count_distinct("season").alias("seasons_won"))


def career_span(participation: DataFrame) -> DataFrame:
    """First and last date entered, won or not, and events entered."""
    first, last = F.min("date"), F.max("date")
    return participation.groupBy("entity").agg(
        first.alias("first_date"), last.alias("last_date"),
        (F.year(last) - F.year(first)).alias("career_years"), F.count(F.lit(1)).alias("events_entered"))


def placement_summary(rows: DataFrame) -> DataFrame:
    """rows(entity, season, place_x2, place) -> per season and career (null season) placement figures."""
    grouped = rows.rollup("entity", "season").agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("events"), F.sum("place_x2").alias("place_x2_sum"),
        F.count_if(F.expr("place = 1")).alias("wins"), F.count_if(F.expr("place <= 2")).alias("finals"),
        F.count_if(F.expr("place <= 4")).alias("deep_runs")).where("_gid < 3").drop("_gid")
    return (grouped.withColumn("average_place", average_from_x2(F.col("place_x2_sum"), F.col("events")))
            .withColumn("win_rate", ratio(F.col("wins"), F.col("events")))
            .withColumn("finals_rate", ratio(F.col("finals"), F.col("events")))
            .withColumn("deep_rate", ratio(F.col("deep_runs"), F.col("events"))))


def trajectory(seasons: DataFrame, context: DataFrame) -> DataFrame:
    """Running adjusted total per entity in season order; a window holds one row per season."""
    w = W.partitionBy("entity").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    means = F.broadcast(mean_denominators(context))
    return (seasons.crossJoin(means)
            .withColumn("step", ratio(F.col("wins"), F.col("denom")) * F.col("mean_all"))
            .withColumn("cumulative", F.sum("step").over(w))
            .select("entity", "season", "idx", "step", "cumulative"))


def trajectory_shape(path: DataFrame) -> DataFrame:
    """Total, run length in seasons and slope of each trajectory."""
    run = F.max("idx") - F.min("idx")
    return path.groupBy("entity").agg(
        F.sum("step").alias("total"), run.alias("run"),
        (F.sum("step") / F.greatest(F.lit(1), run)).alias("slope"))


def era_selection(context: DataFrame, late_from: int) -> DataFrame:
    """(selection_id, season): every season in ``all``, its own era, and ``post`` when post-epoch."""
    era = F.when(F.col("pre_epoch"), "early").when(F.col("season") >= late_from, "late").otherwise("middle")
    labels = F.array_compact(F.array(F.lit("all"), era, F.when(~F.col("pre_epoch"), F.lit("post"))))
    return context.select("season", F.explode(labels).alias("selection_id"))


def won_events(wins: DataFrame) -> DataFrame:
    """Won events with team per entity and season, in event order; bounded by a season's schedule."""
    return wins.groupBy("entity", "season").agg(F.sort_array(F.collect_list(F.struct("event", "team"))).alias("won"))
