"""Observation statistics at several grains, the pre-aggregated lane, rate over replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio
from ..plans import bounded_parts, exact_quantile, pin, row_rank
from .boards import top_k

# Qualification minimum per split and the replacement percentile.
MIN_MAPS = {"respawn": 28, "snd": 10}
REPLACEMENT_PERCENTILE = 0.25
STRONG_PLACE = 8
#: input bytes whose totals one task expands into grains
GRAIN_BYTES = 2 * 1024 * 1024

GRAINS: dict[str, list[str]] = {
    "overall": [], "split": ["split"], "mode": ["mode"], "season": ["season"],
    "season_split": ["season", "split"], "event": ["season", "event"], "event_split": ["season", "event", "split"]}


def stat_grains(obs: DataFrame, grains: dict[str, list[str]] | None = None) -> DataFrame:
    """All grains in one aggregation over totals pre-summed to the finest combination.

    Those totals are dealt out by entity, which every grain keeps, into tasks of bounded size; the rest needs no further exchange.
    Events and teams are counted as the distinct rows of a first aggregation, which also carries all sums under the event.
    """
    grains = grains or GRAINS
    dims = ["season", "event", "mode", "split"]
    fine = obs.groupBy("entity", *dims, "team").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("maps"),
        F.count_if("won").alias("wins"), F.count("won").alias("known"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    totals = ["good", "bad", "maps", "wins", "known"]
    figures = [*totals, "first_date", "last_date"]

    def empty(c: str) -> Column:
        return F.lit(None).cast(fine.schema[c].dataType)

    def entry(name: str, keys: list[str], by_team: bool) -> Column:
        kept = [(F.col(d) if d in keys else empty(d)).alias(d) for d in dims]
        counted = [empty("event").alias("_event"), F.col("team").alias("_team")] if by_team else [F.col("event").alias("_event"), empty("team").alias("_team")]
        return F.struct(F.lit(name).alias("grain"), F.lit(by_team).alias("_by_team"), *kept, *counted,
                        *[(empty(c) if by_team else F.col(c)).alias(c) for c in figures])

    entries = F.array(*[entry(name, keys, by_team) for name, keys in grains.items() for by_team in (False, True)])
    long = fine.repartition(bounded_parts(fine, GRAIN_BYTES), "entity").select("entity", F.explode(entries).alias("_e")).select("entity", "_e.*")

    def summed(*more: Column) -> list[Column]:
        return [*[F.sum(c).alias(c) for c in totals], F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), *more]

    groups = ["entity", *dims, "grain"]
    distinct = long.groupBy(*groups, "_by_team", "_event", "_team").agg(*summed())
    grouped = distinct.groupBy(*groups).agg(*summed(F.count("_event").alias("events"), F.count("_team").alias("teams")))
    return (grouped.withColumn("total", F.col("good") + F.col("bad"))
            .withColumn("ratio", F.round(ratio(F.col("good"), F.col("bad")), 3))
            .withColumn("losses", F.col("known") - F.col("wins"))
            .withColumn("win_rate", ratio(F.col("wins"), F.col("known"))).drop("known"))


def legacy_events(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (entity, season, event): the last by ``order`` wins."""
    fields = [c for c in rows.columns if c not in ("entity", "season", "event")]
    last = F.max_by(F.struct(*fields), F.struct(*order))
    return rows.groupBy("entity", "season", "event").agg(last.alias("r")).select("entity", "season", "event", "r.*")


def legacy_totals(rows: DataFrame) -> DataFrame:
    """Events and maps per season and in total; the maps add every row, repeated events included."""
    grouped = rows.rollup("entity", "season").agg(
        F.grouping_id().alias("_gid"), F.count_distinct("event").alias("events"), F.sum("maps").alias("maps"))
    return grouped.where("_gid < 3").drop("_gid")


def with_places(obs: DataFrame, places: DataFrame) -> DataFrame:
    """Attach the opponent's and the own team's placement at the event.

    places(season, event, team, place) is unique per team and event.
    """
    opponent = places.select("season", "event", F.col("team").alias("team_vs"), F.col("place").alias("opponent_place"))
    own = places.select("season", "event", "team", F.col("place").alias("own_place"))
    return obs.join(opponent, ["season", "event", "team_vs"], "left").join(own, ["season", "event", "team"], "left")


def replacement_buckets(obs: DataFrame) -> DataFrame:
    """Totals per (season, split, entity), with opponent figures where known."""
    known = F.col("opponent_place")
    return obs.groupBy("season", "split", "entity").agg(
        F.count(F.lit(1)).alias("maps"), F.sum("good").alias("good"), F.sum("bad").alias("bad"),
        F.count_distinct("event").alias("events"),
        F.percentile(known, F.lit(0.5)).alias("median_opponent"),  # buffers distinct placements only
        F.count(known).alias("opponent_maps"), F.count_if(known <= STRONG_PLACE).alias("_strong"))


def rate_over_replacement(obs: DataFrame, roles: DataFrame | None = None,
                          min_maps: dict[str, int] | None = None) -> DataFrame:
    """Good per map above the 25th-percentile qualified entity of the same season and split.

    obs carries ``opponent_place`` (see ``with_places``); roles(entity, season, role) is optional.
    """
    minimum = F.create_map(*[F.lit(x) for item in (min_maps or MIN_MAPS).items() for x in item])
    buckets = pin(replacement_buckets(obs)).withColumn("rate", ratio(F.col("good"), F.col("maps"))) \
        .withColumn("_ok", F.col("maps") >= F.try_element_at(minimum, F.col("split")))
    sizes = buckets.groupBy("season", "split").agg(F.count_if("_ok").alias("qualified"), F.count(F.lit(1)).alias("with_maps"))
    fit = buckets.where("_ok").drop("_ok")
    base = exact_quantile(fit, ["season", "split"], "rate", {"replacement": REPLACEMENT_PERCENTILE})
    scored = (fit.join(base, ["season", "split"]).join(sizes, ["season", "split"])
              .withColumn("value", F.col("rate") - F.col("replacement"))
              .withColumn("total_value", F.col("value") * F.col("maps"))
              .withColumn("ratio", ratio(F.col("good"), F.col("bad")))
              .withColumn("strong_share", ratio(F.col("_strong"), F.col("opponent_maps"))).drop("_strong")
              .withColumn("shown", F.round("value", 3)))
    ranked = row_rank(scored, ["season", "split"], [("shown", False), ("maps", False), ("entity", True)]).drop("shown")
    if roles is None:
        return ranked
    return ranked.join(roles.select("entity", "season", "role"), ["entity", "season"], "left") \
        .fillna("Unknown", ["role"])


def metric_over_replacement(obs: DataFrame, config: DataFrame, percentile: float = REPLACEMENT_PERCENTILE) -> DataFrame:
    """Every (metric, split, tier, min_maps) row of ``config`` scored in one job.

    Split ``overall`` covers all observations; metric ``good`` or ``total`` is taken per map.
    """
    per = obs.groupBy("season", "split", "entity", "event").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("maps"), F.count_if("won").alias("wins"))
    both = per.withColumn("split", F.explode(F.array(F.col("split"), F.lit("overall"))))
    buckets = both.groupBy("season", "split", "entity").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("maps").alias("maps"), F.sum("wins").alias("wins"),
        F.count_distinct("event").alias("events"))
    fit = buckets.join(config, "split").where("maps >= min_maps").withColumn(
        "rate", ratio(F.when(F.col("metric") == "good", F.col("good")).otherwise(F.col("good") + F.col("bad")), F.col("maps")))
    keys = ["season", "metric", "split", "tier"]
    base = exact_quantile(fit, keys, "rate", {"replacement": percentile})
    return (fit.join(base, keys).withColumn("value", F.col("rate") - F.col("replacement"))
            .withColumn("total_value", F.col("value") * F.col("maps")).drop("min_maps"))


def ranked_variants(scored: DataFrame) -> DataFrame:
    shown = scored.withColumn("shown", F.round("value", 9))
    return row_rank(shown, ["season", "metric", "split", "tier"], [("shown", False), ("entity", True)]).drop("shown")


def threshold_stability(scored: DataFrame, tiers: Sequence[str], k: int = 10) -> DataFrame:
    """Entities in the top k of any tier with their rank in each."""
    best = top_k(scored.withColumn("shown", F.round("value", 9)), ["season", "metric", "split", "tier"],
                 [("shown", False), ("entity", True)], k, "rank")
    return best.groupBy("season", "metric", "split", "entity").agg(
        *[F.max(F.when(F.col("tier") == t, F.col("rank"))).alias(f"rank_{t}") for t in tiers])


def event_trace(obs: DataFrame, qualified: DataFrame) -> DataFrame:
    """Event totals for qualified (season, split, entity) rows, with the earliest date and own place."""
    kept = obs.join(qualified.select("season", "split", "entity"), ["season", "split", "entity"], "left_semi")
    return kept.groupBy("season", "split", "entity", "event").agg(
        F.min("date").alias("date"), F.sum("good").alias("good"), F.sum("bad").alias("bad"),
        F.count(F.lit(1)).alias("maps"), F.max("own_place").alias("own_place"))


def map_trace(obs: DataFrame, qualified: DataFrame) -> DataFrame:
    """Every map of qualified (season, split, entity) rows, with its order inside the event by date, series and map."""
    kept = obs.join(qualified.select("season", "split", "entity"), ["season", "split", "entity"], "left_semi")
    rows = kept.select("season", "split", "entity", "event", "date", "series", "line", "good", "bad")
    return row_rank(rows, ["season", "split", "entity", "event"], [("date", True), ("series", True), ("line", True), ("good", True), ("bad", True)], "position")


def with_baseline(board: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add one value-0 row per group that stands for the replacement level."""
    return board.unionByName(baseline, allowMissingColumns=True)


def union_lanes(map_rows: DataFrame, legacy: DataFrame) -> DataFrame:
    """Map-row events and legacy-only events in one list, each badged with its source type.

    A legacy aggregate is attached beside a map-row event when it covers more maps, and
    stands alone when there is no map-row event.
    """
    keys = ["entity", "season", "event"]
    beside = legacy.select(*keys, F.col("maps").alias("_maps"), F.col("ratio").alias("_ratio"))
    more = F.col("_maps") > F.col("maps")
    current = (map_rows.withColumn("source_type", F.lit("mapRows")).join(beside, keys, "left")
               .withColumn("legacy_maps", F.when(more, F.col("_maps")))
               .withColumn("legacy_ratio", F.when(more, F.col("_ratio"))).drop("_maps", "_ratio"))
    alone = legacy.join(map_rows, keys, "left_anti").withColumn("source_type", F.lit("legacyAggregate"))
    return current.unionByName(alone, allowMissingColumns=True)


def histogram(df: DataFrame, groups: Sequence[str], value: str, bins: int = 18) -> DataFrame:
    """Counts in equal-width bins between the group's extremes; the last bin is closed."""
    edges = df.groupBy(*groups).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    index: Column = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width)).cast("int")
    return df.join(edges, list(groups)).withColumn("bin", index).groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"))
