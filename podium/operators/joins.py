"""Join patterns: aliases, semi/anti fills, role intervals, fallback keys, co-occurrence, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import broadcast_if_small


def alias_join(rows: DataFrame, facts: DataFrame, aliases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """facts(season, event, keys...) found under any alias(season, event, alias) of its event."""
    named = aliases.select("season", "event", "alias").unionByName(
        aliases.select("season", "event", F.col("event").alias("alias"))).distinct()
    lookup = facts.join(named, ["season", "event"]).drop("event").withColumnRenamed("alias", "event")
    return rows.join(lookup, ["season", "event", *keys], "left")


def fill_missing(rows: DataFrame, wins: DataFrame, keys: Sequence[str], filled: dict[str, object]) -> DataFrame:
    """Rows plus every win that has no row, completed with the ``filled`` values."""
    missing = wins.join(rows, list(keys), "left_anti").select(*keys)
    for name, value in filled.items():
        missing = missing.withColumn(name, F.lit(value).cast(rows.schema[name].dataType))
    return rows.unionByName(missing, allowMissingColumns=True)


def latest_rows(rows: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows equal to the maximum (date, event) of their group."""
    top = rows.groupBy(*groups).agg(F.max(F.struct("date", "event")).alias("_top"))
    cond = F.struct(rows["date"], rows["event"]) == top["_top"]
    for g in groups:
        cond = cond & (rows[g] == top[g])
    return rows.join(broadcast_if_small(top), cond, "left_semi")


def role_by_season(entity_seasons: DataFrame, stints: DataFrame, first: int, last: int, rule: str = "first",
                   unknown: str = "Unknown") -> DataFrame:
    """Role of each (entity, season) from inclusive stints; open ends reach the first / last season.

    ``first`` takes the earliest matching stint, ``unique`` needs exactly one match.  Stints are
    expanded to seasons (a calendar-bounded fan-out) so the join is an equi-join.
    """
    start = F.coalesce(F.col("start_season"), F.lit(first))
    end = F.coalesce(F.col("end_season"), F.lit(last))
    clipped = stints.withColumn("_s", F.greatest(start, F.lit(first))).withColumn("_e", F.least(end, F.lit(last))).where("_s <= _e")
    per = clipped.select("entity", "role", start.alias("_start"), end.alias("_end"),
                         F.explode(F.sequence("_s", "_e")).alias("season"))
    if rule == "first":
        pick = F.min_by("role", F.struct("_start", "_end", "role"))
    else:
        pick = F.when(F.count(F.lit(1)) == 1, F.min("role"))
    resolved = per.groupBy("entity", "season").agg(pick.alias("role"))
    return entity_seasons.join(resolved, ["entity", "season"], "left").withColumn(
        "role", F.coalesce("role", F.lit(unknown)))


def stint_violations(stints: DataFrame, entities: DataFrame, roles: Sequence[str], first: int, last: int) -> DataFrame:
    """Stints with an unknown entity, role or season, a reversed interval, or an overlap."""
    s, e = F.coalesce("start_season", F.lit(first)), F.coalesce("end_season", F.lit(last))
    previous = F.lag(e).over(W.partitionBy("entity").orderBy(s, e, "role"))
    known = entities.select("entity").distinct().withColumn("_known", F.lit(True))
    rows = stints.withColumn("_overlap", s <= previous).join(known, "entity", "left")
    outside = ~s.between(first, last) | ~e.between(first, last)
    reasons = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), "unknown entity"),
        F.when(F.col("role").isNull() | ~F.col("role").isin(list(roles)), "unknown role"),
        F.when(outside, "unknown season"),
        F.when(s > e, "starts after it ends"),
        F.when(F.col("_overlap"), "overlap")))
    return rows.withColumn("reasons", F.array_join(reasons, ",")).where("reasons <> ''") \
        .select("entity", "role", "start_season", "end_season", "reasons")


def fallback_match(rows: DataFrame, keys: str, known: DataFrame, known_key: str, id_col: str) -> DataFrame:
    """First key of the array column ``keys`` that exists in ``known``; rows without a match keep null."""
    tried = rows.select(id_col, F.posexplode(keys).alias("_pos", known_key))
    hits = tried.join(known, known_key).groupBy(id_col).agg(F.min_by(known_key, "_pos").alias("match_key"),
                                                            F.min("_pos").alias("match_position"))
    return rows.join(hits, id_col, "left")


def event_sets(members: DataFrame) -> DataFrame:
    """(entity, events, set_id): each entity's events, rarest first; equal sets share the smallest entity's id."""
    events = members.groupBy("event").agg(F.count(F.lit(1)).alias("_freq"))
    ordered = members.join(events, "event").groupBy("entity").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("_freq", "event"))), lambda s: s["event"]).alias("events"))
    ids = ordered.groupBy("events").agg(F.min("entity").alias("set_id"))
    return ordered.join(ids, "events")


def set_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(set_id, other_id): pairs of sets (set_id, events by rarity, size) that may exceed the threshold, each once.

    Sets of size s that share more than the threshold share one of their first s - ceil(threshold * s) + 1 events in rarity order.
    If a shared event is the first one, no more events than those from it on are common; places and sizes decide whether these suffice.
    An event's places and sizes are few, so they meet as classes first, and only members of classes that can suffice meet: a common event in
    large sets, which comes last in them, yields no pairs.
    """
    size, wanted = F.col("size"), F.lit(float(threshold))
    prefix = F.slice("events", 1, (size - F.ceil(wanted * size) + 1).cast("int"))
    tokens = sets.select("set_id", "size", F.posexplode(prefix).alias("place", "token"))
    classes = tokens.select("token", "size", "place").distinct()
    theirs = classes.select("token", F.col("size").alias("other_size"), F.col("place").alias("other_place"))
    most = F.least(size - F.col("place"), F.col("other_size") - F.col("other_place"))
    meet = classes.join(theirs, "token").where(most > wanted * (size + F.col("other_size") - most))
    other = tokens.select("token", F.col("size").alias("other_size"), F.col("place").alias("other_place"), F.col("set_id").alias("other_id"))
    asked = tokens.join(meet, ["token", "size", "place"])
    return asked.join(other, ["token", "other_size", "other_place"]).where(F.col("set_id") < F.col("other_id")).select("set_id", "other_id").distinct()


def co_occurrence(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct event sets whose Jaccard similarity exceeds ``threshold``, exactly.

    members(entity, event).  Entities with equal sets collapse to one row (``n`` entities), and pairs come from
    ``set_candidates``.  A set shared by several entities is listed against itself with similarity 1.
    """
    sets = event_sets(members).groupBy("set_id").agg(F.first("events").alias("events"), F.count(F.lit(1)).alias("n")) \
        .withColumn("size", F.size("events"))
    pairs = set_candidates(sets, threshold)
    right = sets.select(F.col("set_id").alias("other_id"), F.col("events").alias("other_events"), F.col("n").alias("other_n"))
    shared = F.size(F.array_intersect("events", "other_events"))
    scored = (pairs.join(sets, "set_id").join(right, "other_id")
              .withColumn("jaccard", shared / (F.size("events") + F.size("other_events") - shared))
              .where(F.col("jaccard") > threshold).select("set_id", "other_id", "n", "other_n", "jaccard"))
    copies = sets.where("n > 1").select("set_id", F.col("set_id").alias("other_id"), "n", F.col("n").alias("other_n"),
                                        F.lit(1.0).alias("jaccard"))
    return scored.unionByName(copies)


def compare_sources(local: DataFrame, other: DataFrame, keys: Sequence[str], digits: int = 3) -> DataFrame:
    """Two aggregates of the same facts side by side with local - other differences."""
    right = other.select(*keys, F.col("maps").alias("other_maps"), F.col("ratio").alias("other_ratio"))
    return (local.select(*keys, "maps", "ratio").join(right, list(keys), "full")
            .withColumn("status", F.when(F.col("maps").isNull(), "other_only").when(F.col("other_maps").isNull(), "local_only")
                        .otherwise("overlap"))
            .withColumn("maps_delta", F.col("maps") - F.col("other_maps"))
            .withColumn("ratio_delta", F.round(F.col("ratio") - F.col("other_ratio"), digits)))


def match_summary(compared: DataFrame, in_scope: str) -> DataFrame:
    """Counts of overlaps, one-sided rows, in-scope rows and overlaps where the other side has more maps."""
    more = (F.col("status") == "overlap") & (F.col("maps_delta") < 0)
    scope = F.expr(in_scope)
    return compared.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("other_maps").isNotNull()).alias("usable"),
        F.count_if(F.col("status") == "overlap").alias("overlaps"),
        F.count_if(F.col("status") == "other_only").alias("other_only"),
        F.count_if((F.col("status") == "other_only") & scope).alias("scope_other_only"),
        F.count_if(more).alias("more_maps"), F.count_if(more & scope).alias("scope_more_maps"))
