"""Reading, filtering, slimming and merging source rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..functions.values import to_int

# Where a snapshot keeps its rows, and roles that count as having played.
WRAPPER_KEY, WRAPPER_ROW = "cargoquery", "title"
LIST_KEYS = ["sources", "ballots", "roles", "benchmarks"]
PLAYER_ROLE = "Substitute"


def read_rows(spark: SparkSession, path: str | list[str], schema: T.StructType, shape: str = "rows",
              multi_line: bool = True) -> DataFrame:
    """Flat rows from JSON snapshots with an explicit schema.

    ``shape``: ``rows`` for an array of row objects, ``wrapped`` for the query wrapper with one
    nested object per row, or the name of the list-valued key.
    """
    reader = spark.read.option("multiLine", multi_line)
    if shape == "rows":
        return reader.schema(schema).json(path)
    if shape == "wrapped":
        inner = T.StructType([T.StructField(WRAPPER_ROW, schema)])
        outer = T.StructType([T.StructField(WRAPPER_KEY, T.ArrayType(inner))])
        return reader.schema(outer).json(path).select(F.explode(WRAPPER_KEY).alias("r")).select(f"r.{WRAPPER_ROW}.*")
    if shape not in LIST_KEYS:
        raise ValueError(f"unknown snapshot shape {shape!r}")
    outer = T.StructType([T.StructField(shape, T.ArrayType(schema))])
    return reader.schema(outer).json(path).select(F.explode(shape).alias("r")).select("r.*")


def in_universe(season: Column, event: Column, date: Column, drop_seasons: Sequence = (), drop_events: Sequence = (),
                as_of: str | None = None) -> Column:
    """Row belongs to the counted universe; an undated row counts as already played."""
    keep = F.lit(True)
    if drop_seasons:
        keep = keep & (season.isNull() | ~season.isin(list(drop_seasons)))
    if drop_events:
        keep = keep & (event.isNull() | ~event.isin(list(drop_events)))
    if as_of is not None:
        keep = keep & (date.isNull() | (date <= F.lit(as_of).cast("date")))
    return keep


def filter_universe(df: DataFrame, drop_seasons: Sequence = (), drop_events: Sequence = (), as_of: str | None = None) -> DataFrame:
    return df.where(in_universe(F.col("season"), F.col("event"), F.col("date"), drop_seasons, drop_events, as_of))


def slim_observations(df: DataFrame, keep: Sequence[str], good: str = "good", bad: str = "bad") -> DataFrame:
    """Only the kept columns, blanks as null, rows whose good and bad values are both integers."""
    text = [blank_to_null(F.col(c).cast("string")).alias(c) for c in keep if c not in (good, bad)]
    return df.select(*text, to_int(F.col(good)).alias(good), to_int(F.col(bad)).alias(bad)) \
             .where(F.col(good).isNotNull() & F.col(bad).isNotNull())


def resolve_star(events: DataFrame, results: DataFrame, rosters: DataFrame, redirects: DataFrame, entities: DataFrame,
                 tiers: Sequence[str], first_only: bool = False) -> DataFrame:
    """Placements per entity: events - results - rosters - redirects - entities.

    events(event_id, event, season, date, tier), results(event_id, team_page, team, place),
    rosters(team_page, link, role), redirects(link, page), entities(page).  Starters (no role) and
    substitutes count.
    """
    placed = results.where("place = 1") if first_only else results
    played = rosters.where(F.col("role").isNull() | (F.col("role") == PLAYER_ROLE))
    return (events.where(F.col("tier").isin(list(tiers))).join(placed, "event_id").join(played, "team_page")
            .join(redirects, "link").join(entities, "page")
            .select(F.col("page").alias("entity"), "event_id", "event", "season", "date", "team", "place"))


def resolve_awards(awards: DataFrame, events: DataFrame, types: Sequence[str], exclude_like: str) -> DataFrame:
    """Awards of the listed types with their event, pages matching the pattern excluded."""
    kept = awards.where(F.col("type").isin(list(types)) & ~F.col("page").like(exclude_like))
    return kept.join(events, "page")


def distinct_events(df: DataFrame, drop_seasons: Sequence = (), drop_events: Sequence = (), as_of: str | None = None) -> DataFrame:
    """First event per (page, season) by date and name among the played, complete rows."""
    whole = filter_universe(df, drop_seasons, drop_events, as_of).where("event <> '' AND page <> '' AND season IS NOT NULL")
    return whole.groupBy("page", "season").agg(F.min(F.struct("date", "event")).alias("r")).select("page", "season", "r.date", "r.event")


def merge_new(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` plus the batch rows whose key is new; null and blank are the same.

    Of repeats inside the batch the row whose content comes first as JSON counts, so the choice does not depend on order.
    The key columns are hashed for the lookup but compared in full.
    """
    def key(df: DataFrame) -> list[Column]:
        return [F.coalesce(df[k].cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    row = F.struct(*[batch[c] for c in batch.columns])
    fresh = batch.select(row.alias("_row"), *key(batch)).groupBy(*names).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*", *names)
    seen = base.select(*key(base))
    return base.unionByName(fresh.join(seen, names, "left_anti").drop(*names))


def write_sharded(df: DataFrame, qualified: DataFrame, keys: Sequence[str], shard: str, path: str) -> None:
    """Rows of qualified keys, one directory per shard; adaptive execution splits large shards and joins small ones by size."""
    (df.join(qualified, list(keys), "left_semi").hint("rebalance", shard)
     .write.mode("overwrite").partitionBy(shard).parquet(path))
