"""Boards, top-k lists, comparison tables and run detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ordered import Order, sort_columns


def top_k(df: DataFrame, groups: Sequence[str], order: Order, k: int, name: str = "position") -> DataFrame:
    """First k rows per group; Spark keeps at most k rows per group and task before the shuffle."""
    w = W.partitionBy(*groups).orderBy(*sort_columns(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_k_with_ties(df: DataFrame, groups: Sequence[str], metric: str, k: int, digits: int) -> DataFrame:
    """First k rows plus every row whose value shown to ``digits`` equals the k-th shown value."""
    shown = df.where(F.col(metric).isNotNull()).withColumn("shown", F.round(metric, digits))
    cut = top_k(shown, groups, [(metric, False)], k).groupBy(*groups).agg(F.min("shown").alias("_cut"))
    joined = shown.join(cut, list(groups)) if groups else shown.crossJoin(F.broadcast(cut))  # one row
    return joined.where(F.col("shown") >= F.col("_cut")).drop("_cut")


def filtered_boards(df: DataFrame, entity: str, boards: Sequence[tuple[str, str, str, bool]], k: int) -> DataFrame:
    """boards(name, metric expression, filter, ascending) -> top k of each board in one pass.

    Each row is exploded once into the boards it qualifies for; the per-board limit is applied
    before the shuffle.
    """
    entries = F.array(*[
        F.when(F.expr(keep), F.struct(F.lit(name).alias("board"), F.expr(metric).cast("double").alias("value"),
                                      (F.expr(metric).cast("double") * (1 if ascending else -1)).alias("_key")))
        for name, metric, keep, ascending in boards])
    long = df.select(entity, F.explode(F.array_compact(entries)).alias("b")).select(entity, "b.*") \
        .where("value IS NOT NULL").withColumn("_key", F.round("_key", 9))
    return top_k(long, ["board"], [("_key", True), (entity, True)], k).drop("_key")


def label_candidates(df: DataFrame, entity: str, picks: Sequence[tuple[str, int]]) -> DataFrame:
    """Distinct union of the top n by each metric."""
    entries = F.array(*[F.struct(F.lit(m).alias("board"), F.lit(n).alias("n"), F.round(F.col(m).cast("double"), 9).alias("value"))
                        for m, n in picks])
    long = df.select(entity, F.explode(entries).alias("b")).select(entity, "b.*")
    kept = top_k(long, ["board"], [("value", False), (entity, True)], max(n for _, n in picks))
    return kept.where("position <= n").select(entity).distinct()


def season_cards(wins: DataFrame, seasons: DataFrame, context: DataFrame, k: int) -> DataFrame:
    """Per event: winner team, weight and the season's top k winners."""
    events = wins.groupBy("season", "event").agg(
        F.min("date").alias("date"),
        F.array_join(F.sort_array(F.collect_set(F.col("team").cast("string"))), ",").alias("winner"))
    best = top_k(seasons.select("season", "entity", "wins"), ["season"], [("wins", False), ("entity", True)], k)
    top = best.groupBy("season").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "entity", "wins"))),
        lambda s: F.concat_ws(":", s["entity"], s["wins"])), ",").alias("top_winners"))
    return (events.join(context.select("season", "denom", "held"), "season").join(top, "season")
            .withColumn("weight", 1 / F.col("denom")).drop("denom"))


def contiguous_runs(df: DataFrame, groups: Sequence[str], order: str, same: Sequence[str]) -> DataFrame:
    """Number the runs of neighbouring rows that agree on ``same``; groups are short sequences."""
    w = W.partitionBy(*groups).orderBy(order)
    first = F.row_number().over(w) == 1
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return (df.withColumn("_new", F.when(first | changed, 1).otherwise(0))
            .withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new"))


def metric_table(df: DataFrame, entity: str, metrics: Sequence[str]) -> DataFrame:
    """Long (entity, metric, value) table of the chosen metrics."""
    return df.select(entity, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        entity, list(metrics), "metric", "value").where("value IS NOT NULL")


def best_in_row(long: DataFrame, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Best value per metric, how many were compared and how many hold it."""
    key = F.when(F.col("metric").isin(list(lower_is_better)), -F.col("value")).otherwise(F.col("value"))
    counted = long.groupBy("metric", "value", key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("metric").agg(F.max_by("value", "_key").alias("best"), F.sum("_n").alias("compared"),
                                         F.max_by("_n", "_key").alias("holders"))


def leader_margin(df: DataFrame, metric: str, entity: str, margin: float) -> DataFrame:
    """The leader (smallest entity on a tie) and whether it leads the runner-up by ``margin``."""
    two = df.select(entity, metric).orderBy(F.desc(metric), entity).limit(2)
    return two.agg(F.max(metric).alias("leader_value"), F.max_by(entity, F.struct(metric, -F.col(entity))).alias("leader"),
                   F.coalesce((F.max(metric) - F.min(metric) >= margin) & (F.count(F.lit(1)) == 2), F.lit(False)).alias("decisive"))


def season_matrix(seasons: DataFrame, values: Sequence[int]) -> DataFrame:
    """Share and title flag of every entity in each listed season, one column each."""
    cells = seasons.groupBy("entity")
    shares = [F.max(F.when(F.col("season") == y, F.col("wins") / F.col("denom"))).alias(f"s{y}") for y in values]
    titles = [F.coalesce(F.bool_or(F.when(F.col("season") == y, F.col("titles") > 0)), F.lit(False)).alias(f"title{y}") for y in values]
    return cells.agg(*shares, *titles)


def comparison_matrix(summary: DataFrame) -> DataFrame:
    """Wins over events entered per entity and season, flagging the season's best share."""
    rows = summary.select("entity", "season", "wins", F.col("events").alias("entered"),
                          (F.col("wins") / F.col("events")).alias("share"))
    best = rows.groupBy("season").agg(F.max("share").alias("_best"))
    return rows.join(best, "season").withColumn(
        "is_best", (F.col("wins") > 0) & (F.col("share") == F.col("_best"))).drop("_best")
