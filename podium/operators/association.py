"""Association between performance and outcome: conditional rates, correlations, fixed effects, prior features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.stats import MIN_PAIRS, fisher_bound, pearson
from ..functions.values import ratio
from ..plans.ordered import join_null_safe, prefix_counts
from .boards import top_k

# Smallest group for a within-group effect and smallest team for a share.
MIN_EFFECT_ROWS = 4
MIN_TEAM_ROWS = 4
ALL_MODES = "all"


def conditional_rates(obs: DataFrame) -> DataFrame:
    """Win rates by the sign of good - bad per entity, over all modes and per mode, in one aggregation."""
    won, good, bad = F.col("won"), F.col("good"), F.col("bad")
    up, even, down = good > bad, good == bad, good < bad
    y, kd = won.cast("int"), ratio(good, bad)
    n = F.count(F.lit(1))
    grouped = obs.groupingSets([[F.col("entity")], [F.col("entity"), F.col("mode")]], "entity", "mode").agg(
        F.grouping_id().alias("_gid"), n.alias("maps"), F.count_if(won).alias("wins"),
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count_distinct("season").alias("seasons"),
        F.count_if(up).alias("up_maps"), F.count_if(up & won).alias("up_wins"),
        F.count_if(even).alias("even_maps"), F.count_if(even & won).alias("even_wins"),
        F.count_if(down).alias("down_maps"), F.count_if(down & won).alias("down_wins"),
        F.count(kd).alias("_known"), pearson(kd, y).alias("ratio_corr"), pearson(good, y).alias("good_corr"),
        pearson(bad, y).alias("bad_corr"), (F.coalesce((F.bool_or(won) != F.bool_and(won)).cast("int"), F.lit(0)) + 1).alias("_outcomes"),
        (F.coalesce((F.min(kd) < F.max(kd)).cast("int"), F.lit(0)) + 1).alias("_values"))
    out = grouped.withColumn("mode", F.when(F.col("_gid") == 1, ALL_MODES).otherwise(F.col("mode")))
    other_maps, other_wins = F.col("even_maps") + F.col("down_maps"), F.col("even_wins") + F.col("down_wins")
    losses = F.col("maps") - F.col("wins")
    up_losses = F.col("up_maps") - F.col("up_wins")
    given = {"win_rate": ratio(F.col("wins"), F.col("maps")), "win_given_up": ratio(F.col("up_wins"), F.col("up_maps")),
             "win_given_even": ratio(F.col("even_wins"), F.col("even_maps")), "win_given_down": ratio(F.col("down_wins"), F.col("down_maps")),
             "win_given_not_up": ratio(other_wins, other_maps), "up_given_win": ratio(F.col("up_wins"), F.col("wins")),
             "up_given_loss": ratio(up_losses, losses), "down_given_win": ratio(F.col("down_wins"), F.col("wins"))}
    for name, c in given.items():
        out = out.withColumn(name, c)
    return (out.withColumn("uplift", F.col("win_given_up") - F.col("win_given_not_up"))
            .withColumn("rate_gap", F.col("up_given_win") - F.col("up_given_loss"))
            .withColumn("corr_low", fisher_bound(F.col("ratio_corr"), F.col("_known"), -1))
            .withColumn("corr_high", fisher_bound(F.col("ratio_corr"), F.col("_known"), 1))
            .withColumn("status", bands.association_label(F.col("maps"), F.col("_outcomes"), F.col("_values")))
            .withColumn("stability", bands.sample_label(F.col("maps"))).drop("_gid", "_known", "_outcomes", "_values"))


def team_maps(obs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Team totals per map with the opponent's total, which is the map's total less the team's own."""
    team = obs.groupBy(*key, "team").agg(F.sum("good").alias("good"), F.bool_and("won").alias("won"),
                                         F.count(F.lit(1)).alias("rows"), F.min("team_vs").alias("opponent"))
    total = team.groupBy(*key).agg(F.sum("good").alias("_all"))
    return (join_null_safe(team, total, list(key)).withColumn("opponent_good", F.col("_all") - F.col("good"))
            .withColumn("difference", F.col("good") - F.col("opponent_good")).drop("_all"))


def team_rates(maps: DataFrame) -> DataFrame:
    """Outscore / tied / outscored win rates and differences per team, over all modes and per mode."""
    won, d = F.col("won"), F.col("difference")
    up, tied, down = d > 0, d == 0, d < 0
    half = F.lit(0.5)
    g = maps.groupingSets([[F.col("team")], [F.col("team"), F.col("mode")]], "team", "mode").agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("maps"), F.count_if(won).alias("wins"),
        F.count_if(up).alias("up_maps"), F.count_if(up & won).alias("up_wins"), F.count_if(tied).alias("tied_maps"),
        F.count_if(tied & won).alias("tied_wins"), F.count_if(down).alias("down_maps"), F.count_if(down & won).alias("down_wins"),
        F.avg(d).alias("mean_diff"), F.percentile(d, half).alias("median_diff"),
        F.avg(F.when(won, d)).alias("mean_win_diff"), F.percentile(F.when(won, d), half).alias("median_win_diff"),
        F.avg(F.when(~won, d)).alias("mean_loss_diff"), F.percentile(F.when(~won, d), half).alias("median_loss_diff"))
    out = g.withColumn("mode", F.when(F.col("_gid") == 1, ALL_MODES).otherwise(F.col("mode"))).drop("_gid")
    losses = F.col("maps") - F.col("wins")
    return (out.withColumn("win_rate", ratio(F.col("wins"), F.col("maps")))
            .withColumn("win_given_up", ratio(F.col("up_wins"), F.col("up_maps")))
            .withColumn("up_failure_rate", ratio(F.col("up_maps") - F.col("up_wins"), F.col("up_maps")))
            .withColumn("win_given_tied", ratio(F.col("tied_wins"), F.col("tied_maps")))
            .withColumn("win_given_down", ratio(F.col("down_wins"), F.col("down_maps")))
            .withColumn("win_given_not_up", ratio(F.col("tied_wins") + F.col("down_wins"), F.col("tied_maps") + F.col("down_maps")))
            .withColumn("up_given_win", ratio(F.col("up_wins"), F.col("wins")))
            .withColumn("up_given_loss", ratio(F.col("up_maps") - F.col("up_wins"), losses))
            .withColumn("uplift", F.col("win_given_up") - F.col("win_given_not_up"))
            .withColumn("stability", bands.sample_label(F.col("maps"))))


def band_rates(rows: DataFrame, subject: str, band: Column, index: Column) -> DataFrame:
    """Maps, wins and win rate per (subject, band)."""
    return (rows.withColumn("band", band).withColumn("band_order", index).groupBy(subject, "band", "band_order")
            .agg(F.count(F.lit(1)).alias("maps"), F.count_if("won").alias("wins"))
            .withColumn("losses", F.col("maps") - F.col("wins")).withColumn("win_rate", ratio(F.col("wins"), F.col("maps"))))


def team_shares(obs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each row's share of its team's total on the map; null unless the team is complete and positive.

    Totals are combined map-side and joined back, so one very large team-map never sits in one task.
    """
    group = [*key, "team"]
    totals = obs.groupBy(*group).agg(F.count(F.lit(1)).alias("team_rows"), F.sum("good").alias("_g"), F.sum("bad").alias("_b"))
    rows = join_null_safe(obs, totals, group)
    whole = (F.col("team_rows") >= MIN_TEAM_ROWS) & (F.col("_g") > 0) & (F.col("_b") > 0)
    return (rows.withColumn("good_share", F.when(whole, ratio(F.col("good"), F.col("_g"))))
            .withColumn("bad_share", F.when(whole, ratio(F.col("bad"), F.col("_b"))))
            .withColumn("total_share", F.when(whole, ratio(F.col("good") + F.col("bad"), F.col("_g") + F.col("_b")))).drop("_g", "_b"))


METRICS = ["good_rate", "bad_rate", "total_rate", "ratio", "good_share", "bad_share", "total_share"]


def entity_metrics(rows: DataFrame, min_maps: dict[str, int]) -> DataFrame:
    """Entity aggregates per season and split (plus overall) with enough maps; needs ``team_shares`` columns."""
    both = rows.withColumn("split", F.explode(F.array(F.col("split"), F.lit("overall"))))
    minimum = F.create_map(*[F.lit(x) for item in min_maps.items() for x in item])
    n = F.count(F.lit(1))
    g, b = F.sum("good"), F.sum("bad")
    return both.groupBy("season", "split", "entity").agg(
        n.alias("maps"), F.count_if("won").alias("wins"), ratio(F.count_if("won"), n).alias("win_rate"), ratio(g, n).alias("good_rate"),
        ratio(b, n).alias("bad_rate"), ratio(g + b, n).alias("total_rate"), ratio(g, b).alias("ratio"),
        F.avg("good_share").alias("good_share"), F.avg("bad_share").alias("bad_share"), F.avg("total_share").alias("total_share")) \
        .where(F.col("maps") >= F.try_element_at(minimum, F.col("split")))


def metric_vs_outcome(metrics: DataFrame, names: Sequence[str] = METRICS, outcome: str = "win_rate") -> DataFrame:
    """Correlation of every metric with the outcome per season and split."""
    long = metrics.unpivot(["season", "split", "entity", outcome], list(names), "metric", "value")
    return long.groupBy("season", "split", "metric").agg(
        pearson(F.col("value"), F.col(outcome)).alias("r"), F.count("value").alias("n"))


def fixed_effect_corr(rows: DataFrame, by: Sequence[str], group: Sequence[str], metric: str, outcome: Column,
                      min_rows: int = MIN_EFFECT_ROWS) -> DataFrame:
    """Correlation within groups: group means are removed from both sides of groups with enough rows.

    Centred sums come from per-group moments, so rows are aggregated once and never joined back.
    """
    y = F.when(F.col(metric).isNotNull(), outcome.cast("double"))
    x = F.when(F.col(metric).isNotNull(), F.col(metric).cast("double"))
    keys = list(dict.fromkeys([*by, *group]))
    per = rows.groupBy(*keys).agg(
        F.count(x).alias("_n"), (F.covar_pop(x, y) * F.count(x)).alias("_xy"), (F.var_pop(x) * F.count(x)).alias("_xx"),
        (F.var_pop(y) * F.count(y)).alias("_yy"), (F.min(x) < F.max(x)).alias("_vx"), (F.min(y) < F.max(y)).alias("_vy")) \
        .where(F.col("_n") >= min_rows)
    total = per.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_xy").alias("_xy"), F.sum("_xx").alias("_xx"), F.sum("_yy").alias("_yy"),
                                 F.bool_or("_vx").alias("_vx"), F.bool_or("_vy").alias("_vy"))
    usable = (F.col("n") >= MIN_PAIRS) & F.col("_vx") & F.col("_vy")
    return total.select(*by, F.when(usable, F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))).alias("r"), "n")


def prior_event_features(obs: DataFrame, min_maps: dict[str, int]) -> DataFrame:
    """Each observation with the entity's record from earlier event runs of the season only.

    Rows in (date, event, series) order form runs of one event, so an event that is interrupted by
    another has several runs.  Runs are numbered on the distinct (season, date, event) rows - a
    calendar-sized table, since rows of one date and event are adjacent whatever their series - and
    histories accumulate over per-run totals, not over observations.
    """
    days = obs.select("season", "date", "event").distinct()
    w = W.partitionBy("season").orderBy("date", "event")
    starts = days.withColumn("_new", F.coalesce((F.col("event") != F.lag("event").over(w)).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    rows = obs.join(runs, ["season", "date", "event"])
    both = rows.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("split"))))
    per = both.groupBy("season", "entity", "scope", "run").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("maps"))
    before = W.partitionBy("season", "entity", "scope").orderBy("run").rangeBetween(W.unboundedPreceding, -1)
    history = per.select("season", "entity", "scope", "run", *[F.sum(c).over(before).alias(f"p_{c}") for c in ("good", "bad", "maps")])
    minimum = F.create_map(*[F.lit(x) for item in min_maps.items() for x in item])
    known = history.where(F.col("p_maps") >= F.try_element_at(minimum, F.col("scope")))
    def features(scope: str) -> list[Column]:
        n = F.col("p_maps")
        return [ratio(F.col("p_good"), n).alias(f"{scope}_good_rate"), ratio(F.col("p_bad"), n).alias(f"{scope}_bad_rate"),
                ratio(F.col("p_good") + F.col("p_bad"), n).alias(f"{scope}_total_rate"),
                ratio(F.col("p_good"), F.col("p_bad")).alias(f"{scope}_ratio"), n.alias(f"{scope}_maps")]
    keys = ["season", "entity", "run"]
    overall = known.where("scope = 'overall'").select(*keys, *features("overall"))
    own = known.where("scope <> 'overall'").select(*keys, F.col("scope").alias("split"), *features("split"))
    joined = rows.join(overall, keys, "left").join(own, [*keys, "split"], "left")
    return joined.where("overall_maps IS NOT NULL OR split_maps IS NOT NULL")


def shared_percentile(long: DataFrame, groups: Sequence[str], value: str, name: str = "percentile") -> DataFrame:
    """0-100 percentile where ties share their average rank; a single value gets 100, nulls stay null."""
    known = long.where(F.col(value).isNotNull())
    counts = prefix_counts(known, groups, [(value, True)])
    sizes = counts.groupBy(*groups).agg(F.sum("n_same").alias("_n"))
    share = F.when(F.col("_n") == 1, F.lit(100.0)).otherwise(
        (F.col("n_before") + (F.col("n_same") - 1) / 2) / F.nullif(F.col("_n") - 1, F.lit(0).cast("long")) * 100)
    scored = join_null_safe(counts, sizes, list(groups)).select(*groups, value, share.alias(name))
    return join_null_safe(long, scored, [*groups, value], "left")


def top_overlap(scores: DataFrame, outcomes: DataFrame, awards: DataFrame, n: int = 10, min_events: int = 2) -> DataFrame:
    """Overlap of the top n by value with the top n by outcomes and with award holders, plus correlations.

    scores(season, entity, value), outcomes(season, entity, events, wins, finals, top4, average_place),
    awards(season, entity, awards).
    """
    able = outcomes.where(F.col("events") >= min_events)
    shown = scores.withColumn("_v", F.round("value", 9))
    best = top_k(shown, ["season"], [("_v", False), ("entity", True)], n, "_p").select("season", "entity")
    winners = top_k(able, ["season"], [("wins", False), ("finals", False), ("average_place", True), ("entity", True)], n, "_p")
    placed = top_k(able, ["season"], [("average_place", True), ("wins", False), ("entity", True)], n, "_p")
    def shared(other: DataFrame, name: str) -> DataFrame:
        return best.join(other.select("season", "entity"), ["season", "entity"], "left_semi").groupBy("season").agg(
            F.count(F.lit(1)).alias(name))
    rows = scores.join(outcomes, ["season", "entity"], "left").join(awards, ["season", "entity"], "left") \
                 .fillna(0, ["wins", "top4", "awards"])
    v = F.col("value")
    out = rows.groupBy("season").agg(
        pearson(v, -F.col("average_place")).alias("r_place"), pearson(v, F.col("wins")).alias("r_wins"),
        pearson(v, F.col("top4")).alias("r_top4"), pearson(v, F.col("awards")).alias("r_awards"), F.count(F.lit(1)).alias("n"))
    for other, name in ((winners, "wins_overlap"), (placed, "place_overlap"), (awards, "award_overlap")):
        out = out.join(shared(other, name), "season", "left")
    return out.fillna(0, ["wins_overlap", "place_overlap", "award_overlap"])


def overall_rates(obs: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row over all observations: coverage counts, bucket rates and correlations."""
    won, good, bad = F.col("won"), F.col("good"), F.col("bad")
    y, kd = won.cast("int"), ratio(good, bad)
    up, even, down = good > bad, good == bad, good < bad
    maps = obs.select(*key).distinct().agg(F.count(F.lit(1)).alias("maps"))
    return obs.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"), F.count_distinct("event").alias("events"),
        F.count_distinct("season").alias("seasons"), F.count_if(up).alias("up_maps"), F.count_if(even).alias("even_maps"),
        F.count_if(down).alias("down_maps"), ratio(F.count_if(up & won), F.count_if(up)).alias("win_given_up"),
        ratio(F.count_if(even & won), F.count_if(even)).alias("win_given_even"), ratio(F.count_if(down & won), F.count_if(down)).alias("win_given_down"),
        pearson(kd, y).alias("ratio_corr"), pearson(good, y).alias("good_corr"), pearson(bad, y).alias("bad_corr")).crossJoin(maps)


def extreme_examples(metrics: DataFrame, k: int = 8) -> DataFrame:
    """Highest totals with the lowest win rate, and highest good with the highest win rate, per season."""
    busy = top_k(metrics, ["season"], [("total_rate", False), ("win_rate", True), ("entity", True)], k)
    strong = top_k(metrics, ["season"], [("good_rate", False), ("win_rate", False), ("entity", True)], k)
    cols = ["season", "entity", "maps", "win_rate", "good_rate", "total_rate", "position"]
    return busy.select(F.lit("busy").alias("board"), *cols).unionByName(strong.select(F.lit("strong").alias("board"), *cols))
