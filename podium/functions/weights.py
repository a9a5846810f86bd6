"""Weights and points used when ballots, surveys and season ranks are combined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (lower bound, multiplier) for votes; multiplier per timing and per season coverage.
VOTE_STEPS = [(50, 1.30), (25, 1.20), (10, 1.10), (3, 1.05)]
TIMING = {"contemporaneous": 1.20, "near_contemporaneous": 1.15, "late_retrospective": 0.90}
SEASON_COVERAGE = {"end_of_title": 1.0, "late_season": 0.85, "mid_season": 0.60,
                   "early_season": 0.40, "partial_split_only": 0.30}
RANK_FLOOR = 31
RANK_SPAN = 30
POINT_EXPONENT = 2.5
RECEPTION_SWING = 0.25
SURVEY, CLUSTER, SINGLE = ("community_aggregate_survey", "community_thread_cluster", "single_community_ballot")


def vote_multiplier(votes: Column) -> Column:
    step = F.lit(1.0)
    for bound, value in reversed(VOTE_STEPS):
        step = F.when(votes >= bound, F.lit(value)).otherwise(step)
    return step


def _by_label(label: Column, table: dict[str, float]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(1.0))


def timing_multiplier(label: Column) -> Column:
    return _by_label(label, TIMING)


def season_coverage_multiplier(label: Column) -> Column:
    return _by_label(label, SEASON_COVERAGE)


def reception_raw(score: Column, max_positive: Column, max_negative: Column) -> Column:
    """1 +/- a quarter on a log scale relative to the extreme score of the same sign."""
    best = F.when(score > 0, max_positive).when(score < 0, max_negative)
    strength = F.try_divide(F.log1p(F.abs(score).cast("double")), F.log1p(best.cast("double")))
    moved = 1 + F.signum(score.cast("double")) * F.lit(RECEPTION_SWING) * strength
    return F.when(best > 0, F.least(F.greatest(moved, F.lit(1 - RECEPTION_SWING)),
                                    F.lit(1 + RECEPTION_SWING))).otherwise(F.lit(1.0))


def ballot_points(rank: Column, size: Column) -> Column:
    return F.try_divide((size + 1 - rank).cast("double"), size.cast("double"))


def season_points(rank: Column) -> Column:
    return F.pow(F.greatest(F.lit(0.0), (F.lit(RANK_FLOOR) - rank) / F.lit(float(RANK_SPAN))), F.lit(POINT_EXPONENT))


def source_base_weight(kind: Column, ballots: Column, votes: Column, sample: Column,
                       has_notes: Column, quality: Column) -> Column:
    """Weight of a source by kind; null for an unknown kind."""
    cluster = F.least(F.lit(1.5), F.sqrt(ballots.cast("double")) / 2) * vote_multiplier(votes)
    single = F.lit(0.5) * vote_multiplier(votes)
    sized = F.least(F.lit(3.0), F.greatest(F.lit(1.5), F.sqrt(sample.cast("double")) / 10))
    unsized = F.when(has_notes, F.lit(1.75)).otherwise(F.lit(1.5))
    survey = F.when(sample > 0, sized).otherwise(unsized) \
        * F.coalesce(F.nullif(quality.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.when(kind == CLUSTER, cluster).when(kind == SINGLE, single).when(kind == SURVEY, survey)
