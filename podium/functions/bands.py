"""Bands and labels for differences, ratios, sample sizes and associations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band labels in display order with their bounds, and the sample-size limits.
DIFFERENCE_BANDS = ["-20 or worse", "-19 to -10", "-9 to -1", "Tied (0)", "+1 to +9", "+10 to +19", "+20 or better"]
DIFFERENCE_STEP = (10, 20)
RATIO_BANDS = ["Below 0.80", "0.80–0.99", "Exactly 1.00", "1.01–1.19", "1.20+", "No deaths"]
RATIO_LIMITS = (0.8, 1.2)
SMALL_SAMPLES = (10, 25)


def _pick(index: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), index + 1)


def difference_band_index(diff: Column) -> Column:
    near, far = DIFFERENCE_STEP
    size = F.when(F.abs(diff) >= far, 3).when(F.abs(diff) >= near, 2).when(diff != 0, 1).otherwise(0)
    return (F.lit(3) + F.signum(diff.cast("double")).cast("int") * size).cast("int")


def difference_band(diff: Column) -> Column:
    return _pick(difference_band_index(diff), DIFFERENCE_BANDS)


def ratio_band_index(good: Column, bad: Column) -> Column:
    low, high = RATIO_LIMITS
    value = F.try_divide(good.cast("double"), bad.cast("double"))
    return (F.when(bad == 0, 5).when(good == bad, 2).when(value < low, 0).when(value < 1, 1)
            .when(value < high, 3).otherwise(4)).cast("int")


def ratio_band(good: Column, bad: Column) -> Column:
    return _pick(ratio_band_index(good, bad), RATIO_BANDS)


def sample_label(n: Column) -> Column:
    tiny, small = SMALL_SAMPLES
    return F.when(n < tiny, "very small sample").when(n < small, "small sample").otherwise("descriptive")


def association_label(n: Column, outcomes: Column, values: Column, value_name: str = "K/D") -> Column:
    """``outcomes`` and ``values`` are the numbers of distinct outcomes and distinct known values."""
    tiny, small = SMALL_SAMPLES
    return (F.when(outcomes < 2, "unavailable — no outcome variation")
            .when(values < 2, f"unavailable — no {value_name} variation")
            .when(n < tiny, "unstable — very small sample")
            .when(n < small, "unstable — small sample")
            .otherwise("descriptive — larger sample"))


def confidence(survey_count: Column, source_count: Column) -> Column:
    return (F.when((survey_count > 0) | (source_count >= 5), "high")
            .when(source_count >= 3, "medium").otherwise("low"))


def tier(rank: Column) -> Column:
    return (F.when(rank == 1, "top_1").when(rank <= 3, "top_3").when(rank <= 5, "top_5")
            .when(rank <= 10, "top_10").otherwise("ranked"))
