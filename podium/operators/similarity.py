"""Mixed-feature similarity: feature tables, robust scaling, pair distances and what explains them.

A distance is the weighted mean of per-feature differences, each capped at 1, over the features
present on both sides, blended with the disagreement of roles in shared seasons.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio
from ..plans import exact_quantile

# Rows needed before a skill rate counts, and the co-win level that makes a team mate.
MIN_SKILL_MAPS = 25
TEAM_MATE = 0.15
FLEX = "Flex"


@dataclass(frozen=True)
class Feature:
    name: str
    weight: float
    log: bool = False


@dataclass(frozen=True)
class Space:
    """Features with weights summing to 1, the difference cap and the share of the role term."""

    features: tuple[Feature, ...]
    cap: float = 4.0
    role_weight: float = 0.07

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]


def space(groups: Sequence[tuple[float, Sequence[tuple[str, bool]]]], cap: float = 4.0, role_weight: float = 0.07) -> Space:
    """groups of (weight, [(feature, log)]): a group's weight is split evenly, the total scaled to 1."""
    total = sum(w for w, _ in groups)
    features = tuple(Feature(n, w / len(fs) / total, log) for w, fs in groups for n, log in fs)
    return Space(features, cap, role_weight)


def skill_features(stats: DataFrame) -> DataFrame:
    """stats(entity, split, good, bad, maps) for overall / respawn / snd -> masked rates per entity."""
    enough = F.col("maps") >= MIN_SKILL_MAPS
    def of(split: str, value: Column) -> Column:
        return F.max(F.when((F.col("split") == split) & enough, value))
    kd = ratio(F.col("good"), F.col("bad"))
    return stats.groupBy("entity").agg(
        of("overall", kd).alias("skill_ratio"), of("respawn", kd).alias("skill_respawn"), of("snd", kd).alias("skill_snd"),
        of("overall", ratio(F.col("good") + F.col("bad"), F.col("maps"))).alias("skill_total"))


def feature_table(entities: DataFrame, parts: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """One row per entity; a feature comes from the first part that has it and is null when absent."""
    out, have = entities.select("entity"), set()
    for part in parts:
        fresh = [c for c in part.columns if c in names and c not in have]
        if fresh:
            out = out.join(part.select("entity", *fresh), "entity", "left")
            have.update(fresh)
    return out.select("entity", *[F.col(n).cast("double").alias(n) for n in names])


def tenure(career_years: Column, teams: Column) -> Column:
    return F.when(teams > 0, F.round(career_years / teams, 2))


def robust_scale(table: DataFrame, sp: Space) -> DataFrame:
    """(x - median) / IQR per feature after an optional log1p; a zero IQR counts as 1, nulls stay null.

    All quantiles come from one pass over the long form; one row per feature returns to the plan.
    """
    moved = table.select("entity", *[(F.log1p(F.col(f.name)) if f.log else F.col(f.name)).alias(f.name) for f in sp.features])
    long = moved.unpivot("entity", sp.names, "feature", "value")
    stats = {r["feature"]: r for r in exact_quantile(long, ["feature"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    def scaled(f: Feature) -> Column:
        s = stats.get(f.name)
        if s is None:
            return F.lit(None).cast("double").alias(f.name)
        return ((F.col(f.name) - F.lit(s["q2"])) / F.lit((s["q3"] - s["q1"]) or 1.0)).alias(f.name)
    return moved.select("entity", *[scaled(f) for f in sp.features])


def vectors(scaled: DataFrame, roles: DataFrame, sp: Space, unknown: str = "Unknown") -> DataFrame:
    """(entity, vec, roles): the scaled features as one array in the space's order, missing ones null,
    and the season -> role map of known roles (one entry per season at most)."""
    known = roles.where(F.col("role") != unknown).groupBy("entity").agg(
        F.map_from_entries(F.sort_array(F.collect_set(F.struct("season", "role")))).alias("roles"))
    packed = scaled.select("entity", F.array(*sp.names).alias("vec"))
    return packed.join(known, "entity", "left")


def role_distance(a: Column, b: Column) -> Column:
    """Mean disagreement over shared seasons: 0 equal, 0.5 with Flex, 1 otherwise; null without overlap."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    def step(s):
        x, y = F.try_element_at(a, s), F.try_element_at(b, s)
        return F.when(x == y, 0.0).when((x == FLEX) | (y == FLEX), 0.5).otherwise(1.0)
    total = F.aggregate(shared, F.lit(0.0), lambda acc, s: acc + step(s))
    return F.try_divide(total, F.nullif(F.size(shared), F.lit(0)).cast("double"))


def feature_terms(sp: Space, left: str, right: str) -> list[tuple[Feature, Column, Column]]:
    """(feature, both present, capped difference) for the vectors with the two prefixes."""
    out = []
    for i, f in enumerate(sp.features):
        x, y = F.get(f"{left}vec", F.lit(i)), F.get(f"{right}vec", F.lit(i))
        both = x.isNotNull() & y.isNotNull()
        out.append((f, both, F.least(F.abs(x - y) / F.lit(sp.cap), F.lit(1.0))))
    return out


def distance(sp: Space, left: str = "a_", right: str = "b_") -> Column:
    """Generated arithmetic over both sides' vectors (no Python, no lambdas); 1 when no feature is shared."""
    terms = feature_terms(sp, left, right)
    weight, total = F.lit(0.0), F.lit(0.0)
    for f, both, diff in terms:
        weight = weight + F.when(both, F.lit(f.weight)).otherwise(F.lit(0.0))
        total = total + F.when(both, F.lit(f.weight) * diff).otherwise(F.lit(0.0))
    base = F.try_divide(total, F.nullif(weight, F.lit(0.0)))
    if sp.role_weight <= 0:
        return F.coalesce(base, F.lit(1.0))
    rd = role_distance(F.col(f"{left}roles"), F.col(f"{right}roles"))
    blended = F.coalesce((1 - sp.role_weight) * base + sp.role_weight * rd, base)
    return F.coalesce(blended, F.lit(1.0))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def pair_rows(pairs: DataFrame, scaled: DataFrame) -> DataFrame:
    """pairs(a, b) with both sides' vectors and roles under a_ and b_."""
    return pairs.join(prefixed(scaled, "a_"), F.col("a") == F.col("a_entity")).join(
        prefixed(scaled, "b_"), F.col("b") == F.col("b_entity"))


def pair_distance(pairs: DataFrame, scaled: DataFrame, sp: Space) -> DataFrame:
    rows = pair_rows(pairs, scaled)
    return rows.select("a", "b", role_distance(F.col("a_roles"), F.col("b_roles")).alias("role_distance"),
                       distance(sp).alias("distance"))


def explain(pairs: DataFrame, scaled: DataFrame, sp: Space, k: int = 3) -> DataFrame:
    """The k features that contribute most to each pair's distance, with their share."""
    rows = pair_rows(pairs, scaled)
    parts = [F.when(both, F.struct((F.lit(f.weight * (1 - sp.role_weight)) * diff).alias("amount"), F.lit(f.name).alias("label")))
             for f, both, diff in feature_terms(sp, "a_", "b_")]
    rd = role_distance(F.col("a_roles"), F.col("b_roles"))
    parts.append(F.when(rd > 0, F.struct((F.lit(sp.role_weight) * rd).alias("amount"), F.lit("role").alias("label"))))
    listed = rows.select("a", "b", F.array_compact(F.array(*parts)).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["amount"])
    order = F.transform(F.col("parts"), lambda p: F.struct((-F.round(p["amount"], 9)).alias("key"), p["label"].alias("label"), p["amount"].alias("amount")))
    best = listed.select("a", "b", total.alias("_total"), F.posexplode(F.slice(F.sort_array(order), 1, k)).alias("position", "p"))
    share = F.coalesce(F.try_divide(F.col("p.amount"), F.nullif(F.col("_total"), F.lit(0.0))), F.lit(0.0))
    return best.select("a", "b", (F.col("position") + 1).alias("position"), F.col("p.label").alias("label"), share.alias("share"))
