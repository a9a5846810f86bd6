"""Order statistics over groups of any size.

A plain ranking window sorts each group inside a single task.  That is fine while
the input is provably small; beyond that ``prefix_counts`` computes the same numbers
with range partitions: ties are collapsed first, each range chunk is ordered on its
own, and chunk offsets (one row per chunk and group) are added afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sizing import is_small, pin, small_limit

#: a group of at most ``podium.small.bytes`` over this many rows is ordered in one task
GROUP_SHARE = 256

Order = Sequence[tuple[str, bool]]  # (column, ascending)


def sort_columns(order: Order) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where null keys match each other; keys appear once, from the left."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def largest_group(df: DataFrame, groups: Sequence[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _before(weight: str, partition: Sequence[str], order: list[Column]) -> Column:
    frame = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(frame), F.lit(0)).cast("long")


def prefix_counts(df: DataFrame, groups: Sequence[str], order: Order, weight: str | None = None,
                  dense: bool = False) -> DataFrame:
    """Distinct order keys per group with ``n_same`` rows and ``n_before`` rows strictly ahead.

    ``dense`` counts distinct keys instead of rows.
    With ``weight`` both are sums of that column, so rows of weight 0 can ask where they would stand.
    """
    names = [c for c, _ in order]
    size = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")
    if dense:
        size = F.max(F.lit(1)).cast("long")
    keys = df.groupBy(*groups, *names).agg(size.alias("n_same"))
    if is_small(df):
        return keys.withColumn("n_before", _before("n_same", groups, sort_columns(order)))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = pin(keys.repartitionByRange(parts, *[F.col(g) for g in groups], *sort_columns(order))
                  .withColumn("_chunk", F.spark_partition_id()))
    inside = chunked.withColumn("_inside", _before("n_same", ["_chunk", *groups], sort_columns(order)))
    offsets = (chunked.groupBy("_chunk", *groups).agg(F.sum("n_same").alias("_rows"))
               .withColumn("_offset", _before("_rows", groups, [F.col("_chunk").asc()]))
               .drop("_rows"))
    return (join_null_safe(inside, offsets, ["_chunk", *groups])
            .withColumn("n_before", F.col("_inside") + F.col("_offset"))
            .drop("_chunk", "_inside", "_offset"))


def competition_rank(df: DataFrame, groups: Sequence[str], order: Order, name: str = "rank") -> DataFrame:
    """1 + number of rows strictly ahead; ties share the smallest rank."""
    ranked = F.rank().over(W.partitionBy(*groups).orderBy(*sort_columns(order))).cast("long")
    if is_small(df):
        return df.withColumn(name, ranked)
    df = pin(df)  # what is ranked may be far smaller than what it derives from, and its groups small
    if is_small(df) or largest_group(df, groups) <= small_limit(df.sparkSession) // GROUP_SHARE:
        return df.withColumn(name, ranked)
    counts = prefix_counts(df, groups, order).select(
        *groups, *[c for c, _ in order], (F.col("n_before") + 1).alias(name))
    return join_null_safe(df, counts, [*groups, *[c for c, _ in order]])


def competition_ranks(df: DataFrame, groups: Sequence[str], boards: dict[str, Order]) -> DataFrame:
    """``competition_rank`` for several orders of one table at once.

    Beyond small input the table is read once: its rows are numbered and written, and all boards are one long table in which a row
    of a board has that board's keys only, so a single range partitioning and prefix count ranks them all.
    """
    if is_small(df):
        for name, order in boards.items():
            df = df.withColumn(name, F.rank().over(W.partitionBy(*groups).orderBy(*sort_columns(order))).cast("long"))
        return df
    rows = pin(df.withColumn("_row", F.monotonically_increasing_id()))
    slots = {(b, c): f"_key{i}" for i, (b, c) in enumerate((b, c) for b, order in boards.items() for c, _ in order)}

    def keys(board: str) -> Column:
        own = [(F.col(c) if b == board else F.lit(None)).cast(rows.schema[c].dataType).alias(k) for (b, c), k in slots.items()]
        return F.struct(F.lit(board).alias("_board"), *own)

    long = pin(rows.select("_row", *groups, F.explode(F.array(*[keys(b) for b in boards])).alias("_k")).select("_row", *groups, "_k.*"))
    order = [(slots[b, c], asc) for b, wanted in boards.items() for c, asc in wanted]
    counts = prefix_counts(long, [*groups, "_board"], order).select(*groups, "_board", *slots.values(), (F.col("n_before") + 1).alias("_rank"))
    ranked = join_null_safe(long, counts, [*groups, "_board", *slots.values()])
    wide = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_board") == b, F.col("_rank"))).alias(b) for b in boards])
    return rows.join(wide, "_row").drop("_row")


def row_rank(df: DataFrame, groups: Sequence[str], order: Order, name: str = "rank") -> DataFrame:
    """Row number under a total order (the order keys must identify a row within its group)."""
    return competition_rank(df, groups, order, name)


def exact_quantile(df: DataFrame, groups: Sequence[str], value: str,
                   probabilities: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per entry of ``probabilities``."""
    present = df.where(F.col(value).isNotNull())
    if is_small(df):
        return present.groupBy(*groups).agg(
            *[F.percentile(value, F.lit(p)).alias(n) for n, p in probabilities.items()])

    counts = prefix_counts(present, groups, [(value, True)])
    sizes = counts.groupBy(*groups).agg(F.sum("n_same").alias("_n"))
    located = join_null_safe(counts, sizes, groups) if groups else counts.crossJoin(sizes)
    picks = []
    for name, p in probabilities.items():
        for side, rounding in (("lo", F.floor), ("hi", F.ceil)):
            at = rounding((F.col("_n") - 1) * F.lit(p))
            hit = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n_same"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
    wide = located.groupBy(*groups).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, p in probabilities.items():
        position = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return wide.select(*groups, *out)
