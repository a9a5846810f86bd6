"""Medoid clustering, silhouettes, stability, profiles and a projection.

Every row counts in every cost and may become a medoid, and no pairs of rows are made: clusters start from greedy choices
and swaps among a bounded set of candidate rows, whose distances to all rows are one table of fixed width; then medoids move to the row of least
summed distance in their cluster, from ``distance_sums``, as long as that lowers the cost.  All cluster counts and all
bootstrap replicates advance together, one job per step; what returns to the driver is bounded by runs, clusters
and candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import pearson
from ..functions.values import ratio
from ..plans import pin, row_rank
from .boards import top_k
from .distance_sums import Codes, cluster_sums, coded, lists, to_rows
from .similarity import Space

#: columns of the projected matrix; its rows are all rows
LANDMARKS = 256
#: rows that the greedy start and the swaps choose from; the update of medoids looks at all rows
CANDIDATES = 256
STABLE, WEAK = 0.75, 0.5
GAIN = 1e-9


def literal_rows(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A handful of driver-side values as a table."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _summed(table: DataFrame, per_batch, runs: int, wide: int) -> np.ndarray:
    """(runs, wide): the sum over all rows of what ``per_batch`` makes of (distances, member mask per run)."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((runs, wide))
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                d, draws = batch.column("d"), batch.column("draws")
                lengths = draws.value_lengths().to_numpy(zero_copy_only=False)
                member = np.zeros((batch.num_rows, int(draws.flatten().to_numpy(zero_copy_only=False).max(initial=0)) + 1), bool)
                member[np.repeat(np.arange(batch.num_rows), lengths), draws.flatten().to_numpy(zero_copy_only=False)] = True
                per_batch(sums, lists(d, len(d.flatten()) // max(len(d), 1)), member)
        yield pa.RecordBatch.from_arrays([pa.array(range(runs), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["run", "sums"])

    long = table.select("draws", "d").mapInArrow(part, "run int, sums array<double>").select("run", F.posexplode("sums").alias("at", "v"))
    out = np.zeros((runs, wide))
    got = long.groupBy("run", "at").agg(F.sum("v").alias("v")).toArrow()
    out[got.column("run").to_numpy(), got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def _build(table: DataFrame, allowed: np.ndarray, k: int) -> list[list[int]]:
    """Greedy start per draw: the most central candidate, then whatever lowers the total cost most."""
    draws, m = allowed.shape
    chosen: list[list[int]] = [[] for _ in range(draws)]
    for _ in range(k):
        now = [list(c) for c in chosen]

        def gains(sums: np.ndarray, d: np.ndarray, member: np.ndarray) -> None:
            for r in range(min(draws, member.shape[1])):
                mine = d[member[:, r]]
                sums[r] += np.maximum(mine[:, now[r]].min(1)[:, None] - mine, 0.0).sum(0) if now[r] else -mine.sum(0)

        gain = np.round(_summed(table, gains, draws, m), 9)
        gain[~allowed] = -np.inf
        for r in range(draws):
            gain[r, chosen[r]] = -np.inf
            if np.isfinite(gain[r]).any():
                chosen[r].append(int(np.argmax(gain[r])))
    return chosen


def _swaps(table: DataFrame, allowed: np.ndarray, medoids: list[list[int]], draw_of: Sequence[int], max_iter: int) -> list[list[int]]:
    """Best-improvement swaps among the candidates, for every run at once; costs are over all rows."""
    m, medoids, active = allowed.shape[1], [list(x) for x in medoids], set(range(len(medoids)))
    most = max(len(x) for x in medoids)
    for _ in range(max_iter):
        live, now = sorted(active), [list(x) for x in medoids]

        def trials(sums: np.ndarray, d: np.ndarray, member: np.ndarray) -> None:
            for i, r in enumerate(live):
                if draw_of[r] >= member.shape[1]:
                    continue
                mine = d[member[:, draw_of[r]]]
                here = mine[:, now[r]]
                order = np.argsort(here, 1, kind="stable")
                first = np.take_along_axis(here, order[:, :1], 1)[:, 0]
                second = np.take_along_axis(here, order[:, 1:2], 1)[:, 0] if here.shape[1] > 1 else np.full(len(here), np.inf)
                sums[i, -1] += first.sum()
                for slot in range(here.shape[1]):
                    left = np.where(order[:, 0] == slot, second, first)
                    sums[i, slot * m:(slot + 1) * m] += np.minimum(mine, left[:, None]).sum(0)

        cost = _summed(table, trials, len(live), most * m + 1)
        active = set()
        for i, r in enumerate(live):
            trial = np.round(cost[i, :len(medoids[r]) * m], 9).reshape(-1, m)
            trial[:, ~allowed[draw_of[r]]] = np.inf
            trial[:, medoids[r]] = np.inf
            at = int(np.argmin(trial))
            if trial.flat[at] < cost[i, -1] - GAIN:
                medoids[r][at // m] = at % m
                active.add(r)
        if not active:
            break
    return medoids


def assigned(codes: Codes, draws: DataFrame, medoids: Sequence[Sequence], draw_of: Sequence[int]) -> DataFrame:
    """(entity, slots, near, next): per run that a row is in, its cluster (numbered through the runs) and its distances
    to the nearest and second-nearest medoid (null with one medoid)."""
    ids = sorted({e for run in medoids for e in run})
    places = [[ids.index(e) for e in run] for run in medoids]
    firsts = np.concatenate([[0], np.cumsum([len(run) for run in medoids])]).astype(int)
    measured = to_rows(codes, codes.rows.join(draws, "entity"), ids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = lists(batch.column("d"), len(ids)) if batch.num_rows else np.zeros((0, len(ids)))
            slots, near, after = ([[] for _ in range(batch.num_rows)] for _ in range(3))
            within = [set(x) for x in batch.column("draws").to_pylist()]
            for r, place in enumerate(places):
                here = d[:, place]
                first = np.argmin(here, 1) if len(here) else []
                two = np.sort(here, 1)
                for i in range(batch.num_rows):
                    if draw_of[r] in within[i]:
                        slots[i].append(int(firsts[r] + first[i]))
                        near[i].append(float(two[i, 0]))
                        after[i].append(float(two[i, 1]) if len(place) > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column("entity"), pa.array(slots, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.float64())),
                                              pa.array(after, pa.list_(pa.float64()))], names=["entity", "slots", "near", "next"])

    entity = codes.rows.schema["entity"].dataType.simpleString()
    return measured.select("entity", "draws", "d").mapInArrow(label, f"entity {entity}, slots array<int>, near array<double>, next array<double>")


def k_medoids(codes: Codes, draws: DataFrame, ks: Sequence[int], size: int = CANDIDATES, seed: int = 0, max_iter: int = 50) -> list[tuple]:
    """[(draw, k, medoids, cost)] for every draw and cluster count; draws(entity, draws: array<int>) says which rows a draw has."""
    ids = [r["entity"] for r in codes.rows.select("entity").orderBy(F.xxhash64("entity", F.lit(seed)), "entity").limit(size).collect()]
    ids.sort()
    table = pin(to_rows(codes, codes.rows.join(draws, "entity"), ids).select("entity", "draws", "d"))
    n_draws = (table.agg(F.max(F.array_max("draws"))).first()[0] or 0) + 1
    allowed = np.zeros((n_draws, len(ids)), bool)
    for r in table.where(F.col("entity").isin(ids)).select("entity", "draws").collect():
        allowed[r["draws"], ids.index(r["entity"])] = True
    if not len(ids):
        return []
    start = _build(table, allowed, max(ks))
    runs = [(d, k) for d in range(n_draws) for k in ks if len(start[d]) >= k]
    if not runs:
        return []
    draw_of = [d for d, _ in runs]
    picked = _swaps(table, allowed, [start[d][:k] for d, k in runs], draw_of, max_iter)
    medoids = [[ids[i] for i in run] for run in picked]
    n_slots = sum(k for _, k in runs)
    run_of = [r for r, (_, k) in enumerate(runs) for _ in range(k)]
    labels = pin(assigned(codes, draws, medoids, draw_of))
    cost = _costs(labels, run_of)
    for _ in range(max_iter):
        sums = cluster_sums(codes, labels.select("entity", "slots"), n_slots, own=len(runs))
        each = sums.select("entity", F.explode(F.arrays_zip("slots", "sums")).alias("p")).select(
            "entity", F.col("p.slots").alias("slot"), F.round("p.sums", 9).alias("sum"))
        best = {r["slot"]: r["entity"] for r in each.groupBy("slot").agg(F.min_by("entity", F.struct("sum", "entity")).alias("entity")).collect()}
        moved, slot = [], 0
        for run in medoids:
            moved.append([best.get(slot + i, e) for i, e in enumerate(run)])
            slot += len(run)
        if [sorted(m) for m in moved] == [sorted(m) for m in medoids]:
            break
        after = pin(assigned(codes, draws, moved, draw_of))
        lower = _costs(after, run_of)
        better = [lower[r] < cost[r] - GAIN for r in range(len(runs))]
        if not any(better):
            break
        medoids = [moved[r] if better[r] else medoids[r] for r in range(len(runs))]
        labels = after if all(better) else pin(assigned(codes, draws, medoids, draw_of))
        cost = [lower[r] if better[r] else cost[r] for r in range(len(runs))]
    return [(d, k, m, c) for (d, k), m, c in zip(runs, medoids, cost)]


def _costs(labels: DataFrame, run_of: Sequence[int]) -> list[float]:
    each = labels.select(F.explode(F.arrays_zip("slots", "near")).alias("p"))
    cost = [0.0] * (max(run_of) + 1)
    for r in each.groupBy(F.col("p.slots").alias("slot")).agg(F.sum("p.near").alias("c")).collect():
        cost[run_of[r["slot"]]] += r["c"]
    return cost


def everyone(codes: Codes) -> DataFrame:
    """All rows in one draw."""
    return codes.rows.select("entity", F.array(F.lit(0)).alias("draws"))


def cluster(points: DataFrame, sp: Space, k: int, size: int = CANDIDATES, seed: int = 0) -> DataFrame:
    """Every row with its cluster, medoid, distance and next_distance; no row, no cluster."""
    codes = coded(points, sp)
    found = k_medoids(codes, everyone(codes), [k], size, seed)
    if not found:
        entity = codes.rows.schema["entity"].dataType.simpleString()
        return points.sparkSession.createDataFrame([], f"entity {entity}, cluster int, medoid {entity}, distance double, next_distance double")
    medoids = found[0][2]
    labels = assigned(codes, everyone(codes), [medoids], [0])
    named = F.array(*[F.lit(m) for m in medoids])
    return labels.select("entity", F.get("slots", F.lit(0)).alias("cluster"), F.get(named, F.get("slots", F.lit(0))).alias("medoid"),
                         F.get("near", F.lit(0)).alias("distance"), F.get("next", F.lit(0)).alias("next_distance"))


def silhouette(codes: Codes, labels: DataFrame) -> DataFrame:
    """Mean silhouette per grp over all of its rows; labels(grp, entity, cluster).

    A member of a singleton cluster counts 0, as does a labelling with one cluster.
    """
    keys = labels.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("grp", "cluster").collect()
    if not keys:
        return labels.groupBy("grp").agg(F.lit(0.0).alias("silhouette"))
    spark = labels.sparkSession
    number = literal_rows(spark, [(r["grp"], r["cluster"], i, r["n"]) for i, r in enumerate(keys)], ["grp", "cluster", "slot", "n"])
    slots = labels.join(F.broadcast(number), ["grp", "cluster"]).groupBy("entity").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    sums = cluster_sums(codes, pin(slots), len(keys))
    group = [r["grp"] for r in keys]
    others = {i: [j for j in range(len(keys)) if group[j] == group[i] and j != i] for i in range(len(keys))}
    n = np.array([r["n"] for r in keys], float)

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = lists(batch.column("sums"), len(n))
            slot, width = [], []
            for i, mine in enumerate(batch.column("slots").to_pylist()):
                for own in mine:
                    value = 0.0
                    if n[own] > 1 and others[own]:
                        inner, outer = s[i, own] / (n[own] - 1), min(s[i, j] / n[j] for j in others[own])
                        top = max(inner, outer)
                        value = (outer - inner) / top if top > 0 else 0.0
                    slot.append(own)
                    width.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(width, pa.float64())], names=["slot", "width"])

    per = sums.mapInArrow(widths, "slot int, width double").join(F.broadcast(number), "slot")  # one row a cluster
    return per.groupBy("grp").agg(F.avg("width").alias("silhouette"))


def medoid_silhouette(labels: DataFrame) -> DataFrame:
    """Silhouette against medoids over all rows (Lenssen & Schubert 2022): mean of 1 - nearest / second nearest."""
    width = F.coalesce(1 - F.try_divide(F.col("distance"), F.nullif(F.col("next_distance"), F.lit(0.0))), F.lit(0.0))
    return labels.agg(F.avg(width).alias("silhouette"), F.count(F.lit(1)).alias("rows"))


def run_labels(labels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(run, entity, cluster) of ``assigned`` rows, for runs of these cluster counts in order."""
    firsts = np.concatenate([[0], np.cumsum(ks)]).astype(int)
    run = F.array(*[F.lit(r) for r, k in enumerate(ks) for _ in range(k)])
    first = F.array(*[F.lit(int(firsts[r])) for r, k in enumerate(ks) for _ in range(k)])
    each = labels.select("entity", F.explode("slots").alias("slot"))
    return each.select(F.get(run, F.col("slot")).alias("run"), "entity", (F.col("slot") - F.get(first, F.col("slot"))).alias("cluster"))


def best_silhouette(scored: DataFrame) -> DataFrame:
    """(k, silhouette) with ``best``: the largest value, of equal ones the least k."""
    top = scored.agg(F.max_by("k", F.struct(F.round("silhouette", 9), -F.col("k"))).alias("_k"))
    return scored.crossJoin(F.broadcast(top)).withColumn("best", F.col("k") == F.col("_k")).drop("_k")  # one row


def choose_k(points: DataFrame, sp: Space, ks: Sequence[int] = range(2, 9), size: int = CANDIDATES, seed: int = 0) -> DataFrame:
    """(k, silhouette, best), every k in the same jobs."""
    codes = coded(points, sp)
    found = k_medoids(codes, everyone(codes), list(ks), size, seed)
    if not found:
        return points.sparkSession.createDataFrame([], "k int, silhouette double, best boolean")
    counts = [k for _, k, _, _ in found]
    labels = run_labels(assigned(codes, everyone(codes), [m for _, _, m, _ in found], [0] * len(found)), counts)
    named = labels.select(F.get(F.array(*[F.lit(k) for k in counts]), F.col("run")).alias("grp"), "entity", "cluster")
    return best_silhouette(silhouette(codes, pin(named)).withColumnRenamed("grp", "k"))


def cluster_stability(points: DataFrame, sp: Space, k: int, replicates: int = 20, size: int = CANDIDATES, seed: int = 0) -> DataFrame:
    """Mean best Jaccard of each reference cluster with the clusters of bootstrap replicates.

    A replicate keeps each row with probability 1 - 1/e, the share a resample with replacement leaves.  The reference and
    all replicates are draws of one search: one table of candidate distances, one job a step.
    """
    codes = coded(points, sp)
    threshold = int((1 - np.exp(-1)) * 10_000)
    number = F.sequence(F.lit(1), F.lit(replicates))
    kept = F.filter(number, lambda r: F.pmod(F.xxhash64("entity", r - 1, F.lit(seed + 1)), F.lit(10_000)) < threshold)
    draws = codes.rows.select("entity", F.concat(F.array(F.lit(0)), kept).alias("draws"))
    found = k_medoids(codes, draws, [k], size, seed)
    schema = "cluster int, members bigint, stability double, tag string"
    if not found:
        return points.sparkSession.createDataFrame([], schema)
    of = [d for d, _, _, _ in found]
    labels = pin(run_labels(assigned(codes, draws, [m for _, _, m, _ in found], of), [k] * len(found)))
    ref = labels.where("run = 0").select("entity", F.col("cluster").alias("ref"))
    lab = labels.where("run > 0").join(ref, "entity")
    inter = lab.groupBy("run", "ref", "cluster").agg(F.count(F.lit(1)).alias("n"))
    ref_n = lab.groupBy("run", "ref").agg(F.count(F.lit(1)).alias("rn"))
    new_n = lab.groupBy("run", "cluster").agg(F.count(F.lit(1)).alias("cn"))
    j = inter.join(ref_n, ["run", "ref"]).join(new_n, ["run", "cluster"]).withColumn("j", F.col("n") / (F.col("rn") + F.col("cn") - F.col("n")))
    best = j.groupBy("run", "ref").agg(F.max("j").alias("j")).groupBy("ref").agg((F.sum("j") / replicates).alias("stability"))
    sizes = ref.groupBy("ref").agg(F.count(F.lit(1)).alias("members"))
    tag = F.when(F.col("stability") >= STABLE, "STABLE").when(F.col("stability") >= WEAK, "weak").otherwise("UNSTABLE")
    return sizes.join(best, "ref", "left").fillna(0.0, ["stability"]).withColumn("tag", tag).withColumnRenamed("ref", "cluster")


def describe_clusters(scaled: DataFrame, labels: DataFrame, names: Sequence[str], k: int = 3) -> DataFrame:
    """The k features whose mean scaled value is furthest from the median, per cluster."""
    long = scaled.join(labels.select("entity", "cluster"), "entity").unpivot(["entity", "cluster"], list(names), "feature", "value")
    means = long.groupBy("cluster", "feature").agg(F.avg("value").alias("mean")).where("mean IS NOT NULL") \
        .withColumn("_size", F.round(F.abs("mean"), 8))
    return top_k(means, ["cluster"], [("_size", False), ("feature", True)], k).select(
        "cluster", "position", "feature", "mean", F.when(F.col("mean") > 0, "high").otherwise("low").alias("side"))


def cluster_cowin(labels: DataFrame, sets: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Mean pairwise co-win similarity inside each cluster, from set-level overlaps (threshold 0)."""
    counts = labels.join(sets.select("entity", "set_id"), "entity", "left").groupBy("cluster", "set_id").agg(F.count(F.lit(1)).alias("n"))
    size = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    a = counts.select("cluster", "set_id", F.col("n").alias("na"))
    b = counts.select("cluster", F.col("set_id").alias("other_id"), F.col("n").alias("nb"))
    met = overlaps.select("set_id", "other_id", "jaccard").join(a, "set_id").join(b, ["cluster", "other_id"])
    weight = F.when(F.col("set_id") == F.col("other_id"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    total = met.groupBy("cluster").agg(F.sum(F.col("jaccard") * weight).alias("_sum"))
    return size.join(total, "cluster", "left").select(
        "cluster", "members", F.coalesce(F.try_divide(F.col("_sum"), F.col("members") * (F.col("members") - 1) / 2), F.lit(0.0)).alias("mean_cowin"))


def order_clusters(labels: DataFrame, metric: DataFrame, column: str) -> DataFrame:
    """Clusters numbered by the mean of a metric (missing counts as zero)."""
    means = labels.join(metric.select("entity", column), "entity", "left").groupBy("cluster").agg(
        ratio(F.sum(F.coalesce(F.col(column), F.lit(0.0))), F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("members"))
    ranked = row_rank(means.withColumn("_m", F.round("mean", 9)), [], [("_m", True), ("cluster", True)], "position")
    return ranked.drop("_m")


def project_2d(points: DataFrame, sp: Space, orient: DataFrame, size: int = LANDMARKS, seed: int = 0, rank: int = 8, turns: int = 12) -> DataFrame:
    """Two coordinates per row by scaling of squared distances, in -1..1, with the share of positive eigenvalue mass they keep.

    The columns of the doubly centred matrix are those of ``size`` hashed rows (all, if fewer: then this is classical scaling); its
    rows are all rows, and all of them weigh in its means and its products.  A few random directions turn to the leading
    ones by subspace iteration, one job a turn, in which every row adds its share of B'(B v); only columns x rank numbers return.
    orient(entity, x_up, y_down) fixes the signs.
    """
    codes = coded(points, sp)
    ids = sorted(r["entity"] for r in codes.rows.select("entity").orderBy(F.xxhash64("entity", F.lit(seed)), "entity").limit(size).collect())
    entity = codes.rows.schema["entity"].dataType.simpleString()
    m = len(ids)
    if not m:
        return points.sparkSession.createDataFrame([], f"entity {entity}, x double, y double, kept double")
    measured = to_rows(codes, codes.rows.withColumn("draws", F.array(F.lit(0))), ids).select("entity", "draws", "d")
    table = pin(measured)

    def squares(sums: np.ndarray, d: np.ndarray, member: np.ndarray) -> None:
        sums[0, :m] += (d * d).sum(0)
        sums[0, m] += len(d)

    sums = _summed(table, squares, 1, m + 1)[0]
    mean = sums[:m] / sums[m]

    def centred(d: np.ndarray) -> np.ndarray:
        return -0.5 * (d * d - (d * d).mean(1, keepdims=True) - mean + mean.mean())

    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, min(rank, m))))[0]
    for _ in range(turns):
        def turned(sums: np.ndarray, d: np.ndarray, member: np.ndarray, v: np.ndarray = v) -> None:
            b = centred(d)
            sums += (b.T @ (b @ v)).T

        v = np.linalg.qr(_summed(table, turned, v.shape[1], m).T)[0]
    core = np.zeros((m, m))
    for r in table.where(F.col("entity").isin(ids)).select("entity", "d").toLocalIterator():
        core[ids.index(r["entity"])] = centred(np.array([r["d"]]))[0]
    values = np.linalg.eigvalsh((core + core.T) / 2)
    kept = float(np.sort(np.maximum(values, 0))[-2:].sum() / values[values > 0].sum()) if (values > 0).any() else 0.0
    axes = v[:, :2] if m > 1 else np.pad(v, ((0, 0), (0, 1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = centred(lists(batch.column("d"), m)) @ axes
            yield pa.RecordBatch.from_arrays([batch.column("entity"), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], names=["entity", "x", "y"])

    xy = pin(table.select("entity", "d").mapInArrow(place, f"entity {entity}, x double, y double"))
    signs = xy.join(orient, "entity", "left").agg(
        F.coalesce(pearson(F.col("x"), F.coalesce("x_up", F.lit(0.0))) < 0, F.lit(False)).alias("fx"),
        F.coalesce(pearson(F.col("y"), F.coalesce("y_down", F.lit(0.0))) > 0, F.lit(False)).alias("fy"),
        F.max(F.abs("x")).alias("mx"), F.max(F.abs("y")).alias("my"))
    def scaled(c: str, flip: str, limit: str):
        v = F.try_divide(F.col(c), F.nullif(F.col(limit), F.lit(0.0)))
        return F.when(F.col(flip), -v).otherwise(v).alias(c)
    return xy.crossJoin(F.broadcast(signs)).select("entity", scaled("x", "fx", "mx"), scaled("y", "fy", "my"), F.lit(kept).alias("kept"))  # one row
