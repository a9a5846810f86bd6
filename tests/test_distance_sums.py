"""Summed distances, medoids, silhouettes and stability against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.operators import clustering, distance_sums, similarity

SPACE = similarity.Space((similarity.Feature("a", 0.5), similarity.Feature("b", 0.3), similarity.Feature("c", 0.2)), cap=2.0, role_weight=0.2)
ROLES = ("Lead", "Second", "Flex")


def points(spark, n, seed, copies=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vec = [rng.choice([None, round(rng.gauss(0, 2), 3)]) if rng.random() < 0.4 else round(rng.gauss(2 * (i % 3), 1), 3) for _ in range(3)]
        roles = {t: rng.choice(ROLES) for t in range(2000, 2003) if rng.random() < 0.5} or None
        rows.append((i, vec, roles))
    rows += [(n, [None] * 3, None), (n + 1, [None] * 3, {2000: "Lead"}), (n + 2, [1.0, None, None], {2001: "Flex"}), (n + 3, [None, 1.0, None], {2001: "Flex"})]
    rows += [(n + 10 + i, rows[1][1], rows[1][2]) for i in range(copies)]
    return spark.createDataFrame(rows, "entity long, vec array<double>, roles map<int,string>").repartition(3), rows


def brute(a, b):
    if a[0] == b[0]:
        return 0.0
    both = [(f.weight, min(abs(x - y) / SPACE.cap, 1)) for f, x, y in zip(SPACE.features, a[1], b[1]) if x is not None and y is not None]
    if not both:
        return 1.0
    base = sum(w * d for w, d in both) / sum(w for w, _ in both)
    shared = set(a[2] or {}) & set(b[2] or {})
    if not shared:
        return base
    step = [0.0 if a[2][t] == b[2][t] else 0.5 if "Flex" in (a[2][t], b[2][t]) else 1.0 for t in shared]
    return 0.8 * base + 0.2 * sum(step) / len(step)


def labelled(spark, rows, counts):
    """Slots numbered through labellings of so many clusters; some rows are in the first labelling only, one in none."""
    firsts = np.concatenate([[0], np.cumsum(counts)])
    slots = {r[0]: [int(firsts[j] + r[0] % k) for j, k in enumerate(counts) if j == 0 or r[0] % 5] for r in rows[:-1]}
    return spark.createDataFrame(list(slots.items()), "entity long, slots array<int>"), slots


@pytest.mark.parametrize("own", [False, True])
def test_sums_are_those_of_all_pairs(spark, own):
    df, rows = points(spark, 60, 5, copies=30)
    slots, of = labelled(spark, rows, (3, 4))
    got = distance_sums.cluster_sums(distance_sums.coded(df, SPACE), slots, 7, own=2 if own else None).collect()
    by = {r[0]: r for r in rows}
    assert {r["entity"] for r in got} == set(of)
    for r in got:
        wanted = of[r["entity"]] if own else range(7)
        want = [sum(brute(by[r["entity"]], by[e]) for e, s in of.items() if slot in s) for slot in wanted]
        assert list(r["slots"]) == of[r["entity"]] and list(r["sums"]) == pytest.approx(want, abs=1e-9)


def test_distances_to_named_rows(spark):
    df, rows = points(spark, 25, 6)
    codes = distance_sums.coded(df, SPACE)
    ids = [0, 3, 25, 26, 27]
    got = {r["entity"]: r["d"] for r in distance_sums.to_rows(codes, codes.rows, ids).collect()}
    by = {r[0]: r for r in rows}
    for e, d in got.items():
        assert list(d) == pytest.approx([brute(by[e], by[i]) for i in ids], abs=1e-12)


def test_silhouette_of_given_labels(spark):
    df, rows = points(spark, 40, 7)
    codes = distance_sums.coded(df, SPACE)
    labels = codes.rows.select(F.explode(F.array(F.lit(1), F.lit(3), F.lit(4))).alias("grp"), "entity") \
        .withColumn("cluster", F.when(F.col("entity") == 5, 99).otherwise(F.col("entity") % F.col("grp")))
    got = {r["grp"]: r["silhouette"] for r in clustering.silhouette(codes, labels.where("grp > 1 OR entity <> 5")).collect()}
    for k in (1, 3, 4):
        label = {r[0]: 99 if r[0] == 5 else r[0] % k for r in rows if k > 1 or r[0] != 5}
        widths = []
        for a in rows:
            if a[0] not in label:
                continue
            per = {}
            for b in rows:
                if b[0] in label and a[0] != b[0]:
                    per.setdefault(label[b[0]], []).append(brute(a, b))
            own, other = per.pop(label[a[0]], None), [np.mean(v) for v in per.values()]
            widths.append(0.0 if not own or not other else (min(other) - np.mean(own)) / max(min(other), np.mean(own)))
        assert got[k] == pytest.approx(np.mean(widths), abs=1e-9)


def pam(rows, k):
    """The cost of greedy medoids after best swaps over all pairs."""
    d = np.array([[brute(a, b) for b in rows] for a in rows])
    med = []
    for _ in range(k):
        best = [(round(np.minimum(d[:, med].min(1) if med else np.inf, d[:, j]).sum(), 9), j) for j in range(len(rows)) if j not in med]
        med.append(min(best)[1])
    while True:
        cost = d[:, med].min(1).sum()
        trial = min((round(d[:, med[:i] + [j] + med[i + 1:]].min(1).sum(), 9), i, j) for i in range(k) for j in range(len(rows)) if j not in med)
        if trial[0] >= cost - 1e-9:
            return cost
        med[trial[1]] = trial[2]


@pytest.mark.parametrize("size, slack", [(500, 1e-9), (20, 0.15)])
def test_medoids_cost_no_more_than_swaps_over_all_pairs(spark, size, slack):
    df, rows = points(spark, 70, 8)
    got = clustering.cluster(df, SPACE, 3, size=size).collect()
    by = {r[0]: r for r in rows}
    medoids = sorted({r["medoid"] for r in got})
    for r in got:
        assert r["distance"] == pytest.approx(min(brute(by[r["entity"]], by[m]) for m in medoids), abs=1e-12)
        assert r["distance"] == pytest.approx(brute(by[r["entity"]], by[r["medoid"]]), abs=1e-12)
    assert len(got) == len(rows) and len(medoids) == 3
    assert sum(r["distance"] for r in got) <= pam(rows, 3) * (1 + slack) + 1e-9


def test_stability_counts_replicates(spark):
    df, rows = points(spark, 45, 9)
    got = clustering.cluster_stability(df, SPACE, 3, replicates=4).collect()
    codes = distance_sums.coded(df, SPACE)
    kept = F.array(*[F.pmod(F.xxhash64("entity", F.lit(i), F.lit(1)), F.lit(10_000)) < int((1 - np.exp(-1)) * 10_000) for i in range(4)])
    draws = {r["entity"]: [0] + [i + 1 for i, x in enumerate(r["kept"]) if x] for r in codes.rows.select("entity", kept.alias("kept")).collect()}
    table = spark.createDataFrame(list(draws.items()), "entity long, draws array<int>")
    by, label = {r[0]: r for r in rows}, {}
    for d, _, medoids, cost in clustering.k_medoids(codes, table, [3]):
        member = [e for e in by if d in draws[e]]
        label[d] = {e: int(np.argmin([brute(by[e], by[m]) for m in medoids])) for e in member}
        assert set(medoids) <= set(member) and cost == pytest.approx(sum(min(brute(by[e], by[m]) for m in medoids) for e in member))
    for r in got:
        ref = {e for e, c in label[0].items() if c == r["cluster"]}
        best = []
        for d in range(1, 5):
            mine = ref & set(label[d])
            sets = [{e for e, c in label[d].items() if c == j} for j in range(3)]
            best.append(max(len(mine & s) / len(mine | s) for s in sets) if mine else 0.0)
        assert r["members"] == len(ref) and r["stability"] == pytest.approx(np.mean(best))


def test_clustering_of_no_rows(spark):
    df, _ = points(spark, 3, 1)
    none = df.limit(0)
    assert clustering.cluster(none, SPACE, 2).count() == 0 and clustering.choose_k(none, SPACE).count() == 0
    assert clustering.cluster_stability(none, SPACE, 2).count() == 0


def test_projection_with_all_rows_is_classical_scaling(spark):
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.3), 3), round(rng.gauss(0, 0.1), 3), 0.0], None) for i in range(40)]
    df = spark.createDataFrame(rows, "entity long, vec array<double>, roles map<int,string>")
    orient = df.select("entity", F.get("vec", F.lit(0)).alias("x_up"), F.get("vec", F.lit(1)).alias("y_down"))
    got = {r["entity"]: (r["x"], r["y"], r["kept"]) for r in clustering.project_2d(df, SPACE, orient).collect()}
    d2 = np.array([[brute(a, b) ** 2 for b in rows] for a in rows])
    centre = np.eye(40) - 1 / 40
    values, vectors = np.linalg.eigh(-0.5 * centre @ d2 @ centre)
    for at, axis in ((0, -1), (1, -2)):
        want, have = vectors[:, axis], np.array([got[i][at] for i in range(40)])
        want = want / np.abs(want).max()
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-3
    assert got[0][2] == pytest.approx(values[-2:].sum() / values[values > 0].sum())
