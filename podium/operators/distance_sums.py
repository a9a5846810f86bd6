"""Distances of every row to a bounded set of rows, and summed distances of every row to whole clusters, without pairs.

The distance of two rows is a weighted mean of capped differences over the features both have, blended with role
disagreement over shared seasons (``similarity.distance``).  Its weights depend only on which features and which
seasons the two rows have, so rows fall into few groups (null mask, season set), and a sum over a cluster splits:

* capped differences: a prefix count and a prefix sum of the cluster's sorted values per feature and group, read at x - cap, x
  and x + cap, give the exact sum of min(|x - y| / cap, 1);
* roles: counts per (cluster, group, season, role);
* pairs that share no feature count 1.

Values are range-partitioned by (feature, value); partitions carry their totals on to the next ones, so no feature is ever
sorted in one task and the work per row does not depend on the number of rows.  What reaches the driver is bounded by
groups, seasons, roles and clusters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import pin
from .similarity import FLEX, Space


@dataclass(frozen=True)
class Codes:
    """Points in numeric form: rows(entity, x, codes, g), and what the groups mean."""

    rows: DataFrame
    space: Space
    seasons: tuple
    roles: tuple
    groups: tuple  # (features present, seasons present) as bit masks

    @property
    def weights(self) -> np.ndarray:
        return np.array([f.weight for f in self.space.features])

    @property
    def step(self) -> np.ndarray:
        """Disagreement of two roles; the last row and column stand for no role."""
        flex = np.array([r == FLEX for r in self.roles], bool)
        out = np.where(flex[:, None] | flex[None, :], 0.5, 1.0)
        np.fill_diagonal(out, 0.0)
        return np.pad(out, (0, 1))


def coded(points: DataFrame, sp: Space) -> Codes:
    """points(entity, vec, roles) -> Codes; the rows are written once."""
    used = sp.role_weight > 0
    known = points.where("roles IS NOT NULL").select(F.explode("roles").alias("season", "role")).distinct().collect() if used else []
    seasons, roles = tuple(sorted({r["season"] for r in known})), tuple(sorted({r["role"] for r in known}))
    places = F.array(*[F.lit(r) for r in roles]) if roles else F.array().cast("array<string>")
    codes = F.array(*[F.coalesce(F.array_position(places, F.try_element_at("roles", F.lit(s))) - 1, F.lit(-1)).cast("int") for s in seasons]) \
        if seasons else F.array().cast("array<int>")
    rows = points.select("entity", F.transform("vec", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"), codes.alias("codes"))
    features = sum((F.when(F.isnan(F.get("x", F.lit(i))), 0).otherwise(1 << i) for i in range(len(sp.features))), F.lit(0).cast("long"))
    present = sum((F.when(F.get("codes", F.lit(i)) < 0, 0).otherwise(1 << i) for i in range(len(seasons))), F.lit(0).cast("long"))
    rows = pin(rows.withColumn("features", features).withColumn("present", F.coalesce(present, F.lit(0)).cast("long")))
    groups = tuple(sorted((r["features"], r["present"]) for r in rows.select("features", "present").distinct().collect()))
    number = F.array_position(F.array(*[F.struct(F.lit(f).cast("long").alias("features"), F.lit(p).cast("long").alias("present")) for f, p in groups]),
                              F.struct("features", "present")) - 1 if groups else F.lit(0)
    return Codes(rows.select("entity", "x", "codes", number.cast("int").alias("g")), sp, seasons, roles, groups)


def lists(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def matrix(codes: Codes):
    """The numeric form of a batch, as ``distances`` takes it: values and role codes."""
    wide, seasons = len(codes.space.features), len(codes.seasons)
    return lambda x, c: (lists(x, wide).astype(float), lists(c, seasons).astype(np.int64))


def distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: np.ndarray, cap: float, rho: float,
              step: np.ndarray) -> np.ndarray:
    """All distances of a batch of rows to a bounded set of rows."""
    (x, cx), (y, cy) = a, b
    total, weight = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for f, w in enumerate(weights):
        diff = np.minimum(np.abs(x[:, f, None] - y[None, :, f]) / cap, 1.0)
        both = ~np.isnan(diff)
        weight += w * both
        total += np.where(both, w * diff, 0.0)
    base = np.divide(total, weight, out=np.ones_like(total), where=weight > 0)
    if rho <= 0 or not cx.shape[1]:
        return base
    shared, apart = np.zeros_like(total), np.zeros_like(total)
    for t in range(cx.shape[1]):
        met = (cx[:, t, None] >= 0) & (cy[None, :, t] >= 0)
        shared += met
        apart += np.where(met, step[cx[:, t, None], cy[None, :, t]], 0.0)
    blend = (shared > 0) & (weight > 0)
    return np.where(blend, (1 - rho) * base + rho * apart / np.maximum(shared, 1), base)


def chosen(codes: Codes, entities: Sequence) -> tuple[list, tuple[np.ndarray, np.ndarray]]:
    """The numeric form of a few named rows, ordered by entity."""
    table = codes.rows.where(F.col("entity").isin(list(entities))).orderBy("entity").toArrow().combine_chunks()
    picked = matrix(codes)(*[table.column(c).combine_chunks() for c in ("x", "codes")]) if table.num_rows else (np.zeros((0, 0)),) * 2
    return table.column("entity").to_pylist(), picked


def to_rows(codes: Codes, rows: DataFrame, entities: Sequence) -> DataFrame:
    """rows(entity, x, codes, ...) with ``d``, the distances to the named rows in order of entity; 0 to itself."""
    ids, there = chosen(codes, entities)
    of, form = {e: i for i, e in enumerate(ids)}, matrix(codes)
    weights, cap, rho, step = codes.weights, codes.space.cap, codes.space.role_weight, codes.step

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                d = distances(form(batch.column("x"), batch.column("codes")), there, weights, cap, rho, step)
                for i, e in enumerate(batch.column("entity").to_pylist()):
                    if e in of:
                        d[i, of[e]] = 0.0
                offsets = np.arange(0, d.size + 1, max(d.shape[1], 1), dtype=np.int32) if d.shape[1] else np.zeros(batch.num_rows + 1, np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "d"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(measure, f"{types}, d array<double>")


@dataclass(frozen=True)
class Blend:
    """How much a capped difference, a role step and a featureless pair of two groups weigh."""

    base: np.ndarray
    role: np.ndarray
    none: np.ndarray
    whole: np.ndarray

    @staticmethod
    def of(codes: Codes) -> Blend:
        features = np.array([[m >> i & 1 for i in range(len(codes.space.features))] for m, _ in codes.groups], float)
        present = np.array([[p >> i & 1 for i in range(len(codes.seasons))] for _, p in codes.groups], float).reshape(len(codes.groups), -1)
        weight = (features * codes.weights) @ features.T
        shared = present @ present.T
        rho = codes.space.role_weight
        blend = (weight > 1e-12) & (shared > 0) & (rho > 0)
        share = np.where(blend, 1 - rho, 1.0)
        base = np.divide(share, weight, out=np.zeros_like(weight), where=weight > 1e-12)
        none = (weight <= 1e-12).astype(float)
        return Blend(base, np.where(blend, rho / np.maximum(shared, 1), 0.0), none, np.where(none > 0, 0.0, share))


def _constants(codes: Codes, blend: Blend, slots: DataFrame, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group what every row of it adds (featureless pairs and differences as if all were beyond the cap), and
    per (group, season, role) the role terms; both per slot, from counts."""
    n = np.zeros((n_slots, len(codes.groups)))
    member = slots.select("entity", F.explode("slots").alias("slot"))
    labelled = codes.rows.join(member, "entity")
    for r in labelled.groupBy("slot", "g").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["slot"], r["g"]] = r["n"]
    fixed = (blend.none + blend.whole) @ n.T
    seasons, roles = len(codes.seasons), len(codes.roles)
    role = np.zeros((len(codes.groups), seasons, roles + 1, n_slots))
    if seasons:
        held = np.zeros((n_slots, len(codes.groups), seasons, roles + 1))
        counts = labelled.select("slot", "g", F.posexplode("codes").alias("t", "role")).where("role >= 0").groupBy("slot", "g", "t", "role").agg(
            F.count(F.lit(1)).alias("n"))
        for r in counts.collect():
            held[r["slot"], r["g"], r["t"], r["role"]] = r["n"]
        role = np.einsum("ag,sgtq,rq->atrs", blend.role, held, codes.step)
    return fixed, role


def _running(wide: int):
    """Totals of the chunks before each, per feature; rows come sorted by (feature, chunk)."""
    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, state = None, np.zeros(wide)
        for batch in batches:
            f, totals = batch.column("f").to_pylist(), lists(batch.column("totals"), wide)
            before = np.zeros_like(totals)
            for i in range(batch.num_rows):
                if f[i] != feature:
                    feature, state = f[i], np.zeros(wide)
                before[i] = state
                state = state + totals[i]
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, before.size + 1, wide, dtype=np.int32)), pa.array(before.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("f"), batch.column("chunk"), made], names=["f", "chunk", "totals"])

    return carry


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, size):
            yield batch.slice(first, size)


def _listed(values: np.ndarray, slots: pa.Array | None = None) -> pa.ListArray:
    """Rows of a matrix as lists, or of each row the entries its slots name."""
    if slots is None:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))
    lengths = slots.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    picked = values[np.repeat(np.arange(len(lengths)), lengths), slots.flatten().to_numpy(zero_copy_only=False)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(picked))


def _scatter(batch: pa.RecordBatch, weight: np.ndarray, n_slots: int) -> np.ndarray:
    """(rows, slots): the weight of each data row under each of its slots."""
    out = np.zeros((batch.num_rows, n_slots))
    column = batch.column("slots")
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    out[row, column.flatten().to_numpy(zero_copy_only=False)] = weight[row]
    return out


def _chunk_totals(groups: int, n_slots: int):
    """Per (chunk, feature): counts and sums of data values by group and slot."""
    wide = 2 * groups * n_slots

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in _pieces(batches):
            f, chunk, g = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("f", "chunk", "g"))
            v, data = batch.column("v").to_numpy(zero_copy_only=False), batch.column("shift").to_numpy(zero_copy_only=False) == 0
            for one, two in ((data * 1.0, 0), (data * v, 1)):
                spread = _scatter(batch, one, n_slots)
                for key in set(zip(f.tolist(), chunk.tolist())):
                    here = (f == key[0]) & (chunk == key[1])
                    sums = held.setdefault(key, np.zeros((2, groups, n_slots)))
                    np.add.at(sums[two], g[here], spread[here])
        for (f, chunk), sums in held.items():
            made = pa.ListArray.from_arrays(pa.array([0, wide], pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([chunk], pa.int32()), made], names=["f", "chunk", "totals"])

    return total


def _read(codes: Codes, blend: Blend, n_slots: int, own: bool):
    """What every query position adds to its row's sums; a chunk's running totals come ahead of its values."""
    groups, cap, weights = len(codes.groups), codes.space.cap, codes.weights
    names = ["entity", "part"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((groups, n_slots)), np.zeros((groups, n_slots))
        for batch in _pieces(batches, 2048):
            heads = np.flatnonzero(batch.column("shift").to_numpy(zero_copy_only=False) == -9)
            cuts = np.unique(np.concatenate([[0], heads, heads + 1, [batch.num_rows]]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(lo, hi - lo)
                if lo in heads:
                    state = np.array(part.column("totals")[0].as_py()).reshape(2, groups, n_slots)
                    count, total = state[0].copy(), state[1].copy()
                    continue
                shift, g, f = (part.column(c).to_numpy(zero_copy_only=False) for c in ("shift", "g", "f"))
                v = part.column("v").to_numpy(zero_copy_only=False)
                data = shift == 0
                ones, sums = _scatter(part, data * 1.0, n_slots), _scatter(part, data * v, n_slots)
                out = np.zeros((part.num_rows, n_slots))
                low, mid = (1 - v / cap, 1 / cap), (2 * v / cap, -2 / cap)
                high = (-(1 + v / cap), 1 / cap)
                alpha = np.select([shift == -1, shift == 0], [low[0], mid[0]], high[0])
                beta = np.select([shift == -1, shift == 0], [low[1], mid[1]], high[1])
                for a in np.unique(g):
                    mine = np.flatnonzero(g == a)
                    k = blend.base[a]
                    n = np.cumsum(ones * k[g][:, None], 0)[mine] + k @ count
                    m = np.cumsum(sums * k[g][:, None], 0)[mine] + k @ total
                    out[mine] = weights[f[mine], None] * (alpha[mine, None] * n + beta[mine, None] * m)
                np.add.at(count, g, ones)
                np.add.at(total, g, sums)
                made = _listed(out, part.column("slots") if own else None)
                yield pa.RecordBatch.from_arrays([part.column("entity"), made], names=names)

    return read


def cluster_sums(codes: Codes, slots: DataFrame, n_slots: int, own: int | None = None) -> DataFrame:
    """(entity, slots, sums): every labelled row's summed distance to all rows of each slot.

    slots(entity, slots: array<int>) lists the clusters a row is in (of any number of labellings, numbered through); rows
    without slots take no part.  With ``own``, the most slots of a row, only the sums over a row's own slots are made, in their
    order.  The row itself counts 0.
    """
    blend = Blend.of(codes)
    fixed, role = _constants(codes, blend, slots, n_slots)
    rows = codes.rows.join(slots, "entity")
    cap = codes.space.cap
    values = rows.select("entity", "g", "slots", F.posexplode("x").alias("f", "v")).where(~F.isnan("v"))
    entries = values.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)]))) \
        .withColumn("at", F.col("v") + F.col("shift") * F.lit(float(cap)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pin(entries.select("f", "at", "v", "shift", "entity", "g", "slots")
                 .repartitionByRange(parts, "f", "at", "shift", F.xxhash64("entity")).withColumn("chunk", F.spark_partition_id()))
    wide = 2 * len(codes.groups) * n_slots
    totals = placed.select("f", "chunk", "v", "shift", "g", "slots").mapInArrow(
        _chunk_totals(len(codes.groups), n_slots), "f int, chunk int, totals array<double>")
    totals = totals.groupBy("f", "chunk").agg(F.collect_list("totals").alias("all")).select(
        "f", "chunk", F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.aggregate(
            "all", F.lit(0.0), lambda acc, t: acc + F.get(t, i))).alias("totals"))  # a chunk is read in a few splits
    before = totals.repartition("f").sortWithinPartitions("f", "chunk").mapInArrow(_running(wide), "f int, chunk int, totals array<double>")
    empty = {c: F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("at", "v", "entity", "g", "slots")}
    heads = before.select("f", empty["at"], empty["v"], F.lit(-9).alias("shift"), empty["entity"], empty["g"], empty["slots"], "chunk", "totals")
    body = placed.withColumn("totals", F.lit(None).cast("array<double>"))
    lined = heads.unionByName(body).repartition("f", "chunk").sortWithinPartitions("f", "chunk", F.col("at").asc_nulls_first(), "shift")
    entity = placed.schema["entity"].dataType.simpleString()
    width = n_slots if own is None else own
    read = lined.mapInArrow(_read(codes, blend, n_slots, own is not None), f"entity {entity}, part array<double>")
    added = read.groupBy("entity").agg(F.array(*[F.sum(F.get("part", F.lit(i))) for i in range(width)]).alias("parts"))
    none = F.array(*[F.lit(None).cast("double")] * width)
    whole = rows.select("entity", "g", "codes", "slots").join(added, "entity", "left").withColumn("parts", F.coalesce("parts", none))
    made = whole.mapInArrow(_complete(codes, fixed, role, own is not None, width), f"entity {entity}, slots array<int>, sums array<double>")
    return made


def _complete(codes: Codes, fixed: np.ndarray, role: np.ndarray, own: bool, width: int):
    bare = [g for g, (features, _) in enumerate(codes.groups) if features == 0]  # such a row is at distance 1 from itself by the formula
    seasons = len(codes.seasons)

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            g, roles = batch.column("g").to_numpy(zero_copy_only=False), lists(batch.column("codes"), seasons).astype(np.int64)
            sums = fixed[g].copy()
            for t in range(roles.shape[1]):
                known = roles[:, t] >= 0
                sums[known] += role[g[known], t, roles[known, t]]
            column = batch.column("slots")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            row, slot = np.repeat(np.arange(len(lengths)), lengths), column.flatten().to_numpy(zero_copy_only=False)
            alone = np.isin(g[row], bare)
            sums[row[alone], slot[alone]] -= 1.0
            parts = lists(batch.column("parts"), width)  # a row without any feature has no parts
            if own:
                place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                sums[row, slot] += np.nan_to_num(parts[row, place])
            else:
                sums += np.nan_to_num(parts)
            yield pa.RecordBatch.from_arrays([batch.column("entity"), column, _listed(np.maximum(sums, 0.0), column if own else None)],
                                             names=["entity", "slots", "sums"])

    return complete
