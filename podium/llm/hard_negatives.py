"""Hard negatives by rotated one-bit codes, exact.

Components become integers, are rotated by a signed Hadamard transform (still integers, all products scaled by its size P) and stored
with the bits of their signs b, the alignment a = <y, b> / P and the length of the residual r = y - a b. For an anchor q, rotated and
quantised to ``BITS`` bit planes, popcounts of planes against codes give c = <q, b> up to a bounded rounding. As r is orthogonal to b,

    <y, q> = a c + <r, q>   and   |<r, q>| <= |r| sqrt(|q|^2 - c^2 / P)      (Cauchy-Schwarz),

an interval that holds the score for certain. Only rows whose interval can still enter an anchor's list are scored, in integers.

All rows stay where Spark has them; anchors go out in blocks of bounded size, with two passes over the codes a block: one for
the positives, one for the negatives within the windows the positives set. A task keeps k rows a list, and Spark merges the tasks' lists.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a null vec_id takes part as a candidate,
after all others among equals; an exact repetition (vec_id, label, integers) counts as one row, and rows that share a vec_id
but not the rest are rows of their own; shorter vectors are continued with zeros; components are cut at +-2**31, and scores beyond
64 bits wrap; other columns are not read. No anchor, no positive or no negative gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import pin

K = 5
BITS = 8
#: anchors in a pass: at 64 components about 40 MB in each Python worker
BLOCK = 1 << 15
#: pairs bounded at a time
TILE = 1 << 19
NO_ID = (1 << 63) - 1
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
LOW = -(1 << 62)

SQL = """
WITH rows_in AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM rows_in a JOIN rows_in b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, relabelled, with integer components."""
    vec_id, vec = F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label").cast("int")
    edge = F.lit(float(1 << 31))
    return embeddings.where(label.isNotNull() & vec.isNotNull() & usable).select(
        vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(vec, lambda x: F.floor(F.greatest(-edge, F.least(edge, x * 256.0))).cast("long")).alias("v"))


def rotate(x: np.ndarray, size: int) -> np.ndarray:
    """Signed Hadamard transform of integer rows: orthogonal up to the factor sqrt(size)."""
    y = np.zeros((len(x), size))
    y[:, :x.shape[1]] = x
    y *= np.where(np.random.default_rng(size).integers(0, 2, size), 1.0, -1.0)
    h = 1
    while h < size:
        y = y.reshape(len(x), size // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2)
        h *= 2
    return y.reshape(len(x), size)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def size_of(dim: int) -> int:
    return max(64, 1 << max(dim - 1, 0).bit_length())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integer lists as rows, continued with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), dim), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


_CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("v", pa.list_(pa.int64())), ("code", pa.binary()),
                    ("align", pa.float64()), ("length", pa.float64()), ("residual", pa.float64())])
_CODES_DDL = "vec_id bigint, label int, v array<bigint>, code binary, align double, length double, residual double"


def _code(dim: int):
    size = size_of(dim)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = rotate(matrix(batch.column(2), dim), size)
            align = np.abs(y).sum(1) / size
            square = (y * y).sum(1)
            code = packed(y >= 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(align),
                 pa.array(np.sqrt(square)), pa.array(np.sqrt(np.maximum(square - size * align * align, 0)))], schema=_CODES)

    return make


class Anchors:
    """A block of anchors: integers, bit planes of the rotated vectors, and what bounds their rounding."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.size = size_of(v.shape[1])
        y = rotate(v, self.size)
        self.length = np.sqrt((y * y).sum(1))
        self.low = y.min(1)
        self.step = np.maximum((y.max(1) - self.low) / ((1 << BITS) - 1), 1e-300)
        steps = np.rint((y - self.low[:, None]) / self.step[:, None])
        self.rounding = np.abs(y - self.low[:, None] - steps * self.step[:, None]).sum(1)
        planes = (steps.astype(np.int64)[:, None, :] >> np.arange(BITS)[None, :, None]) & 1
        self.planes = packed(planes.astype(np.uint8))
        self.ones = np.bitwise_count(self.planes).sum(2, dtype=np.int64)


class Codes:
    """A batch of coded rows, exact repetitions left out."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        v = matrix(batch.column(2), dim)
        _, keep = np.unique(np.column_stack([ids, labels, v]), axis=0, return_index=True) if len(np.unique(ids)) < len(ids) else (0, slice(None))
        self.ids, self.labels, self.v = ids[keep], labels[keep], v[keep]
        code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        self.code = code[keep]
        self.align, self.length, self.residual = (batch.column(i).to_numpy(zero_copy_only=False)[keep] for i in (4, 5, 6))
        self.sign_sum = 2.0 * np.bitwise_count(self.code).sum(1, dtype=np.int64) - size_of(dim)


def bounds(anchors: Anchors, some: slice, rows: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of some anchors with all rows, from popcounts."""
    estimate = anchors.low[some, None] * rows.sign_sum[None, :]
    for bit in range(BITS):
        hits = np.bitwise_count(anchors.planes[some, None, bit] & rows.code[None]).sum(2, dtype=np.int32)
        estimate += (anchors.step[some, None] * (1 << bit)) * (2.0 * hits - anchors.ones[some, None, bit])
    rounding = anchors.rounding[some, None]
    inside = np.maximum(np.abs(estimate) - rounding, 0)
    across = np.sqrt(np.maximum(anchors.length[some, None] ** 2 - inside * inside / anchors.size, 0))
    reach = rows.align * rounding + rows.residual * across
    reach += 1e-9 * (anchors.length[some, None] * rows.length) + 1e-6
    middle = rows.align * estimate
    return (middle - reach) / anchors.size, (middle + reach) / anchors.size


def best(lists: np.ndarray, score: np.ndarray, ids: np.ndarray, more: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k distinct entries of each list, by falling score, then id."""
    order = np.lexsort((*more.T[::-1], ids, -score, lists))
    rows = np.column_stack([lists, score, ids, more])[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(1)
    order = order[fresh]
    starts = np.searchsorted(lists[order], lists[order])
    return order[np.arange(len(order)) - starts < k]


def digest(v: np.ndarray) -> np.ndarray:
    """A stable hash of integer rows, to tell rows of one id apart."""
    weights = np.random.default_rng(5).integers(1, 1 << 62, v.shape[1]) * 2 + 1
    return (v * weights).sum(1)


class Lists:
    """The first k rows of numbered lists so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows = np.zeros((0, 5), np.int64)  # list, score, id, label, digest
        self.floor = np.full(n, LOW)

    def add(self, lists: np.ndarray, score: np.ndarray, rows: Codes, at: np.ndarray) -> None:
        if not len(lists):
            return
        fresh = np.column_stack([lists, score, rows.ids[at], rows.labels[at], digest(rows.v[at])])
        both = np.concatenate([self.rows, fresh])
        self.rows = both[best(both[:, 0], both[:, 1], both[:, 2], both[:, 3:], self.k)]
        held, first, count = np.unique(self.rows[:, 0], return_index=True, return_counts=True)
        full = count == self.k
        self.floor[held[full]] = self.rows[first[full] + self.k - 1, 1]


def tiles(anchors: Anchors, batches: Iterator[pa.RecordBatch], dim: int):
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            rows = Codes(batch.slice(first, 4096), dim)
            step = max(TILE // max(len(rows.ids), 1), 1)
            for start in range(0, len(anchors.ids), step):
                yield rows, slice(start, min(start + step, len(anchors.ids)))


def exact(anchors: Anchors, a: np.ndarray, rows: Codes, r: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 1 << 16):
        part = slice(i, i + (1 << 16))
        out[part] = (anchors.v[a[part]] * rows.v[r[part]]).sum(1)
    return out


_FOUND = pa.schema([(name, pa.int64()) for name in ("list", "score", "id", "label", "digest")])
_FOUND_DDL = "list bigint, score bigint, id bigint, label bigint, digest bigint"


def _found(lists: Lists) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in lists.rows.T], schema=_FOUND)


def _positives(shared, dim: int, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*shared.value)
        own = digest(anchors.v)
        found = Lists(len(anchors.ids), k)

        def keep(a: np.ndarray, r: np.ndarray, rows: Codes) -> None:
            other = anchors.ids[a] != rows.ids[r]
            twin = np.flatnonzero(~other)
            other[twin] = digest(rows.v[r[twin]]) != own[a[twin]]
            found.add(a[other], exact(anchors, a[other], rows, r[other]), rows, r[other])

        for rows, some in tiles(anchors, batches, dim):
            _, high = bounds(anchors, some, rows)
            same = anchors.labels[some, None] == rows.labels[None, :]
            high[~same] = LOW
            near = np.argpartition(high, -k - 1, axis=1)[:, -k - 1:] if high.shape[1] > k else np.tile(np.arange(high.shape[1]), (len(high), 1))
            a, r = np.repeat(np.arange(len(high)), near.shape[1]), near.ravel()
            keep(some.start + a[same[a, r]], r[same[a, r]], rows)  # the best bounds first: their scores tell which others can still enter
            floor = found.floor[some]
            a, r = np.nonzero(same & (high >= floor[:, None]))
            keep(some.start + a, r, rows)
        yield _found(found)

    return scan


def _negatives(shared, dim: int, k: int, num: int, den: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, top = shared.value  # windows: anchor's place (rising) and the positive's score
        anchors = Anchors(*block)
        found = Lists(len(at), k)
        # 100 * s >= num * top in integers
        least = -((-num * top) // den)
        first = np.searchsorted(at, np.arange(len(anchors.ids) + 1))
        widest = int(np.diff(first).max(initial=0))
        for rows, some in tiles(anchors, batches, dim):
            low, high = bounds(anchors, some, rows)
            differs = anchors.labels[some, None] != rows.labels[None, :]
            begin, count = first[some.start:some.stop], np.diff(first[some.start:some.stop + 1])
            wanted = np.zeros(low.shape, bool)
            for j in range(widest):
                has = count > j
                w = begin[has] + j
                floor = np.maximum(least[w], found.floor[w])
                wanted[has] |= (high[has] >= floor[:, None]) & (low[has] <= top[w][:, None])
            a, r = np.nonzero(wanted & differs)
            score = exact(anchors, a + some.start, rows, r)
            for j in range(widest):
                has = count[a] > j
                w = begin[a[has]] + j
                within = (score[has] >= least[w]) & (score[has] <= top[w])
                found.add(w[within], score[has][within], rows, r[has][within])
        yield _found(found)

    return scan


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k of each list over all tasks (the window's limit is applied before the shuffle as well)."""
    order = W.partitionBy("list").orderBy(F.desc("score"), "id", "label", "digest")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _id(column: Column) -> Column:
    return F.nullif(column, F.lit(NO_ID))


def hard_negatives(embeddings: DataFrame, every: int = 100, k: int = K, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """For each anchor (vec_id divisible by ``every``) and each of its first k rows of the same label, the first k rows
    of other labels that score between num/den of the positive's score and that score."""
    rows = integers(embeddings)
    spark = embeddings.sparkSession
    dim = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    codes = pin(rows.mapInArrow(_code(dim), _CODES_DDL))
    numbered = pin(codes.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v").distinct()
                   .withColumn("block", F.xxhash64("vec_id", "label", "v")))
    n = numbered.count()
    parts = max(-(-n // block), 1)
    out = None
    for part in range(parts):
        here = numbered.where(F.pmod("block", F.lit(parts)) == part)
        table = here.orderBy("vec_id", "label", "v").toArrow().combine_chunks()
        ids, labels = (table.column(i).to_numpy() for i in (0, 1))
        if not len(ids):
            continue
        v = matrix(table.column(2).combine_chunks(), dim)
        shared = spark.sparkContext.broadcast((ids, labels, v))
        positives = _merged(codes.mapInArrow(_positives(shared, dim, k), _FOUND_DDL), k).orderBy("list", "rank").toArrow()
        at, top, positive = (positives.column(name).to_numpy() for name in ("list", "score", "id"))
        windows = spark.sparkContext.broadcast(((ids, labels, v), at, top))
        found = _merged(codes.mapInArrow(_negatives(windows, dim, k, num, den), _FOUND_DDL), k)
        names = spark.createDataFrame(pa.table({"list": np.arange(len(at)), "anchor_id": ids[at], "positive_id": positive, "positive_score": top}))
        made = pin(found.join(names, "list").select("anchor_id", _id(F.col("positive_id")).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                                    _id(F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        shared.unpersist()
        windows.unpersist()
        out = made if out is None else out.unionAll(made)
    return spark.createDataFrame([], RESULT) if out is None else out
