"""Exact nearest neighbours and similarity joins over cells of rows, without comparing all rows.

Distances with missing features and shared roles obey no triangle inequality, so the index bounds them by boxes instead.
Rows join the nearest of a bounded number of hashed pivot rows; a pivot's rows with the same features present are a cell,
with the least and greatest value of each feature.  The weighted gaps of a row to a box bound its distance to
every row inside from below; a row is sent to those cells only that can hold a neighbour within its reach, which
is its k-th distance among the rows of its own neighbourhood (or the limit of a join).  Queries and cells travel as packed
blocks of bounded size, so a crowded cell is split over tasks, and a task measures one block against one block.

What a join finds can be quadratic, so found pairs are never shuffled: runs of near cells are tiles of a bounded number of members, a row goes
to the tiles that hold cells within its reach, and the task of two tiles measures contents once and returns the pairs of their members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import pin
from .boards import top_k
from .distance_sums import Codes, coded, distances, lists, to_rows
from .similarity import Space

#: rows a cell aims at, pivots at most (their boxes go to every task), rows of a packed block
CELL, PIVOTS, BLOCK = 48, 4096, 1024
#: members a tile of a join aims at and members a row of it holds at most, about; rows measured and pairs returned at a time; tasks at most
TILE, HELD, STRIPE, PAIRS, TASKS = 2048, 512, 512, 1 << 18, 4096
SLACK = 2e-9


def profiles(scaled: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows with equal features, roles and event set collapse to one profile with its k + 1 smallest members."""
    content = F.to_json(F.struct("vec", F.sort_array(F.map_entries("roles")).alias("roles"), "set_id"))
    keyed = pin(scaled.withColumn("profile", F.sha2(content, 256)))
    members = keyed.select("profile", "entity")
    few = top_k(members, ["profile"], [("entity", True)], k + 1).groupBy("profile").agg(F.sort_array(F.collect_list("entity")).alias("ids"))
    return pin(_contents(keyed).join(few, "profile")), members


def _contents(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("profile").agg(*[F.first(c).alias(c) for c in ("vec", "roles", "set_id")])


class Kernel:
    """What a task needs to measure blocks of rows."""

    def __init__(self, codes: Codes):
        self.weights, self.cap, self.rho, self.step = codes.weights, codes.space.cap, codes.space.role_weight, codes.step
        self.wide, self.seasons = len(codes.space.features), len(codes.seasons)

    def form(self, rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        return lists(rows.field("x"), self.wide).astype(float), lists(rows.field("codes"), self.seasons).astype(np.int64)

    def measure(self, asked: pa.StructArray, offered: pa.StructArray) -> np.ndarray:
        return distances(self.form(asked), self.form(offered), self.weights, self.cap, self.rho, self.step)

    def bound(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """What the distance of a row to any row inside a box is at least, for all rows and boxes."""
        total, weight = np.zeros((len(x), len(low))), np.zeros((len(x), len(low)))
        for f, w in enumerate(self.weights):
            gap = np.maximum(low[None, :, f] - x[:, f, None], x[:, f, None] - high[None, :, f])
            both = ~np.isnan(gap)
            weight += w * both
            total += np.where(both, w * np.clip(gap / self.cap, 0.0, 1.0), 0.0)
        return np.divide((1 - self.rho) * total, weight, out=np.ones_like(total), where=weight > 0)

    def apart(self, asked: pa.StructArray, offered: pa.StructArray, d: np.ndarray) -> np.ndarray:
        """Distances with the row itself and its team mates out of reach."""
        names, others = asked.field("entity"), offered.field("entity")
        there = {e: j for j, e in enumerate(others.to_pylist())}
        for i, e in enumerate(names.to_pylist()):
            if e in there:
                d[i, there[e]] = np.inf
        mates, sets = asked.field("mates"), offered.field("set_id")
        if not len(mates.flatten()):
            return d
        for i in range(len(mates)):
            if mates[i].is_valid and len(mates[i]):
                d[i, pc.is_in(sets, value_set=mates[i].values).to_numpy(zero_copy_only=False)] = np.inf
        return d


def _blocks(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Rows of a key packed into blocks of about ``BLOCK``; of a cell only its size is broadcast, as its box is."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    spread = rows.join(F.broadcast(sizes), key).withColumn("block", F.pmod(F.xxhash64("entity"), F.col("blocks")))
    return spread.groupBy(key, "block").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("block")


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _reach(kernel: Kernel, rows: DataFrame, k: int) -> DataFrame:
    """(entity, reach): each row's k-th distance within a block of its neighbourhood, 1 where that has fewer rows."""
    packed = _blocks(rows, "near", ["entity", "x", "codes", "set_id", "mates"], "rows")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].values
                d = kernel.apart(block, block, kernel.measure(block, block))
                reach = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), 1.0)
                yield pa.RecordBatch.from_arrays([block.field("entity"), pa.array(np.minimum(reach, 1.0))], names=["entity", "reach"])

    return packed.select("rows").mapInArrow(local, f"{_ddl(rows, ['entity'])}, reach double")


def _edges(kernel: Kernel, boxes: list) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([b[side] for b in boxes], float).reshape(len(boxes), kernel.wide) for side in ("low", "high"))


def _routed(kernel: Kernel, rows: DataFrame, boxes: list, tiles: list | None = None) -> DataFrame:
    """Rows with the numbers of the cells whose boxes are within their reach, or of the tiles of such cells, from the row's own one on."""
    low, high = _edges(kernel, boxes)
    if tiles is not None:
        member = np.repeat(np.arange(len(boxes)), [n for _, n in tiles])
        starts = np.unique(np.concatenate([first + np.arange(n) for first, n in tiles] or [np.zeros(0, int)]), return_index=True)[1]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                x = lists(batch.column("x"), kernel.wide).astype(float)
                near = kernel.bound(x, low, high) <= batch.column("reach").to_numpy(zero_copy_only=False)[:, None] + SLACK
                if tiles is not None:
                    near = np.logical_or.reduceat(near[:, member], starts, axis=1)
                    near &= np.arange(len(starts)) >= batch.column("home").to_numpy(zero_copy_only=False)[:, None]
                row, cell = np.nonzero(near)
                offsets = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(route, f"{_ddl(rows, rows.columns)}, cells array<int>")


def _placed(contents: DataFrame, extra: DataFrame, sp: Space) -> tuple[Kernel, DataFrame, list]:
    """The kernel, rows(entity, x, codes, pivot, mask, near) with the extra columns of their profile, written once, and the boxes of their cells."""
    codes = coded(contents.select(F.col("profile").alias("entity"), "vec", "roles"), sp)
    kernel = Kernel(codes)
    n = codes.rows.count()
    pivots = [r["entity"] for r in codes.rows.select("entity").orderBy(F.xxhash64("entity"), "entity").limit(max(min(-(-n // CELL), PIVOTS), 1)).collect()]
    measured = to_rows(codes, codes.rows, pivots)
    wider = F.slice("d", 1, max(len(pivots) // 6, 1))  # neighbourhoods of about six cells
    mask = sum((F.when(F.isnan(F.get("x", F.lit(i))), 0).otherwise(1 << i) for i in range(kernel.wide)), F.lit(0).cast("long"))
    placed = measured.select("entity", "x", "codes", F.array_position("d", F.array_min("d")).alias("pivot"), mask.alias("mask"),
                             F.array_position(wider, F.array_min(wider)).alias("near"))
    rows = pin(placed.join(extra, "entity"))
    edges = [f(F.get("x", F.lit(i))) for f in (F.min, F.max) for i in range(kernel.wide)]
    boxes = rows.groupBy("pivot", "mask").agg(F.array(*edges[:kernel.wide]).alias("low"), F.array(*edges[kernel.wide:]).alias("high"), F.sum(F.size("ids")).alias("n")) \
        .orderBy("pivot", "mask").collect()  # pivots x null masks
    return kernel, rows, boxes


def _pairs(profile_rows: DataFrame, sp: Space, k: int, mates: DataFrame | None) -> DataFrame:
    """(profile, ids, other, distance) of all pairs of blocks: the k nearest profiles of each row."""
    extra = profile_rows.select(F.col("profile").alias("entity"), "set_id", "ids")
    if mates is not None:
        listed = mates.groupBy("mate_a").agg(F.collect_set("mate_b").alias("mates"))
        extra = extra.join(listed, F.col("set_id") == F.col("mate_a"), "left").drop("mate_a")
    else:
        extra = extra.withColumn("mates", F.array().cast(f"array<{extra.schema['set_id'].dataType.simpleString()}>"))
    kernel, rows, boxes = _placed(profile_rows, extra, sp)
    number = rows.sparkSession.createDataFrame([(b["pivot"], b["mask"], i) for i, b in enumerate(boxes)], "pivot long, mask long, cell int")
    asked = _routed(kernel, rows.join(_reach(kernel, rows, k), "entity").select("entity", "x", "codes", "mates", "reach"), boxes)
    queries = _blocks(asked.select("entity", "x", "codes", "mates", F.explode("cells").alias("cell")), "cell", ["entity", "x", "codes", "mates"], "asked")
    held = rows.join(F.broadcast(number), ["pivot", "mask"]) if len(boxes) <= PIVOTS else rows.join(number, ["pivot", "mask"])
    cells = _blocks(held, "cell", ["entity", "x", "codes", "set_id", "ids"], "offered")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine, theirs = batch.column(0)[i].values, batch.column(1)[i].values
                order = pc.sort_indices(pa.array([x[0] for x in theirs.field("ids").to_pylist()]))
                theirs = theirs.take(order)  # equal distances go by the least member
                d = kernel.apart(mine, theirs, np.round(kernel.measure(mine, theirs), 9))
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                row, at = np.repeat(np.arange(len(d)), best.shape[1]), best.ravel()
                keep = np.isfinite(d[row, at])
                row, at = row[keep], at[keep]
                yield pa.RecordBatch.from_arrays([mine.field("entity").take(pa.array(row)), theirs.field("ids").take(pa.array(at)),
                                                  theirs.field("entity").take(pa.array(at)), pa.array(d[row, at])], names=["profile", "ids", "other", "distance"])

    types = f"profile string, {_ddl(rows, ['ids'])}, other string, distance double"
    # Spark's size estimate does not know how many cells a row goes to and would broadcast blocks, which pass through the driver
    return queries.hint("merge").join(cells, "cell").select("asked", "offered").mapInArrow(compare, types)


def nearest(scaled: DataFrame, sp: Space, k: int, sets: DataFrame | None = None, mates: DataFrame | None = None) -> DataFrame:
    """The exact k nearest others of every entity (ties by entity), without comparing all pairs.

    With sets(entity, set_id) and mates(set_id, other_id) team mates are left out: entities whose
    event sets are listed as a pair, a set listed with itself included.  Equal rows are compared once.
    """
    if mates is not None:
        both = mates.select(F.col("set_id").alias("mate_a"), F.col("other_id").alias("mate_b"))
        mates = pin(both.union(both.select("mate_b", "mate_a")).distinct())
        scaled = scaled.join(sets.select("entity", "set_id"), "entity", "left")
    else:
        scaled = scaled.withColumn("set_id", F.lit(None).cast("long"))
    rows, members = profiles(scaled, k)
    measured = _pairs(rows, sp, k, mates).select("profile", F.explode(F.slice("ids", 1, k)).alias("other"), "distance")
    best = top_k(measured, ["profile"], [("distance", True), ("other", True)], k).drop("position")
    shared = rows.where(F.size("ids") > 1)
    if mates is not None:
        shared = shared.join(mates.where("mate_a = mate_b"), F.col("set_id") == F.col("mate_a"), "left_anti")
    own = shared.select("profile", F.explode("ids").alias("other"), _self_distance().alias("distance"))
    offers = members.join(best.unionByName(own), "profile").where(F.col("entity") != F.col("other"))
    return top_k(offers.drop("profile"), ["entity"], [("distance", True), ("other", True)], k) \
        .withColumn("score", F.round((1 - F.col("distance")) * 100, 6))


def _self_distance() -> Column:
    """Of two rows of equal content: 1 without any feature."""
    return F.when(F.exists("vec", lambda v: v.isNotNull()), 0.0).otherwise(1.0)


def _members(keyed: DataFrame) -> DataFrame:
    """(entity, ids): the members of each profile, in several rows where they are many."""
    sizes = keyed.groupBy("profile").agg(F.ceil(F.count(F.lit(1)) / F.lit(HELD)).alias("parts"))
    parts = keyed.select("profile", "entity").join(sizes, "profile").withColumn("part", F.pmod(F.xxhash64("entity"), F.col("parts")))
    return parts.groupBy("profile", "part").agg(F.sort_array(F.collect_list("entity")).alias("ids")).select(F.col("profile").alias("entity"), "ids")


def _tiled(kernel: Kernel, boxes: list) -> tuple[list, list]:
    """The boxes with near ones together, and (first tile, tiles) of each: boxes share a tile up to ``TILE`` members, larger ones have several of their own."""
    centre = np.nan_to_num(sum(_edges(kernel, boxes)) / 2, nan=-1e3)

    def halved(at: np.ndarray) -> list[int]:
        if len(at) < 3:
            return at.tolist()
        widest = np.argmax(kernel.weights * np.ptp(centre[at], axis=0))
        at = at[np.argsort(centre[at, widest], kind="stable")]
        return halved(at[:len(at) // 2]) + halved(at[len(at) // 2:])

    boxes, tiles, last, room = [boxes[i] for i in halved(np.arange(len(boxes)))], [], -1, 0
    for box in boxes:
        own = -(-box["n"] // TILE)
        if own > 1:
            tiles.append((last + 1, own))
            last, room = last + own, 0
            continue
        if box["n"] > room:
            last, room = last + 1, TILE
        tiles.append((last, 1))
        room -= box["n"]
    return boxes, tiles


def _ramps(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


class Side:
    """Rows of a tile: their numeric form and their members."""

    def __init__(self, kernel: Kernel, rows: pa.StructArray):
        self.x, self.codes = kernel.form(rows)
        self.ids, self.sizes = rows.field("ids").flatten(), pc.list_value_length(rows.field("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes


def _within(kernel: Kernel, asked: pa.StructArray, offered: pa.StructArray, limit: float) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Members and distances of the pairs of rows within the limit, in pieces of bounded size; a box that is too far is not measured."""
    offered = offered.take(pc.sort_indices(offered.field("box")))
    mine, theirs = Side(kernel, asked), Side(kernel, offered)
    first = np.unique(offered.field("box").to_numpy(), return_index=True)[1]
    near = kernel.bound(mine.x, np.minimum.reduceat(theirs.x, first), np.maximum.reduceat(theirs.x, first)) <= limit + SLACK
    for box, (start, end) in enumerate(zip(first, [*first[1:], len(theirs.x)])):
        rows = np.flatnonzero(near[:, box])
        for at in (rows[i:i + STRIPE] for i in range(0, len(rows), STRIPE)):
            d = distances((mine.x[at], mine.codes[at]), (theirs.x[start:end], theirs.codes[start:end]), kernel.weights, kernel.cap, kernel.rho, kernel.step)
            row, other = np.nonzero(np.round(d, 9) <= limit)
            found, row, other = d[row, other], at[row], start + other
            piece = np.cumsum(mine.sizes[row] * theirs.sizes[other]) // PAIRS
            for cut in np.split(np.arange(len(row)), np.flatnonzero(np.diff(piece)) + 1) if len(row) else []:
                i, j = row[cut], other[cut]
                one, pair = _ramps(mine.starts[i], mine.sizes[i]), np.repeat(np.arange(len(cut)), mine.sizes[i])
                many = theirs.sizes[j][pair]
                yield (mine.ids.take(pa.array(np.repeat(one, many))), theirs.ids.take(pa.array(_ramps(theirs.starts[j][pair], many))),
                       np.repeat(found[cut][pair], many))


def within_distance(scaled: DataFrame, sp: Space, limit: float) -> DataFrame:
    """(a, b, distance) of every pair a < b no further apart than ``limit``, exactly; contents are measured once a pair of tiles."""
    content = F.to_json(F.struct("vec", F.sort_array(F.map_entries("roles")).alias("roles")))
    keyed = pin(scaled.withColumn("profile", F.sha2(content, 256)).withColumn("set_id", F.lit(None).cast("long")))
    kernel, rows, boxes = _placed(_contents(keyed), _members(keyed), sp)
    boxes, tiles = _tiled(kernel, boxes)
    number = rows.sparkSession.createDataFrame([(b["pivot"], b["mask"], i, *tile) for i, (b, tile) in enumerate(zip(boxes, tiles))],
                                               "pivot long, mask long, box int, first int, tiles int")
    home = F.col("first") + F.pmod(F.xxhash64("ids"), F.col("tiles")).cast("int")
    held = (rows.join(number, ["pivot", "mask"]).select("x", "codes", "ids", "box", home.alias("home"), F.lit(float(limit)).alias("reach")))
    routed = pin(_routed(kernel, held, boxes, tiles))
    count = sum(tiles[-1]) if tiles else 1
    tasks = max(1, min(count * (count + 1) // 2, TASKS))
    asked = routed.select("home", F.explode("cells").alias("cell"), "x", "codes", "ids")
    meet = asked.select("cell", "home").distinct()
    offered = routed.select(F.col("home").alias("cell"), "x", "codes", "ids", "box").join(meet, "cell")

    def packed(side: DataFrame, columns: list[str], name: str) -> DataFrame:
        return side.repartition(tasks, "cell", "home").groupBy("cell", "home").agg(F.collect_list(F.struct(*columns)).alias(name))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("cell")[i].as_py() == batch.column("home")[i].as_py()
                for a, b, d in _within(kernel, batch.column("asked")[i].values, batch.column("offered")[i].values, limit):
                    if same:  # both orders of a pair are met here
                        keep = pc.less(a, b)
                        a, b, d = a.filter(keep), b.filter(keep), d[keep.to_numpy(zero_copy_only=False)]
                    yield pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b), pa.array(d)], names=["a", "b", "distance"])

    both = packed(asked, ["x", "codes", "ids"], "asked").hint("merge").join(packed(offered, ["x", "codes", "ids", "box"], "offered"), ["cell", "home"])
    kind = scaled.schema["entity"].dataType.simpleString()
    return both.mapInArrow(compare, f"a {kind}, b {kind}, distance double")
