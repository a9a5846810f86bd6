"""N-gram Jaccard join by PartEnum signatures, with the groups its links form.

A document's set holds the hashes of its distinct n-word shingles. Sets fall into size bands so that linked sets are in one
band or in neighbours; for a pair of bands the symmetric difference of linked sets is at most k. The hash domain is cut into
first-level partitions and these into ``PARTS`` second-level ones: by the pigeonhole principle enough first-level
partitions hold at most k2 differing parts, so that some subset of its parts without them is equal in both sets. The
hash of each such subset is a signature (k2 is 1 for small bands and 0, the whole partition, for large ones). A subset may be
empty, and empty subsets are no signatures. Partitions beyond the pigeonhole (``_layout``) make sure that a set with no more empty ones than those meets its
partners elsewhere; a set with more is signed again under another hash of the domain, and under the last of ``LAYOUTS`` with its empty
subsets too, so no link is lost.

Equal sets are one class. The classes that share a signature with another are split further: a set with more shingles of its own than a link
allows is alone; of the others, two linked ones share one of their rarest shingles, at places that bound their difference. Within such a group each class is first compared
with the group's leader only, which joins most copies into one component, and classes in one component need no comparison; then with about ``HEADS``
members a turn (a small group with all of its own), which leave the group after it, until no group spans two components. So a turn compares places in proportion to the
groups' sizes, and makes rows only of pairs whose places allow a link. A pair is compared if it also shares a signature; every comparison is the exact intersection of the two sets, in the JVM.

Defined results: null or wordless text has an empty set, linked with nothing; fewer words than n form one shingle; a doc_id
that repeats with other text takes, row by row, the component of its own text; a null doc_id counts as the least id and is returned as
null; ties do not arise, components are named by their smallest id; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import core
from .tables import ROW, pin, positional, row_id

PARTS, SPARE, LAYOUTS = 3, 2, 4
SMALL_K = 12
HEADS = 2048
U = core.U


class Bands:
    """Size bands for a similarity of num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    @lru_cache(maxsize=None)  # noqa: B019
    def edges(self, size: int) -> np.ndarray:
        """First sizes of the bands up to one beyond ``size``."""
        first = [1]
        while first[-1] <= size:
            first.append(first[-1] * self.den // self.num + 1)
        first.append(first[-1] * self.den // self.num + 1)
        return np.array(first)

    def difference(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=4096)
def _layout(k: int, low: int) -> tuple[int, int, int, np.ndarray]:
    """Second-level parts in a first-level partition, first-level partitions, those beyond the pigeonhole (about as many as a
    set of ``low`` shingles leaves empty, and two), and inner edges of all parts in the hash domain."""
    k2, parts = (1, PARTS) if k < SMALL_K else (0, 1)
    first = k // (k2 + 1) + 1 + SPARE
    spare = SPARE + int(np.ceil(first * parts * np.exp(-low * max(parts - 1, 1) / (first * parts)) - 0.05))
    first += spare - SPARE
    cells = first * parts
    return parts, first, spare, np.array([(j << 64) // cells for j in range(1, cells)], U)


def _signatures(shingles: np.ndarray, k: int, band: int, low: int) -> np.ndarray:
    """Signatures of a sorted set in one pair of bands, whose sets have ``low`` shingles at least."""
    if k == 0:
        return np.zeros(0, U)  # only equal sets link
    parts, first, spare, edges = _layout(k, low)
    out = []
    for turn in range(LAYOUTS):
        s = shingles if turn == 0 else np.sort(core.mix(shingles + U(turn)))
        sums = np.zeros(len(s) + 1, U)
        np.cumsum(core.mix(s), out=sums[1:])
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        content, number = np.diff(sums[at]).reshape(first, parts), np.diff(at).reshape(first, parts)
        if parts > 1:  # each subset leaves one part out
            content = content.sum(axis=1, keepdims=True, dtype=U) - content
            number = number.sum(axis=1, keepdims=True) - number
        void = number == 0
        tags = np.arange(first * parts, dtype=U).reshape(first, parts) + U(turn << 56 | band << 32)
        found = core.mix(content + core.mix(tags))
        few = void.any(axis=1).sum() <= spare
        out.append(found.ravel() if turn == LAYOUTS - 1 and not few else found[~void])
        if few:
            break
    return np.concatenate(out)


def _sets(column: pa.Array, n: int):
    """(row, sorted distinct shingle hashes) of every text with a word."""
    for first, end, data, offsets in core.chunks(column):
        data = core.LOWER[data]
        words = core.Words(data, offsets)
        hashes = core.spans(core.running(data), words.starts, words.ends)
        grams = core.shingles(hashes, n)
        for i in range(end - first):
            lo, hi = words.first[i], words.first[i + 1]
            if hi - lo >= n:
                yield first + i, np.unique(grams[lo:hi - n + 1])
            elif hi > lo:
                yield first + i, core.shingles(hashes[lo:hi], hi - lo) ^ U(hi - lo)


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(row_id().alias("id"), F.col("text").cast("string").alias("text"))


def keys(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, id, n_shingles, k1, k2): size and 128-bit key of each document's set, null for an empty one."""

    def emit(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            both = np.zeros((2, batch.num_rows), np.int64)
            for row, s in _sets(batch.column(2), n):
                size[row] = len(s)
                both[0, row] = core.mix(s).sum(dtype=U).view(np.int64)
                both[1, row] = core.mix(s * core.STEP + U(1)).sum(dtype=U).view(np.int64)
            empty = size == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), *(pa.array(k, mask=empty) for k in both)],
                                             ["doc_id", "id", "n_shingles", "k1", "k2"])

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(emit, "doc_id long, id long, n_shingles long, k1 long, k2 long")


def signatures(documents: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sig, id) of every document with words. There are about half as many as words, so they are made
    from the text wherever they are read and never written."""

    def emit(batches):
        bands = Bands(num, den)
        for batch in batches:
            ids, found, rows, held = batch.column(0).to_numpy(), [], [], 0
            for row, s in _sets(batch.column(1), n):
                edges = bands.edges(1 << max(len(s), 2).bit_length())
                band = int(np.searchsorted(edges, len(s), "right")) - 1
                for j in (band, band + 1):
                    top = int(edges[j + 1]) - 1
                    sig = _signatures(s, bands.difference(top, top), j, int(edges[max(j - 1, 0)]))
                    found.append(sig)
                    rows.append(np.full(len(sig), ids[row]))
                    held += len(sig)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(rows))], ["sig", "id"])
                    found, rows, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(rows))], ["sig", "id"])

    return _plain(documents).mapInArrow(emit, "sig long, id long")


def shingle_sets(documents: DataFrame, n: int) -> DataFrame:
    """(id, shingles) with the whole set as an array."""

    def emit(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, s in _sets(batch.column(1), n):
                yield pa.RecordBatch.from_arrays([ids.slice(row, 1), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["id", "shingles"])

    return _plain(documents).mapInArrow(emit, "id long, shingles array<long>")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): the smallest label that links (a, b) reach from each node. Labels move along links and jump to their label's label."""
    edges = links.select("a", "b").union(links.select("b", "a"))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        stepped = pin(labels.join(near, "id", "left").select("id", "comp", F.least("comp", F.coalesce("other", "comp")).alias("next")))
        if stepped.where("comp <> next").isEmpty():
            return stepped.select("id", "comp")
        jump = stepped.select(F.col("id").alias("next"), F.col("next").alias("root"))
        labels = stepped.join(jump, "next", "left").select("id", F.least("next", F.coalesce("root", "next")).alias("comp"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b").withColumn("both", both)
            .where(den * F.col("both") >= num * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b"))


def _tokens(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(s, id, set, size, own, pos): the shingles that a linked pair must share one of: those among the rarest of each set, at their place.

    A set with more shingles of its own than a link allows has no partner. Of the others, the first places up to that number and one more, by
    rarity among them, hold a shingle that any partner has within its own first places.
    """
    def counted(some: DataFrame) -> DataFrame:
        return some.select("set", F.explode("shingles").alias("s"))

    single = counted(sets).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("set").alias("set")).where("n = 1")
    own = single.groupBy("set").agg(F.count(F.lit(1)).alias("own"))
    alive = pin(sets.join(own, "set", "left").select("id", "set", "size", "shingles", F.coalesce("own", F.lit(0)).alias("own"))
                .where(den * F.col("own") <= (den - num) * F.col("size")))
    often = counted(alive).groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = counted(alive).join(often, "s").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("shared"))
    lone = F.col("size") - F.size("shared")  # these come first in the order, and are in no other set
    places = (F.floor((den - num) * F.col("size") / F.lit(den)) + 1 - lone).cast("int")
    first = shared.join(alive.select("id", "set", "size", "own"), "set").where(places > 0)
    return pin(first.select("id", "set", "size", "own", lone.alias("lone"), F.posexplode(F.slice("shared", 1, places)).alias("at", "e"))
               .select(F.col("e.s").alias("s"), "id", "set", "size", "own", (F.col("lone") + F.col("at")).alias("pos")))


def _heads(turn: int) -> Column:
    """Rows that the rest of their group is compared with in this turn: all of a small group, about ``HEADS`` of a large one."""
    return F.pmod(F.xxhash64("set", "s", F.lit(turn)), "rows") < HEADS


def linked(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents."""
    known = pin(keys(documents, n))
    classes = known.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("class"), F.min("n_shingles").alias("n"))
    chosen = classes.select(F.col("class").alias("id"), "n").groupBy("id").agg(F.max("n").alias("most"), F.min("n").alias("least"))
    sigs = signatures(documents, n, num, den)
    shared = sigs.groupBy("sig").count().where("count > 1").select("sig")
    members = sigs.join(shared, "sig").join(chosen, "id").distinct()
    nodes = pin(members.groupBy("id").agg(F.collect_set("sig").alias("sigs"), F.first("most").alias("most"), F.first("least").alias("least")))
    members = nodes.select(F.explode("sigs").alias("sig"), "id", "most", "least")
    candidates = documents.select("doc_id", "text").withColumn(ROW, row_id()).join(nodes.select(F.col("id").alias(ROW)), ROW, "left_semi")
    sets = pin(shingle_sets(candidates, n).distinct().select("id", "shingles", F.xxhash64("id", "shingles").alias("set"), F.size("shingles").alias("size")))
    tokens = _tokens(sets, num, den)
    labels, links, tried, turn = nodes.select("id", F.col("id").alias("comp")), None, None, 0
    while True:
        rows = tokens.join(labels, "id")
        groups = rows.groupBy("s").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        rows = pin(rows.join(groups.select("s", "rows"), "s"))
        if rows.isEmpty():
            break
        if turn == 0:
            heads = rows.groupBy("s").agg(F.min_by(F.struct("id", "comp", "set", "size", "pos"), F.struct("own", "set")).alias("h")).select("s", "h.*")
        else:
            heads = rows.where(_heads(turn)).select("s", "id", "comp", "set", "size", "pos")
        heads = heads.select("s", *[F.col(c).alias(f"h_{c}") for c in ("id", "comp", "set", "size", "pos")])
        # in the order of tokens nothing before the first common one is common, so |x - y| is at least its place in x, and the sizes fix |y - x|
        differ = F.greatest(F.col("pos") + F.col("h_pos"), 2 * F.col("pos") + F.col("h_size") - F.col("size"), 2 * F.col("h_pos") + F.col("size") - F.col("h_size"))
        fits = ((F.col("comp") != F.col("h_comp")) & (den * F.col("size") >= num * F.col("h_size")) & (den * F.col("h_size") >= num * F.col("size"))
                & ((den + num) * differ <= (den - num) * (F.col("size") + F.col("h_size"))))
        pairs = (rows.join(heads, "s").where(fits)
                 .select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b")).distinct())
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        left, right = nodes.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), nodes.select(F.col("id").alias("b"), F.col("sigs").alias("sb"))
        pairs = pin(pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("sa", "sb")).select("a", "b"))
        found = pin(_verified(pairs, sets, num, den))
        tried = pairs if tried is None else tried.union(pairs)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(labels, links)
        if turn:
            tokens = pin(rows.where(~_heads(turn)).drop("comp", "rows"))
        turn += 1
    named = classes.join(labels.withColumnRenamed("id", "class"), "class", "left").select("k1", "k2", F.coalesce("comp", "class").alias("component_id"))
    return known.join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of documents that name their group: one of each group of linked texts, in their own columns."""
    groups = linked(documents, n, num, den).where("doc_id = component_id OR doc_id IS NULL").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(ROW)).distinct()
    plain, doc, _ = positional(documents)
    return plain.withColumn(ROW, row_id(doc)).join(groups, ROW, "left_semi").drop(ROW).toDF(*documents.columns)
