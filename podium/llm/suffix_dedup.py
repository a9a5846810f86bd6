"""Suffix-array dedup by bucket-pointer refinement, on sampled suffixes.

A repeated string of ``length`` bytes is found from the suffixes that start at *anchors*: in every run of ``length`` bytes, the place whose
``depth``-byte gram (depth is half the length) has the least hash. Equal strings have equal anchors, so it suffices to group the
suffixes of anchors, about one in a hundred places.

* Initial buckets: suffixes with one ``depth``-gram at the anchor. A bucket of one suffix is finished: nothing in it repeats.
* First refinement: within a bucket suffixes are grouped by the bucket identifiers (the gram hashes) at the later and earlier offsets that
  span every string the anchor stands for. Two suffixes that stay together repeat all of those strings.
* Last refinement, only of suffixes left alone in a bucket that others share: each string from p is grouped by the
  identifiers at p and p + depth, which are those of the previous level. What stays together repeats.

Identifiers are 64-bit hashes and each level keeps its bucket, so a false repeat needs two equal hashes at once. Every grouping is a Spark aggregation
with map-side combining and a join back that adaptive execution may split: a passage that a third of all documents hold is one row a task.
Text is read once for the anchors; only documents that share a bucket and are not wholly covered are brought together with their places, once.

Defined results: null is empty text; texts shorter than ``length`` bytes lose nothing; rows are judged one by one, so a repeated row counts as
another occurrence; removed runs that touch are one span; cuts may fall inside a character, so kept text is binary; a null doc_id is allowed; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .tables import pin

LENGTH = 400
U = core.U
PLACE = U((1 << 31) - 1)


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, the sum that tells rows of one id apart, and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.hash(text).alias("sum"), text.alias("text"))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, from block minima in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def _identifiers(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifier of the gram at each place."""
    sums = core.running(data)
    _, inverse = core.powers(len(sums))
    n = len(data) - depth + 1
    return core.mix((sums[depth:] - sums[:n]) * inverse[:n])


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(identifiers, document, anchor, first and last start of the strings it stands for), places in the chunk."""
    depth = length // 2
    if len(data) < length:
        return None
    names = _identifiers(data, depth)
    width = length - depth + 1
    marked = (names & ~PLACE) | np.arange(len(names), dtype=U)
    anchor = (_least(marked, width) & PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    inside = np.arange(len(anchor)) + length <= offsets[doc + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return names, doc[first], anchor[first], first, last


def anchors(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, sum, at, lo, hi, bucket, hull): anchors with the first and last start of their strings (relative to the anchor)."""
    depth = length // 2

    def emit(batches):
        for batch in batches:
            for first, _, data, offsets in core.chunks(batch.column(2)):
                got = _anchors(data, offsets, length)
                if got is None:
                    continue
                names, doc, at, lo, hi = got
                hull = names[lo]
                for part in (names[lo + depth], names[hi + depth], (at - lo).astype(U) * U(1 << 20) + (hi - at).astype(U)):
                    hull = core.mix(hull * core.STEP + part)
                row = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array((at - offsets[doc]).astype(np.int32)), pa.array((lo - at).astype(np.int16)),
                     pa.array((hi - at).astype(np.int16)), pa.array(names[at].view(np.int64)), pa.array(hull.view(np.int64))],
                    ["doc", "sum", "at", "lo", "hi", "bucket", "hull"])

    return _rows(documents).mapInArrow(emit, "doc long, sum int, at int, lo short, hi short, bucket long, hull long")


def repeats(documents: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(doc, sum, spans, n_removed) of the documents with repeated strings, and the texts of those that are not wholly covered.

    ``spans`` are the maximal runs [start, end) of covered bytes."""
    depth = length // 2
    found = pin(anchors(documents, length))
    place = F.struct("doc", "sum", "at")
    classes = found.groupBy("bucket", "hull").agg(F.count("*").alias("n"), F.min(place).alias("head"))
    buckets = classes.groupBy("bucket").agg(F.sum("n").alias("all"), F.min("n").alias("fewest")).where("all > 1")
    shared = classes.join(buckets, "bucket").select("bucket", "hull", "n", "head", (F.col("fewest") == 1).alias("mixed"))
    # 1: all strings repeat; 0: to be refined; 2: repeats, and stands for its class in the refinement of others
    state = F.when(F.col("n") == 1, 0).when(F.col("mixed") & (F.col("head") == place), 2).otherwise(1)
    live = pin(found.join(shared, ["bucket", "hull"]).select("doc", "sum", "at", "lo", "hi", "bucket", state.cast("byte").alias("state")))
    todo = live.where("state <> 1").groupBy("doc", "sum").agg(F.collect_list(F.struct("at", "lo", "hi", "bucket", "state")).alias("todo"))
    texts = pin(_rows(documents).join(live.select("doc", "sum").distinct(), ["doc", "sum"], "left_semi").join(todo, ["doc", "sum"], "left"))

    def strings(batches):
        for batch in batches:
            docs, sums, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            made, held = [], 0
            for i, todo in enumerate(lists):
                if todo:
                    names = _identifiers(np.frombuffer(batch.column(2)[i].as_py().encode(), np.uint8), depth)
                    n = np.array([x["hi"] - x["lo"] + 1 for x in todo])
                    begin = np.array([x["at"] + x["lo"] for x in todo])
                    p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
                    bucket, open_ = np.array([x["bucket"] for x in todo]), np.array([x["state"] == 0 for x in todo])
                    made.append((np.full(len(p), docs[i]), np.full(len(p), sums[i], np.int32), p.astype(np.int32), np.repeat(bucket, n),
                                 core.mix(names[p] * core.STEP + names[p + depth]).view(np.int64), np.repeat(open_, n)))
                    held += len(p)
                if made and (held > 200_000 or i == len(lists) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], ["doc", "sum", "p", "bucket", "own", "open"])
                    made, held = [], 0

    # made twice rather than written: the rows outweigh the texts they come from
    each = texts.where("todo IS NOT NULL").mapInArrow(strings, "doc long, sum int, p int, bucket long, own long, open boolean")
    twice = each.groupBy("bucket", "own").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    single = each.where("open").join(twice, ["bucket", "own"]).select("doc", "sum", F.col("p").alias("start"), (F.col("p") + length).alias("end"))
    whole = live.where("state <> 0").select("doc", "sum", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + length).alias("end"))

    def merge(batches):
        for batch in batches:
            spans, removed = [], []
            for starts, ends in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                starts, ends = np.array(starts), np.array(ends)
                order = np.argsort(starts, kind="stable")
                starts, reach = starts[order], np.maximum.accumulate(ends[order])
                new = np.append(True, starts[1:] > reach[:-1])
                runs = list(zip(starts[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist()))
                spans.append([{"start": a, "end": b} for a, b in runs])
                removed.append(sum(b - a for a, b in runs))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(removed, pa.int64())], ["doc", "sum", "spans", "n_removed"])

    spans = (single.unionByName(whole).groupBy("doc", "sum").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
             .mapInArrow(merge, "doc long, sum int, spans array<struct<start: int, end: int>>, n_removed long"))
    return spans, texts.select("doc", "sum", "text")


def suffix_dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256) of every row; spans are null where nothing repeats.

    Untouched and wholly covered texts need no join with their bytes: the hash of the one is known from the scan, that of the other is fixed."""
    spans, texts = repeats(documents, length)
    spans = pin(spans)

    def cut(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(2), batch.column(3).to_pylist()):
                data, at, h = text.as_py().encode(), 0, hashlib.sha256()
                for run in runs:
                    h.update(data[at:run["start"]])
                    at = run["end"]
                h.update(data[at:])
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["doc", "sum", "cut_sha256"])

    base = _rows(documents).select("doc", "sum", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    part = (texts.join(spans, ["doc", "sum"]).where(F.octet_length("text") > F.col("n_removed")).select("doc", "sum", "text", "spans")
            .mapInArrow(cut, "doc long, sum int, cut_sha256 string").distinct())
    told = spans.select("doc", "sum", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans").join(part, ["doc", "sum"], "left")
    return (base.join(told, ["doc", "sum"], "left")
            .select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), "spans",
                    F.when(F.col("n_spans").isNull(), F.col("sha256")).otherwise(F.coalesce("cut_sha256", F.sha2(F.lit(""), 256))).alias("kept_sha256")))


def digest(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    return suffix_dedup(documents, length).drop("spans")
