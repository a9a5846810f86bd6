"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Words and word pairs of a text fall into ``2**BITS`` hashed classes. Two multinomials are counted, one over
trusted documents and one over the whole corpus; a document's score is the mean over its n-grams of
``log(p_trusted / p_raw)``, so length cancels out. Every document above one fixed threshold is kept: no draw is involved.

Every labelled document counts: those labelled good and not toxic are trusted, raw counts cover all documents. A fifth of the labelled
(doc_id divisible by ``HELD``) is held out of the trusted counts and places the threshold: the middle of the widest range of scores with the
best balanced accuracy. Labels meet documents in a join, so nothing of their number goes through the driver.

Defined results: null or wordless text has no words and fails the base rules; repeated rows are scored each on
their own; labels that are null or repeated collapse to the lowest quality and highest toxicity of a document (null rows
drop out); without trusted rows there is no ratio, every score is 0.0 and the base rules alone decide; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .tables import pin

BITS = 16
#: one labelled document in so many is left out of the counts and places the threshold
HELD = 5
#: bits of the map of labelled ids
SLOTS = 1 << 23
PSEUDO = 50.0
RANGE, STEPS = 8.0, 100
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _later_equal(keys: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Per document, how many keys equal an earlier one."""
    keys = core.mix(keys + docs.astype(core.U) * core.STEP)
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return np.bincount(docs[later], minlength=n)


def _base(data: np.ndarray, offsets: np.ndarray, words: core.Words, sums: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    line_end = data == 0x0A
    edges = np.union1d(np.flatnonzero(line_end) + 1, offsets)
    begins, ends = edges[:-1], edges[1:]
    ends = ends - line_end[ends - 1]
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    begins, ends = begins[has_word], ends[has_word]
    line_doc = np.searchsorted(offsets, begins, "right") - 1

    at = core.whole(words, 3)
    triples = core.mix(core.shingles(hashes, 3)[at] + words.doc[at].astype(core.U) * core.STEP) if len(at) else np.zeros(0, core.U)
    _, which, times = np.unique(triples, return_inverse=True, return_counts=True)
    repeated = core.covered(at[times[which] > 1] if len(at) else at, 3, len(words.starts))
    return {
        "n_words": words.counts,
        "word_chars": core.per_doc(~core.SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": core.per_doc(SYMBOLS[data], offsets),
        "n_dup_lines": _later_equal(core.spans(sums, begins, ends), line_doc, n),
        "n_repeat_words": core.per_doc(repeated, words.first),
    }


def _classes(words: core.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram classes and the document of each."""
    pairs = core.whole(words, 2)
    shift = core.U(64 - BITS)
    both = np.concatenate([hashes, core.shingles(hashes, 2)[pairs] if len(pairs) else np.zeros(0, core.U)])
    return (both >> shift).astype(np.int64), np.concatenate([words.doc, words.doc[pairs]])


def _walk(column: pa.Array):
    for first, end, data, offsets in core.chunks(column):
        words, sums = core.Words(data, offsets), core.running(data)
        yield first, end, data, offsets, words, sums, core.spans(sums, words.starts, words.ends)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good): every document labelled bad, or good and not toxic, once."""
    return pin(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
               .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
               .agg((F.min("quality") == 1).alias("good"), (F.max(F.coalesce(F.col("toxic"), F.lit(0))) > 0).alias("toxic"))
               .where("NOT (good AND toxic)").select("doc_id", "good"))


def train(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratios by class, and the threshold."""
    known = labelled(labels)
    size = 1 << BITS
    apart = F.pmod("doc_id", F.lit(HELD)) == 0

    def count(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, _, _, words, _, hashes in _walk(batch.column(0)):
                seen += np.bincount(_classes(words, hashes)[0], minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["class", "n"])

    def counted(texts: DataFrame) -> np.ndarray:
        out = np.zeros(size)
        for r in texts.select("text").mapInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most 2**BITS rows
            out[r["class"]] = r["n"]
        return out

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = counted(_marked(plain.where(~apart), known.where(F.col("good") & ~apart)))
    if not good.sum():
        return np.zeros(size), -np.inf
    raw = counted(plain)
    share = good.sum() / raw.sum()
    ratios = np.log((good + PSEUDO * share) / (raw + PSEUDO)) - np.log(share)
    return ratios, _threshold(plain.where(apart), ratios, known.where(apart))


def _marked(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents of marks(doc_id, good).

    Only texts whose id falls into a hashed slot of some mark are shuffled; the slots are a bitmap of fixed size, and the join decides.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    taken = marks.select(slot.alias("_slot")).groupBy(F.floor(F.col("_slot") / 64).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_slot % 64 AS INT))")).alias("_bits"))
    near = documents.withColumn("_slot", slot).withColumn("_word", F.floor(F.col("_slot") / 64)) \
        .join(F.broadcast(taken), "_word").where("_bits & shiftleft(1L, CAST(_slot % 64 AS INT)) <> 0")  # at most SLOTS / 64 rows
    return near.select("doc_id", "text").join(marks.hint("merge"), "doc_id")


def _threshold(documents: DataFrame, ratios: np.ndarray, held: DataFrame) -> float:
    """Middle of the best range of cuts on the held-out labels, from a histogram of fixed size."""
    scored = score(_marked(documents, held), ratios, -np.inf)
    cell = F.floor((F.least(F.greatest(F.col("score"), F.lit(-RANGE)), F.lit(RANGE)) + RANGE) * STEPS).cast("int")
    cells = scored.where("NOT base_failed").join(held.hint("merge"), "doc_id").groupBy(cell.alias("cell"), "good").count().collect()
    n = int(2 * RANGE * STEPS) + 1
    by = {True: np.zeros(n), False: np.zeros(n)}
    for r in cells:
        by[r["good"]][r["cell"]] += r["count"]
    if not by[True].sum() or not by[False].sum():
        return -np.inf
    below = {k: np.concatenate([[0], np.cumsum(v)]) / v.sum() for k, v in by.items()}
    gain = below[False] - below[True]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    run = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(run, key=len)
    return float(widest[0] + widest[-1]) / 2 / STEPS - RANGE


def score(documents: DataFrame, ratios: np.ndarray, threshold: float) -> DataFrame:
    """Base measures, score and verdict of every document (doc_id, measures, base_failed, score, kept)."""
    table = ratios.astype(np.float32)

    def rate(batches):
        for batch in batches:
            for first, end, data, offsets, words, sums, hashes in _walk(batch.column(1)):
                got = _base(data, offsets, words, sums, hashes)
                cls, doc = _classes(words, hashes)
                n = end - first
                total = np.bincount(doc, weights=table[cls], minlength=n)
                mean = np.round(total / np.maximum(np.bincount(doc, minlength=n), 1), 9)
                failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), *(pa.array(v.astype(np.int64)) for v in got.values()),
                     pa.array(failed), pa.array(mean), pa.array(~failed & (mean >= threshold))],
                    ["doc_id", *got, "base_failed", "score", "kept"])

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rate, f"doc_id long, {BASE_SCHEMA}, base_failed boolean, score double, kept boolean")


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, *train(documents, labels))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents whose text is kept, in their own columns.

    The verdict is a function of the text alone, so it is computed in the row and no text is shuffled."""
    ratios, threshold = train(documents, labels)
    table = ratios.astype(np.float32)
    names = documents.columns
    at = names.index("text")

    def rate(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, end, data, offsets, words, sums, hashes in _walk(batch.column(at)):
                got = _base(data, offsets, words, sums, hashes)
                cls, doc = _classes(words, hashes)
                n = end - first
                mean = np.round(np.bincount(doc, weights=table[cls], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1), 9)
                failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
                keep[first:end] = ~failed & (mean >= threshold)
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(rate, documents.schema)
