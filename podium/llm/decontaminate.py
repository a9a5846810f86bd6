"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are compared without ASCII case and punctuation. An n-gram of a test item is a seed if fewer than ``rare`` occurrences
of it are expected in the corpus from the corpus counts of its words; a leaked passage in many documents
therefore stays a seed. An item without a rare n-gram uses all of its n-grams, one shorter than n words is a single seed.
Each occurrence of a seed proposes the stretch of the document around it that the item would cover; overlapping
stretches merge, and the best local alignment of words (match 2, mismatch and gap -1) against the whole item decides:
its score divided by twice the item's words must reach ``threshold``.

The items are the small side: they are taken in blocks of at most ``BLOCK_WORDS`` words, each block sent to all tasks and followed
by one pass over the documents, which are neither shuffled nor sorted. A larger benchmark takes more passes, never a larger task.

Defined results: null and empty texts and items without words match nothing; repeated rows and repeated items report each on their own;
ties between alignments go to the earliest end; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .tables import texts

N = 3
RARE = 1.0
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long"

PLAIN = core.LOWER.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        PLAIN[_c] = 0x20


def _words(column: pa.Array):
    for first, end, data, offsets in core.chunks(column):
        data = PLAIN[data]
        words = core.Words(data, offsets)
        yield first, end, words, core.spans(core.running(data), words.starts, words.ends)


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word sequences, and where it begins and ends in the text."""
    n = len(text)
    steps = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(text == word, 2, -1)
        up = row[1:] - 1
        value = np.zeros(n + 1, np.int64)
        value[1:] = np.maximum(0, np.maximum(diagonal, up))
        start = steps.copy()
        start[1:] = np.where(value[1:] == 0, steps[1:], np.where(value[1:] == diagonal, begin[:-1], begin[1:]))
        along = value + steps  # a gap costs one a word: the best cell to the left, less its distance
        top = np.maximum.accumulate(along)
        leader = np.maximum.accumulate(np.where(along == top, steps, 0))
        better = top - steps > value
        start = np.where(better, start[leader], start)
        row, begin = np.maximum(value, top - steps), start
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best


class Probe:
    """A block of items with its seeds, sent to the tasks."""

    def __init__(self, ids: list[int], items: list[np.ndarray], seeds: dict[int, list[tuple[int, int, int]]], threshold: float):
        self.ids, self.items, self.threshold, self.tables = ids, items, threshold, {}
        for k, found in seeds.items():
            found.sort()
            hashes = np.array([f[0] for f in found], core.U)
            self.tables[k] = (*np.unique(hashes, return_index=True), hashes, np.array([f[1:] for f in found], np.int64))

    def hits(self, words: core.Words, hashes: np.ndarray):
        """(document in the chunk, item, score, first word, end word) of the aligned passages."""
        rows = []
        for k, (keys, at, hashes_of, places) in self.tables.items():
            where = core.whole(words, k)
            grams = core.shingles(hashes, k)[where] if len(where) else np.zeros(0, core.U)
            spot = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == grams)
            ends = np.append(at[1:], len(hashes_of))
            first, times = at[spot[hit]], (ends - at)[spot[hit]]
            each = np.repeat(np.arange(len(hit)), times)
            which = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + first[each]
            rows.append((where[hit][each], places[which]))
        if not rows:
            return
        position = np.concatenate([r[0] for r in rows])
        place = np.concatenate([r[1] for r in rows])
        if not len(position):
            return
        item, offset = place[:, 0], place[:, 1]
        length = np.array([len(x) for x in self.items])[item]
        doc = words.doc[position]
        slack = np.maximum(4, length // 4)
        lo = np.maximum(position - offset - slack, words.first[doc])
        hi = np.minimum(position - offset + length + slack, words.first[doc + 1])
        order = np.lexsort((lo, item, doc))
        done = None
        for i in order.tolist():
            key = (int(doc[i]), int(item[i]))
            if done and done[0] == key and lo[i] <= done[2]:
                done = (key, done[1], max(done[2], int(hi[i])))
                continue
            if done:
                yield from self._scored(done, words, hashes)
            done = (key, int(lo[i]), int(hi[i]))
        if done:
            yield from self._scored(done, words, hashes)

    def _scored(self, stretch, words, hashes):
        (doc, item), lo, hi = stretch
        goal = self.items[item]
        if hi - lo < len(goal) * self.threshold:
            return
        score, start, end = align(hashes[lo:hi], goal)
        share = score / (2 * len(goal))
        if share >= self.threshold:
            base = lo - int(words.first[doc])
            yield doc, item, share, base + start, base + end


def _counts(documents: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Corpus counts of the words of a block, and of all words."""

    def count(batches):
        seen, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, _, words, hashes in _words(batch.column(0)):
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                seen += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
                total += len(words.starts)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], total))], ["word", "n"])

    rows = texts(documents).select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(len(vocabulary), np.int64), 0
    for r in rows:
        if r["word"] < 0:
            total = r["n"]
        else:
            counts[r["word"]] = r["n"]
    return counts, total


def probes(documents: DataFrame, benchmark: DataFrame, n: int = N, rare: float = RARE, threshold: float = THRESHOLD):
    """One probe for each block of items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // (4 * BLOCK_WORDS)) + 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == block).orderBy("doc_id", "text").collect()
        column = pa.array([r["text"] for r in rows], pa.string())
        ids, goals = [], []
        for first, end, words, hashes in _words(column):
            for i in range(end - first):
                if words.counts[i]:
                    ids.append(rows[first + i]["doc_id"])
                    goals.append(hashes[words.first[i]:words.first[i + 1]].copy())
        if not goals:
            continue
        vocabulary = np.unique(np.concatenate(goals))
        counts, total = _counts(documents, vocabulary)
        seeds: dict[int, list] = {}
        for item, goal in enumerate(goals):
            k = min(n, len(goal))
            grams = core.shingles(goal, k)
            chance = np.maximum(counts[np.searchsorted(vocabulary, goal)], 1) / max(total, 1)
            expected = float(max(total, 1)) * np.prod([chance[j:j + len(grams)] for j in range(k)], axis=0)
            chosen = np.flatnonzero(expected < rare)
            for j in chosen if len(chosen) else range(len(grams)):
                seeds.setdefault(k, []).append((int(grams[j]), item, int(j)))
        yield Probe(ids, goals, seeds, threshold)


def contaminated(documents: DataFrame, benchmark: DataFrame, n: int = N, rare: float = RARE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every passage that aligns with an item."""
    plain = texts(documents)
    out = documents.sparkSession.createDataFrame([], SCHEMA)
    for probe in probes(documents, benchmark, n, rare, threshold):
        def find(batches, probe=probe):
            for batch in batches:
                ids = batch.column(0)
                found = [(ids[first + doc].as_py(), probe.ids[item], round(share, 9), lo, hi)
                         for first, _, words, hashes in _words(batch.column(1)) for doc, item, share, lo, hi in probe.hits(words, hashes)]
                columns = list(zip(*found)) if found else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "score", "first_word", "end_word"])
        out = out.unionByName(plain.mapInArrow(find, SCHEMA))
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame, n: int = N, rare: float = RARE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that align with no item; decided in the row, so no text moves."""
    at = documents.columns.index("text")
    for probe in probes(documents, benchmark, n, rare, threshold):
        def keep(batches, probe=probe):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                column = batch.column(at)
                for first, _, words, hashes in _words(column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())):
                    for doc, *_ in probe.hits(words, hashes):
                        clean[first + doc] = False
                yield batch.filter(pa.array(clean))
        documents = documents.mapInArrow(keep, documents.schema)
    return documents
