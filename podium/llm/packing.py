"""Best-fit packing by bin completion on the histogram of lengths.

Texts are turned into token ids where they lie; a document longer than a sequence is cut into whole sequences, its
first piece taking the remainder. Pieces of one length are interchangeable, so the packing is found for
the histogram of lengths, which has at most ``size`` cells whatever the corpus is: bin completion takes the largest
length left, enumerates the undominated fillings of the room beside it, best fit first, and goes back
while a bound on the waste still allows fewer sequences than the incumbent, which is best-fit decreasing at
first. A filling is applied as often as the counts allow, so the plan stays a few thousand rows.

Pieces are then numbered within their length (in buckets, with running sums over bucket counts) and look their
place up in that plan, which is broadcast because its size is bounded by ``size``.

Defined results: a null text is empty and becomes the end mark alone; repeated rows are packed each on their own; ties are
broken by doc_id, piece and checksum; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pin, texts

SIZE = 2048
END = b"\0\0\0\0"
#: fillings tried around one length, and steps of the search
WIDTH, NODES = 6, 20_000
BUCKET_ROWS = 50_000
#: a run of white space that may outgrow the stack of the pattern's look-ahead; a text is cut around it
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")
#: public_tokenizers.PATTERN without steps back: white space at the end of a text is one match of any length
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Encoder:
    """Ids of a text as unsigned little-endian 32-bit numbers.

    A text is encoded whole: so many words are rare that looking each one up and keeping it takes longer."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if len(text) >= 100_000 and RUN.search(text):
            return b"".join(map(self._ids, self._parts(text)))
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        return np.asarray(array("I", self.encode(text)), "<u4").tobytes()

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """Text cut before and after long runs of white space; the last character of a run goes with the word after it."""
        at = 0
        for run in RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            yield text[at:run.start()]
            yield text[run.start():end]
            at = end
        yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


def default_ranks() -> str:
    """The byte-level BPE vocabulary as ranks; ids equal those of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(documents: DataFrame, size: int = SIZE, ranks: str | None = None) -> DataFrame:
    def cut(batches):
        code = encoder(ranks or default_ranks())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = code.ids(text.as_py() or "") + END
                n = len(data) // 4
                ends = list(range(n % size or size, n + 1, size)) if n > size else [n]
                start = 0
                for k, end in enumerate(ends):
                    rows.append((doc, k, start, end - start, zlib.crc32(data[4 * start:4 * end])))
                    start = end
            columns = zip(*rows) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(documents).mapInArrow(cut, PIECES)


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths, times). Equal sequences are filled together."""
    left, plan = counts.copy(), []
    for top in range(size, 0, -1):
        while left[top]:
            fill, room = [top], size - top
            left[top] -= 1
            while room:
                fits = np.flatnonzero(left[:room + 1])
                if not len(fits):
                    break
                fill.append(int(fits[-1]))
                left[fits[-1]] -= 1
                room -= fill[-1]
            left_of = {x: fill.count(x) for x in fill}
            more = min(left[x] // k for x, k in left_of.items())
            for x, k in left_of.items():
                left[x] -= k * more
            plan.append((tuple(fill), int(1 + more)))
    return plan


def fillings(left: np.ndarray, room: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings of the room, least waste first and larger lengths first among equals.

    One length that fills the room dominates all else. Otherwise a filling is kept only if no available length
    fits into its waste, and no larger length could take the place of its last one."""
    if room <= 0:
        return [()]
    if left[room]:
        return [(room,)]
    have = np.flatnonzero(left[:room + 1])
    if not len(have):
        return [()]
    found: dict[tuple[int, ...], int] = {}

    def largest(limit: int, used: tuple[int, ...]) -> int:
        k = int(np.searchsorted(have, limit, "right")) - 1
        while k >= 0 and left[have[k]] <= used.count(int(have[k])):
            k -= 1
        return int(have[k]) if k >= 0 else 0

    def complete(used: tuple[int, ...], rest: int) -> None:
        while rest and (x := largest(rest, used)):
            used, rest = (*used, x), rest - x
        found[tuple(sorted(used, reverse=True))] = rest

    tops = have[::-1]
    # pairs that fill the room exactly, larger first; then greedy completions of each large first choice
    for a in tops[: 4 * width * width]:
        b = room - int(a)
        if b and left[b] > (1 if b == a else 0):
            found[tuple(sorted((int(a), b), reverse=True))] = 0
            if len(found) >= width:
                break
    if len(found) < width:
        for a in tops[: 4 * width]:
            complete((int(a),), room - int(a))
    return sorted(found, key=lambda f: (found[f], tuple(-x for x in f)))[:width]


def bin_completion(counts: np.ndarray, size: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """A plan with as few sequences as the search finds; never more than best-fit decreasing."""
    total = int((counts * np.arange(size + 1)).sum())
    least = -(-total // size)
    incumbent = best_fit(counts, size)
    best = sum(times for _, times in incumbent)
    left, path, waste, spent = counts.copy(), [], 0, 0
    stack: list[list[tuple[int, ...]]] = []
    while best > least and spent < nodes:
        spent += 1
        tops = np.flatnonzero(left)
        if not len(tops):
            made = sum(times for _, times in path)
            if made < best:
                best, incumbent = made, list(path)
        forward = len(tops) and waste <= (best - 1) * size - total
        if forward:
            top = int(tops[-1])
            left[top] -= 1
            choices = [(top, *f) for f in fillings(left, size - top)]
            left[top] += 1
            stack.append(choices[::-1])
        while stack:
            if not forward:  # take back what the choice on this level did
                fill, times = path.pop()
                for x in fill:
                    left[x] += times
                waste -= times * (size - sum(fill))
            if stack[-1]:
                fill = stack[-1].pop()
                need = {x: fill.count(x) for x in fill}
                times = int(min(left[x] // k for x, k in need.items()))
                room = size - sum(fill)
                if room:  # what wastes room is laid once at a time unless it must be
                    times = min(times, max(1, ((best - 1) * size - total - waste) // room))
                for x, k in need.items():
                    left[x] -= k * times
                waste += times * room
                path.append((fill, times))
                break
            stack.pop()
            forward = False
        if not stack:
            break
    return incumbent


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: where the run begins, pieces a sequence, first sequence, offset."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for fill, times in plan:
        at = 0
        for x in sorted(set(fill), reverse=True):
            k = fill.count(x)
            rows.append((x, seen.get(x, 0), k, sequence, at))
            seen[x] = seen.get(x, 0) + k * times
            at += k * x
        sequence += times
    rows.sort()
    names = ("length", "lo", "k", "sequence", "at")
    return {n: np.array(v, np.int64) for n, v in zip(names, zip(*rows) if rows else [[]] * 5)}


def pack(documents: DataFrame, size: int = SIZE, ranks: str | None = None) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut = pin(pieces(documents, size, ranks))
    lengths = cut.groupBy("length").count().collect()  # at most `size` rows
    counts = np.zeros(size + 1, np.int64)
    for r in lengths:
        counts[r["length"]] = r["count"]
    slots = _slots(bin_completion(counts, size))
    buckets = int(counts.sum() // BUCKET_ROWS) + 1
    marked = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = (marked.groupBy("length", "bucket").count()
            .selectExpr("length", "bucket", "sum(count) OVER (PARTITION BY length ORDER BY bucket) - count AS before"))
    ranked = (marked.selectExpr("*", "row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, piece, ids_crc32) - 1 AS place")
              .join(sums, ["length", "bucket"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "place + before AS rank"))

    def lay(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            order = np.searchsorted(slots["length"], length)  # runs of one length are together, by lo
            end = np.searchsorted(slots["length"], length, "right")
            step = np.ones(len(length), bool)
            while step.any():  # the last run that begins at or before the rank
                middle = (order + end) // 2
                step = end - order > 1
                right = step & (slots["lo"][np.minimum(middle, len(slots["lo"]) - 1)] <= rank)
                order, end = np.where(right, middle, order), np.where(step & ~right, middle, end)
            within = rank - slots["lo"][order]
            k = slots["k"][order]
            columns = [batch.column(i) for i in range(5)] + [pa.array(slots["sequence"][order] + within // k), pa.array(slots["at"][order] + within % k * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lay, PIECES + ", sequence_id long, offset long")
