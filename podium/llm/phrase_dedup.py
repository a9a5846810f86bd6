"""Substring dedup by repeated-phrase automata, sharded so that a document visits only the shards of phrases it may hold.

A phrase is a window of ``window`` words. The seed of a window is the least-hashed run of ``SEED`` words in it, so equal windows have
equal seeds, and neighbouring windows mostly share one.

* Seeds are counted, with map-side combining and once a document; only seeds that occur twice can belong to a recurring phrase.
* Documents meet the list of their recurring seeds and give up, for each, the *segment* of words that its windows span. Segments go to the
  shard of their seed, packed by task. A seed in more than ``hot`` documents is spread over shards by window instead, so that no shard
  holds all surroundings of a very common run of words.
* A task sends each distinct segment once a stretch of documents, with the least and largest doc_id, and keeps the occurrences apart, so copies of
  a hot segment do not meet in its shard.
* A shard confirms the phrases that different segments share, compiles them into an Aho-Corasick automaton over its words and streams every
  distinct segment through it. Matches compare whole words, not hashes. The windows found are joined to the occurrences by a 96-bit digest of the
  segment, a join that adaptive execution can split at a hot one.
* The windows of a document merge into covered words. Untouched and wholly covered texts need no second look at their words.

The number of shards follows the bytes of text, so a shard's automaton has a size that does not grow with the corpus.
Defined results: null and blank texts have no words; fewer words than a window: nothing is removed; rows of one doc_id never remove each other's
words; a null doc_id counts as the least; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .suffix_dedup import PLACE, _least
from .tables import bytes_of, pin

WINDOW, SEED = 13, 5
HOT = 50_000
SHARD_BYTES = 4 << 20
FLUSH_BYTES = 8 << 20
LONG = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]+")
U = core.U


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.hash(text).alias("sum"), text.alias("text"))


def _seeds(data: np.ndarray, offsets: np.ndarray, window: int):
    """Words and, for each seed in order: its hash, document, word, and first and last window it stands for (words of the chunk)."""
    words = core.Words(data, offsets)
    hashes = core.spans(core.running(data), words.starts, words.ends)
    if len(hashes) < window:
        return words, None
    grams = core.shingles(hashes, SEED)
    marked = (grams & ~PLACE) | np.arange(len(grams), dtype=U)
    at = (_least(marked, window - SEED + 1) & PLACE).astype(np.int64)
    starts = core.whole(words, window)
    if not len(starts):
        return words, None
    seed = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    return words, (grams[seed[new]], words.doc[first], seed[new], first, last)


def _recurring(rows: DataFrame, window: int, hot: int) -> DataFrame:
    """(doc, sum, seeds, hots): for each row its seeds that occur in two rows, and whether each is hot."""

    def emit(batches):
        for batch in batches:
            for first, end, data, offsets in core.chunks(batch.column(2)):
                _, got = _seeds(data, offsets, window)
                if got is None:
                    continue
                order = np.lexsort((got[0], got[1]))
                seed, doc = got[0][order], got[1][order]
                keep = np.append(True, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]))
                seed, doc = seed[keep], doc[keep]
                edges = np.searchsorted(doc, np.arange(end - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(seed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in (0, 1)), lists], ["doc", "sum", "seeds"])

    # found again for the count and the join: written, all seeds would take three quarters of the input on disk
    seeds = rows.mapInArrow(emit, "doc long, sum int, seeds array<long>").select("doc", "sum", F.explode("seeds").alias("seed"))
    often = seeds.groupBy("seed").count().where("count > 1").select("seed", (F.col("count") > hot).alias("hot"))
    return (seeds.join(often, "seed").groupBy("doc", "sum")
            .agg(F.collect_set(F.struct("seed", "hot")).alias("found")).select("doc", "sum", F.col("found.seed").alias("seeds"), F.col("found.hot").alias("hots")))


def _pack(least: dict[bytes, list[int]]) -> bytes:
    """Distinct segments, each with the least and the largest document it was seen in."""
    head = np.array(list(least.values()), np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(least)) + head + b"\n".join(least))


def _unpack(blob: bytes, least: dict[bytes, list[int]]) -> None:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", data)[0]
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2).tolist()
    for text, (low, high) in zip(data[8 + 16 * n:].split(b"\n"), head):
        _see(least, text, low, high)


def _see(least: dict[bytes, list[int]], text: bytes, low: int, high: int) -> bool:
    """Whether the segment is new."""
    known = least.get(text)
    if known is None:
        least[text] = [low, high]
        return True
    known[0], known[1] = min(known[0], low), max(known[1], high)
    return False


def _key(text: bytes) -> tuple[int, int]:
    """96 bits that name a segment."""
    return struct.unpack("<qi", hashlib.blake2b(text, digest_size=12).digest())


def _locate(least: dict[bytes, list[int]], window: int):
    """(key, tail, least, windows, runs) of each distinct segment that loses words anywhere: documents above ``least`` lose all its windows, the
    least one those of ``runs``, whose phrases start in a document of smaller id.

    A segment that recurs as a whole needs no search beyond its own first document. Phrases that different segments share go into the
    automaton, over numbers of the shard's vocabulary."""
    vocabulary: dict[bytes, int] = {}
    coded = {text: tuple(vocabulary.setdefault(w, len(vocabulary)) for w in text.split(b" ")) for text in least}
    phrases: dict[tuple, int] = {}
    shared: set[tuple] = set()
    for text, words in coded.items():
        doc = least[text][0]
        for k in range(len(words) - window + 1):
            phrase = words[k:k + window]
            before = phrases.setdefault(phrase, doc)
            if before != doc:
                shared.add(phrase)
                if doc < before:
                    phrases[phrase] = doc
    machine = None
    if shared:
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase in shared:
            machine.add_word(phrase, phrases[phrase])
        machine.make_automaton()
    for text, words in coded.items():
        low, high = least[text]
        runs: list[list[int]] = []
        for end, first in machine.iter(words) if machine else ():
            if first < low:
                k = end - window + 1
                if runs and runs[-1][1] == k - 1:
                    runs[-1][1] = k
                else:
                    runs.append([k, k])
        if runs or low < high:
            yield *_key(text), low, len(words) - window + 1, [{"first": x, "last": y} for x, y in runs]


RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
CUT = pa.schema([("shard", pa.int64()), ("pack", pa.binary()), ("key", pa.int64()), ("tail", pa.int32()), ("doc", pa.int64()), ("sum", pa.int32()), ("place", pa.int32())])


def segments(documents: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Rows of two kinds: (shard, pack) with the segments of a stretch of documents, each once, and (key, tail, doc, sum, place) of every occurrence."""
    rows = _rows(documents)
    shards = bytes_of(documents) // SHARD_BYTES + 8
    squeezed = rows.mapInArrow(_squeeze, "doc long, sum int, text binary")
    marked = squeezed.join(_recurring(rows, window, hot), ["doc", "sum"])

    def cut(batches):
        packs: dict[int, dict[bytes, list[int]]] = {}
        places: list[tuple[int, int, int, int, int]] = []
        held = 0
        wring = zstandard.ZstdDecompressor()

        def batch_of(n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in CUT], schema=CUT)

        def flush():
            yield batch_of(len(packs), shard=list(packs), pack=[_pack(x) for x in packs.values()])
            yield batch_of(len(places), **dict(zip(("key", "tail", "doc", "sum", "place"), zip(*places))))
            packs.clear()
            places.clear()

        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):  # texts are opened a few at a time
            docs, sums = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = pa.array([wring.decompress(t.as_py()) for t in batch.column(2)], pa.binary())
            for first, end, data, offsets in core.chunks(texts):
                words, got = _seeds(data, offsets, window)
                if got is None:
                    continue
                seed, doc, _, lo, hi = got
                mine = batch.column(3).slice(first, end - first)
                size = np.asarray(mine.value_lengths())
                known = np.stack([np.repeat(np.arange(end - first), size).astype(U), mine.flatten().to_numpy().view(U)])
                hots = batch.column(4).slice(first, end - first).flatten().to_numpy(zero_copy_only=False)
                key = core.mix(known[1] + core.mix(known[0]))  # seed and document in one number
                order = np.argsort(key)
                wanted = core.mix(seed + core.mix(doc.astype(U)))
                spot = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
                hit = key[order][spot] == wanted
                is_hot, text = hots[order][spot], data.tobytes()
                starts, ends = words.starts, words.ends
                apart = np.append(starts[1:] - ends[:-1] != 1, False)
                apart[:-1] |= data[ends[:-1]] != 0x20
                odd = np.append(0, np.cumsum(apart))  # gaps between words that are not one space
                for k in np.flatnonzero(hit).tolist():
                    a, b = int(lo[k]), int(hi[k]) + window
                    row = int(doc[k])
                    base = int(words.first[row])
                    for a, b in [(x, x + window) for x in range(a, b - window + 1)] if is_hot[k] else [(a, b)]:
                        piece = text[starts[a]:ends[b - 1]]
                        if odd[b - 1] != odd[a]:
                            piece = b" ".join(piece.split())
                        name = _key(piece)
                        shard = (name[0] if is_hot[k] else int(seed[k])) % shards
                        places.append((*name, docs[first + row], sums[first + row], a - base))
                        new = _see(packs.setdefault(shard, {}), piece, docs[first + row], docs[first + row])
                        held += 300 + (len(piece) + 200 if new else 0)  # Python's own sizes
                if held > FLUSH_BYTES:
                    yield from flush()
                    held = 0
        if places:
            yield from flush()

    return marked.mapInArrow(cut, "shard long, pack binary, key long, tail int, doc long, sum int, place int")


def occurrences(documents: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc, sum, first, last): runs of windows whose phrases start in documents of smaller id, by their first words."""

    def locate(key, table):
        least: dict[bytes, list[int]] = {}
        for blob in table.column("pack"):
            _unpack(blob.as_py(), least)
        found = list(_locate(least, window))
        columns = list(zip(*found)) if found else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), RUNS))], ["key", "tail", "least", "windows", "runs"])

    cut = pin(segments(documents, window, hot))
    found = (cut.where("pack IS NOT NULL").select("shard", "pack").groupBy("shard")
             .applyInArrow(locate, "key long, tail int, least long, windows int, runs array<struct<first: int, last: int>>"))
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last")))
    return (cut.where("pack IS NULL").select("key", "tail", "doc", "sum", "place").join(found, ["key", "tail"])  # few rows on the right; a hot key splits on the left
            .select("doc", "sum", "place", F.inline(F.when(F.col("doc") > F.col("least"), whole).otherwise(F.col("runs"))))
            .select("doc", "sum", (F.col("place") + F.col("first")).alias("first"), (F.col("place") + F.col("last")).alias("last")))


def _squeeze(batches):
    """Texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
        small = [press.compress(t.as_py().encode()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], ["doc", "sum", "text"])


def phrase_dedup(documents: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_sha256) of every row; ``removed`` lists the runs [start, end) of words removed, null if none."""

    def base(batches):
        for batch in batches:
            counts, sums = [], []
            for text in batch.column(2):  # one text at a time, a long one never as a list of its words
                text = text.as_py().encode()
                plain = b" ".join(text.split()) if len(text) < LONG else BLANK.sub(b" ", text).strip(b" ")
                counts.append(plain.count(b" ") + 1 if plain else 0)
                sums.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(sums, pa.string())],
                                             ["doc", "sum", "n_words", "sha256"])

    def merge(batches):
        for batch in batches:
            runs, gone = [], []
            for places in batch.column(2).to_pylist():
                at = np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in places]))
                new = np.append(True, at[1:] > at[:-1] + window)
                ends = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + window
                runs.append([{"start": a, "end": b} for a, b in zip(at[new].tolist(), ends.tolist())])
                gone.append(int((ends - at[new]).sum()))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, kind), pa.array(gone, pa.int64())], ["doc", "sum", "removed", "n_removed"])

    def cut(batches):
        wring = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(2), batch.column(3).to_pylist()):
                words, at, kept = wring.decompress(text.as_py()).split(), 0, []
                for run in runs:
                    kept += words[at:run["start"]]
                    at = run["end"]
                out.append(hashlib.sha256(b" ".join(kept + words[at:])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["doc", "sum", "cut_sha256"])

    rows = _rows(documents)
    found = pin(occurrences(documents, window, hot).groupBy("doc", "sum").agg(F.collect_set(F.struct("first", "last")).alias("places"))
                .mapInArrow(merge, "doc long, sum int, removed array<struct<start: int, end: int>>, n_removed long"))
    known = rows.mapInArrow(base, "doc long, sum int, n_words long, sha256 string")
    told = known.join(found, ["doc", "sum"], "left")
    part = (rows.mapInArrow(_squeeze, "doc long, sum int, text binary")
            .join(told.where("n_removed < n_words").select("doc", "sum", "removed").distinct(), ["doc", "sum"])
            .mapInArrow(cut, "doc long, sum int, cut_sha256 string").distinct())
    return (told.join(part, ["doc", "sum"], "left")
            .select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "removed",
                    F.when(F.col("removed").isNull(), F.col("sha256")).otherwise(F.coalesce("cut_sha256", F.sha2(F.lit(""), 256))).alias("kept_sha256")))


def digest(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    return phrase_dedup(documents, window).drop("removed")
