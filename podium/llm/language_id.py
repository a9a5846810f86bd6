"""Language ID: interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

Text becomes lower-case letters with one space for anything else. Spark counts the 4-grams of every labelled training text, with map-side
sums; lower orders follow from the distinct 4-grams, as Kneser-Ney's continuation counts need. A model keeps, under sorted 64-bit
hashes, the discounted share of each gram and the weight that its context leaves to the next shorter one. Every document is counted and
every gram kept. Up to ``GRAMS`` grams of all languages are one table in memory; more are cut into slices of about that many by the middle letters of a gram,
so that all that a gram needs lies in one slice (of orders 3 and 4) and one of orders 1 and 2. Slices are broadcast and opened one at a time.

A text goes to the language of lowest cross-entropy a character. ``score`` is that language's share under a softmax of the negative
cross-entropies; its temperature, and for each language the cross-entropy above which a prediction is rejected (``accepted`` is
false, ``lang_pred`` stays), are calibrated on all labelled training texts.

Only documents whose crc32 of the id as text is not divisible by 5 are learned from; language, source and id are no inputs of a prediction.
Defined results: null text or text without letters: ``und`` with score 0 and not accepted; with no labelled text at all
everything is ``und``; a null doc_id is never learned from and not held out; repeated rows count and are predicted each; ties go to the
language first in alphabetical order; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .tables import pin

ORDER = 4
#: grams in memory at a time; no bound on the model
GRAMS = 2_000_000
REJECTED = 0.001
TEMPERATURES = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)
CELLS, CELL = 400, 0.05
U = core.U
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean, cross_entropy double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a space; letters beyond the basic plane share one mark."""
    table = np.full(0x110000, 0x20, np.uint16)
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    table[0x10000:] = [0xFFFF if chr(c).isalpha() else 0x20 for c in range(0x10000, 0x110000)]
    return table


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (16 bits a letter) of a chunk and the text of each; three marks precede each text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum((data & 0xC0) != 0x80)
    at = np.concatenate([[0], ends])[offsets]
    letters = _letters()[points]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    keep = letters != 0x20
    keep[1:] |= (letters[1:] == 0x20) & (letters[:-1] != 0x20) & (doc[1:] == doc[:-1])
    letters, doc = letters[keep], doc[keep]
    n = np.bincount(doc, minlength=len(offsets) - 1)
    pad = ORDER - 1
    flat = np.zeros(len(letters) + pad * len(n), U)
    place = np.arange(len(letters)) + pad * (doc + 1)
    flat[place] = letters
    gram = flat[place]
    for k in range(1, ORDER):
        gram = gram | (flat[place - k] << U(16 * k))
    return gram, doc


def _learned(documents: DataFrame) -> DataFrame:
    """The rows learned from."""
    return documents.where("lang IS NOT NULL AND text IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)


def _counted(documents: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts learned from."""

    def count(batches):
        seen: dict[str, list] = {}

        def merged(lang):
            grams, n = map(np.concatenate, zip(*seen[lang]))
            codes, names = pd.factorize(grams)
            return names, np.bincount(codes, weights=n, minlength=len(names)).astype(np.int64)

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, end, data, offsets in core.chunks(batch.column(0)):
                grams, doc = _grams(data, offsets)
                mine, names = pd.factorize(np.array(langs[first:end], object))
                for k, lang in enumerate(names):
                    codes, unique = pd.factorize(grams[mine[doc] == k])
                    if len(unique):
                        seen.setdefault(lang, []).append((unique, np.bincount(codes)))
                        if len(seen[lang]) > 16:
                            seen[lang] = [merged(lang)]
        for lang in seen:
            names, n = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return (_learned(documents).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _discount(ones: int, twos: int, more: bool) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.75 if more else 0.5


class Part:
    """Orders of one language: hashes of grams with shares, hashes of contexts with what they leave to shorter ones."""

    def __init__(self, tables: list[tuple[int, np.ndarray, np.ndarray, float]]):
        shares, left = [], []
        for k, grams, counts, discount in tables:
            contexts, which = np.unique(grams >> U(16), return_inverse=True) if k > 1 else (np.zeros(1, U), np.zeros(len(grams), int))
            total, kinds = np.bincount(which, counts), np.bincount(which)
            shares.append((self.key(grams, k), (counts - discount).clip(0) / total[which]))
            left.append((self.key(contexts, k), discount * kinds / total))
        self.shares, self.left = self.sorted(shares), self.sorted(left)

    @staticmethod
    def key(grams: np.ndarray, k: int) -> np.ndarray:
        return core.mix(grams + U(k * int(core.STEP) & (1 << 64) - 1))

    @staticmethod
    def sorted(parts) -> tuple[np.ndarray, np.ndarray]:
        keys, values = map(np.concatenate, zip(*parts))
        order = np.argsort(keys)
        return keys[order], values[order].astype(np.float32)

    @staticmethod
    def find(table, keys: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[1][at], np.float32(missing))

    def extend(self, p: np.ndarray, grams: np.ndarray, orders) -> np.ndarray:
        """The probabilities of the last letter of each 4-gram, carried on by some orders."""
        for k in orders:
            short = grams & U((1 << 16 * k) - 1) if k < 4 else grams
            p = self.find(self.shares, self.key(short, k), 0.0) + self.find(self.left, self.key(short >> U(16) if k > 1 else np.zeros(len(short), U), k), 1.0) * p
        return p


class Model(Part):
    """All orders of one language."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        tables, counts = [], n.astype(np.float64)
        for k in range(ORDER, 0, -1):
            tables.append((k, grams, counts, _discount((counts == 1).sum(), (counts == 2).sum(), (counts > 1).any())))
            if k > 1:  # continuation counts: distinct grams that end in each shorter one
                grams, times = np.unique(grams & U((1 << 16 * (k - 1)) - 1), return_counts=True)
                counts = times.astype(np.float64)
        super().__init__(tables)
        self.floor = 1.0 / (len(grams) + 1)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 of the interpolated probability of the last letter of each 4-gram."""
        return -np.log2(self.extend(np.full(len(grams), self.floor), grams, range(1, ORDER + 1)))


SPREAD = 1_000_003
LOW, HIGH = 0xFFFF, 0xFFFFFFFF  # of a 4-gram without its last letter: its third letter, its second and third


class Models:
    """The languages in order, and groups of (orders, mask, slices): a slice is a broadcast {language: Part}, chosen by the masked letters."""

    def __init__(self, floors: dict[str, float], groups: list):
        self.names, self.floors, self.groups = list(floors), np.array(list(floors.values())), groups
        self.one = all(len(g[2]) == 1 for g in groups)
        self.chunk = core.CHUNK_BYTES * (1 if self.one else 8)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last letter of each 4-gram, a row a language."""
        p = np.repeat(self.floors[:, None], len(grams), axis=1)
        for orders, mask, slices in self.groups:
            spot = (grams >> U(16) & U(mask)) % U(SPREAD) % U(len(slices))
            for k, held in enumerate(slices):
                at = np.flatnonzero(spot == U(k))
                if len(at):
                    parts = held.value if self.one or held._path is None else held.load_from_path(held._path)  # .value would stay in memory
                    for i, name in enumerate(self.names):
                        if name in parts:
                            p[i, at] = parts[name].extend(p[i, at], grams[at], orders)
        return -np.log2(p)


def _by_language(tables: list[tuple[int, DataFrame]], discounts: dict[tuple[str, int], float]) -> dict[str, Part]:
    """A slice, of tables (lang, gram, n) of some orders."""
    found: dict[str, list] = {}
    for k, table in tables:
        rows = table.select("lang", "gram", "n").toArrow()
        codes, names = pd.factorize(rows.column("lang").to_numpy(zero_copy_only=False))
        grams, n = rows.column("gram").to_numpy().view(U), rows.column("n").to_numpy().astype(np.float64)
        for i, name in enumerate(names):
            found.setdefault(name, []).append((k, grams[codes == i], n[codes == i], discounts[name, k]))
    return {name: Part(tables) for name, tables in found.items()}


def train(documents: DataFrame, grams: int = GRAMS) -> Models:
    counted = pin(_counted(documents))
    share = documents.sparkSession.sparkContext.broadcast
    if counted.count() <= grams:
        rows = counted.toArrow()
        langs = rows.column("lang").to_numpy(zero_copy_only=False)
        packed, n = rows.column("gram").to_numpy().view(U), rows.column("n").to_numpy()
        models = {lang: Model(packed[langs == lang], n[langs == lang]) for lang in sorted(set(langs))}
        return Models({lang: m.floor for lang, m in models.items()}, [(range(1, ORDER + 1), LOW, [share(models)])])
    orders = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct grams that end in each shorter one
        orders[k] = pin(orders[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")).agg(F.count("*").alias("n")))
    sizes, discounts = {}, {}
    for k, table in orders.items():
        for r in table.groupBy("lang").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            sizes[r["lang"], k] = r["kinds"]
            discounts[r["lang"], k] = _discount(r["ones"], r["twos"], r["kinds"] > r["ones"])
    groups = []
    for mine, mask in (((1, 2), LOW), ((3, 4), HIGH)):  # single letters, at most 65,536 a language, are in every slice of order 2
        count = -(-sum(n for (_, k), n in sizes.items() if k in mine and k > 1) // grams)
        spot = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(mask)) % SPREAD % count
        groups.append((mine, mask, [share(_by_language([(k, orders[k].where(spot == i) if k > 1 else orders[k]) for k in mine], discounts)) for i in range(count)]))
    return Models({lang: 1.0 / (sizes[lang, 1] + 1) for lang in sorted({lang for lang, _ in sizes})}, groups)


def _entropies(models: Models, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy a letter of each text under each model, and the letters."""
    grams, doc = _grams(data, offsets)
    size = len(offsets) - 1
    letters = np.bincount(doc[(grams & U(0xFFFF)) != U(0x20)], minlength=size)
    codes, unique = pd.factorize(grams)
    n = np.maximum(np.bincount(doc, minlength=size), 1)
    return np.stack([np.bincount(doc, row[codes], minlength=size) / n for row in models.bits(unique)], axis=1) if len(grams) else np.zeros((size, len(models.names))), letters


def _shares(entropies: np.ndarray, temperature: float) -> np.ndarray:
    z = np.exp(-(entropies - entropies.min(axis=1, keepdims=True)) * temperature)
    return z / z.sum(axis=1, keepdims=True)


def calibrate(documents: DataFrame, models: Models) -> tuple[float, dict[str, float]]:
    """Temperature of least log loss, and for each language the cross-entropy that all but a share REJECTED of its texts stay below."""
    names = models.names
    place = {x: i for i, x in enumerate(names)}

    def measure(batches):
        losses, cells = np.zeros(len(TEMPERATURES)), np.zeros((len(names), CELLS), np.int64)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, end, data, offsets in core.chunks(batch.column(0), models.chunk):
                got, letters = _entropies(models, data, offsets)
                own = np.array([place.get(x, -1) for x in langs[first:end]])
                use = np.flatnonzero((letters > 0) & (own >= 0))
                got, own = got[use], own[use]
                for i, t in enumerate(TEMPERATURES):
                    losses[i] -= np.log(_shares(got, t)[np.arange(len(use)), own].clip(1e-12)).sum() if len(use) else 0
                np.add.at(cells, (own, np.minimum(got[np.arange(len(use)), own] / CELL, CELLS - 1).astype(int)), 1)
        where = np.argwhere(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(losses), -1), where[:, 0]])), pa.array(np.concatenate([np.arange(len(losses)), where[:, 1]])),
             pa.array(np.concatenate([losses, cells[cells > 0]]))], ["kind", "cell", "value"])

    rows = (_learned(documents).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .mapInArrow(measure, "kind long, cell long, value double").groupBy("kind", "cell").agg(F.sum("value").alias("value")).collect())
    losses, limits = {}, {}
    cells = np.zeros((len(names), CELLS))
    for r in rows:
        if r["kind"] < 0:
            losses[r["cell"]] = r["value"]
        else:
            cells[r["kind"], r["cell"]] = r["value"]
    for i, name in enumerate(names):
        below = np.cumsum(cells[i])
        limits[name] = (int(np.searchsorted(below, below[-1] * (1 - REJECTED))) + 2) * CELL if below[-1] else np.inf
    best = min(losses, key=lambda i: (losses[i], i)) if cells.any() else 3
    return TEMPERATURES[best], limits


def language_id(documents: DataFrame, grams: int = GRAMS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted, cross_entropy) of every document."""
    models = train(documents, grams)
    temperature, limits = calibrate(documents, models) if models.names else (1.0, {})
    names = np.array(models.names, object)
    top = np.array([limits[x] for x in models.names])

    def predict(batches):
        for batch in batches:
            for first, end, data, offsets in core.chunks(batch.column(2), models.chunk):
                size = end - first
                if len(names):
                    got, letters = _entropies(models, data, offsets)
                    best = got.argmin(axis=1)
                    least, ok = got[np.arange(size), best], letters > 0
                    lang = np.where(ok, names[best], "und")
                    score = np.where(ok, np.round(_shares(got, temperature).max(axis=1), 9), 0.0)
                    accepted = ok & (least <= top[best])
                else:
                    lang, score, accepted, least = np.full(size, "und", object), np.zeros(size), np.zeros(size, bool), np.zeros(size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, size), batch.column(1).slice(first, size), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(accepted), pa.array(np.round(least, 6))],
                    ["doc_id", "held_out", "lang_pred", "score", "accepted", "cross_entropy"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(predict, SCHEMA)
