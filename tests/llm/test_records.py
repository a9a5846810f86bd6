"""Merkle manifest, token counts and hard negatives against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from podium.llm import hard_negatives, merkle, token_counts

from . import cases


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[name]
        if v is not None:
            v = str(v)
            if lower and name == "text":
                v = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return sha(out)


def climb(digests):
    """(root, for each leaf its levels of (left siblings, right siblings))."""
    paths, where = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i:i + 8] for i in range(0, len(digests), 8)]
        for path, at in zip(paths, where):
            run, place = runs[at // 8], at % 8
            path.append(("".join(run[:place]), "".join(run[place + 1:])))
        where = [at // 8 for at in where]
        digests = [sha("".join(run)) for run in runs]
    return digests[0], paths


def brute_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        by_lang[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in by_lang[g]])
    root, tops = climb([trees[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, top in zip(langs, tops):
        for r, path in zip(by_lang[g], trees[g][1]):
            h = leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0)
            for left, right in path + top:
                h = sha(left + h + right)
            out.append((r["doc_id"], leaf(r), trees[g][0], root, sha("".join(a + b for a, b in path + top)), h, h == root))
    return sorted(out, key=repr)


def manifest_rows(df):
    return sorted(map(tuple, merkle.digest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_of_awkward_rows(spark):
    texts = list(enumerate(cases.corpus(n=30))) + [(None, "No Id"), (None, None), (3, "same id, other text"), (-4, "X" * 300_000)]
    df = cases.table(spark, texts)
    langs = ["en", None, "dé", "a", "", "zz", "b", "c", "d", "e", "f"]
    df = df.unionByName(df.where("doc_id = 5")).unionByName(df.limit(0))
    rows = [r.asDict() for r in df.collect()]
    for i, r in enumerate(rows):
        r["lang"] = langs[(r["doc_id"] or 0) % 3] if i % 4 else langs[i % len(langs)]
        if i % 7 == 0:
            r["source"], r["n_chars"] = None, None
    df = spark.createDataFrame(rows, df.schema).repartition(3)
    assert manifest_rows(df) == brute_manifest(rows)


def test_manifest_over_several_rounds_and_copies(spark):
    rows = [{"doc_id": i // 2, "source": "s", "lang": "x", "n_chars": 1, "text": "t"} for i in range(4_500)]
    rows += [{"doc_id": 7, "source": "s", "lang": "x", "n_chars": 1, "text": "t"}] * 9_000
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest_rows(df) == brute_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert merkle.digest(cases.empty(spark)).count() == 0
    one = merkle.digest(cases.table(spark, [(1, "only")])).collect()[0]  # 3 does not divide crc32('1'): 2212294583
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof_sha256"] == sha("")


def library_counts(texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in texts), key=repr)


def counted(df, **options):
    return sorted((tuple(r)[:3] for r in token_counts.token_counts(df, **options).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)


@pytest.mark.parametrize("chunk", [200, token_counts.CHUNK])
def test_token_counts_are_the_librarys(spark, chunk):
    texts = list(enumerate(cases.corpus(n=30)))
    odd = [" ", "  ", "▁", " a", "a ", "a  ▁ b▁", "\n", "\n\n a\n", " \n ", "<s>x</s> <unk><0x0A>", "\r\n;\r\n", "\x00\x01 \x00", "日本語 テキスト　x", "é é ﬁ ½",
           "🙂🙂 a🙂b", "​  x", "a" * 3000, " " * 50, "▁" * 17 + "x", "tab\tand\x0bmore"]
    rng = random.Random(4)
    odd += ["".join(rng.choice(" ▁\n\tab;)}{\r1é日🙂") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "no id"), (None, "no id"), (3, "again")]
    assert counted(cases.table(spark, texts), chunk=chunk) == library_counts(texts)


def test_token_counts_of_a_long_text_and_of_none(spark):
    vocab = cases.vocabulary(random.Random(3))
    text = " ".join(random.Random(2).choices(vocab, k=300_000))
    got = token_counts.token_counts(cases.table(spark, [(1, text)])).collect()
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got] == library_counts([(1, text)]) and got[0]["over_limit"]
    assert token_counts.token_counts(cases.empty(spark)).count() == 0


def brute_negatives(rows, k=5):
    kept = {}
    for vec_id, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        v = tuple(math.floor(256 * x) for x in vec)
        kept[(vec_id, label, v)] = None
    rows = list(kept)
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    first = lambda a, some: sorted(some, key=lambda b: (-score(a, b), b[0] is None, b[0] or 0))[:k]
    out = []
    for a in rows:
        if a[0] is None or a[0] % 100:
            continue
        for p in first(a, [b for b in rows if b[1] == a[1] and b != a]):
            top = score(a, p)
            for i, b in enumerate(first(a, [b for b in rows if b[1] != a[1] and 80 * top <= 100 * score(a, b) <= 100 * top]), 1):
                out.append((a[0], p[0], i, b[0], top, score(a, b)))
    return sorted(out, key=repr)


def negatives(df, **options):
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(df, **options).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def vectors(spark, rows):
    full = [(i, v, n, "x", 1, 2, "y", 3.0) for i, v, n in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, code string, list int, score long, v string, align double").repartition(4)


@pytest.mark.parametrize("dim, block", [(64, 1 << 15), (7, 3), (100, 4)])
def test_hard_negatives_are_exact(spark, dim, block):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(900):
        v = (centres[i % 4] + rng.normal(size=dim) * rng.choice([0.1, 0.5, 1.0])).astype(np.float32)
        rows.append((i - 200, [float(x) for x in v], int(rng.integers(0, 3))))
    rows += [(2000 + i, rows[5][1], i % 3) for i in range(60)]                                      # one very common vector
    rows += [(2100 + i, [0.0] * dim, 1) for i in range(5)] + [(2200, [-x for x in rows[3][1]], 2)]
    rows += [rows[200], rows[201], (None, rows[8][1], 0), (None, rows[9][1], 1)]                    # repetitions and null ids
    rows += [(300, None, 1), (301, rows[0][1], None), (400, [None] + rows[0][1][1:], 1), (500, [float("nan")] + rows[0][1][1:], 1),
             (600, [float("inf")] + rows[0][1][1:], 1)]
    assert negatives(vectors(spark, rows), block=block) == brute_negatives(rows)


def test_hard_negatives_share_of_scored_rows(spark):
    """The bounds hold for every pair, and leave few rows to score where neighbours are near."""
    rng = np.random.default_rng(1)
    centres = np.repeat(rng.normal(size=(20, 64)), 50, 0)
    v = np.floor(256 * (centres + 0.1 * rng.normal(size=(1000, 64)))).astype(np.int64)
    anchors = hard_negatives.Anchors(np.arange(10), np.zeros(10, int), v[::100])
    batch = next(hard_negatives._code(64)(iter([hard_negatives.pa.RecordBatch.from_pydict({"vec_id": np.arange(1000), "label": np.zeros(1000, np.int32), "v": list(v)})])))
    rows = hard_negatives.Codes(batch, 64)
    low, high = hard_negatives.bounds(anchors, slice(0, 10), rows)
    score = v[::100] @ v.T
    assert (low <= score).all() and (score <= high).all()
    fifth = np.sort(score, 1)[:, -6]  # what the rows of the best bounds reach when they are scored first
    assert (high >= fifth[:, None]).mean() < 0.1


def test_hard_negatives_of_nothing(spark):
    assert negatives(vectors(spark, [])) == [] and negatives(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []
    assert negatives(vectors(spark, [(100, [1.0, 2.0], 1)])) == []
