import collections
import hashlib
import itertools

import duckdb
import numpy as np
import pytest

from podium.llm import jaccard_join, line_dedup, phrase_dedup, suffix_dedup

from . import cases


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def brute_bytes(texts, length):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = collections.Counter(b[p:p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [40, 120, 400])
def test_suffix_dedup_is_exact(spark, length):
    texts = list(enumerate(cases.corpus()))
    texts += [texts[9], (None, texts[12][1]), (9, "another text under a known id " * 9)]
    got = rows_of(suffix_dedup.digest(cases.table(spark, texts), length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(texts, length)


def test_suffix_dedup_spans_and_empty_table(spark):
    got = suffix_dedup.suffix_dedup(cases.table(spark, ["x" * 100, "abc", "-" + "x" * 50]), 40)
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert [tuple(s) for s in spans[0]] == [(0, 100)] and spans[1] is None and [tuple(s) for s in spans[2]] == [(1, 51)]
    assert suffix_dedup.digest(cases.empty(spark)).count() == 0


def brute_phrases(texts, window):
    data = [(-(1 << 63) if i is None else i, i, [w.encode() for w in cases.words_of(t)]) for i, t in texts]
    first = {}
    for key, _, w in sorted(data, key=lambda d: d[0]):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), key)
    out = []
    for key, i, w in data:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < key:
                gone[p:p + window] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,hot", [(13, 50_000), (13, 2), (7, 50_000)])
def test_phrase_dedup_is_exact(spark, window, hot):
    texts = list(enumerate(cases.corpus(2)))
    texts += [texts[9], (None, texts[12][1]), (9, texts[20][1])]
    got = rows_of(phrase_dedup.phrase_dedup(cases.table(spark, texts), window, hot), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_phrases(texts, window)


def test_copies_of_a_hot_window_do_not_meet_in_a_shard(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    texts = list(enumerate([passage + f" end{i}" for i in range(400)]))
    docs = cases.table(spark, texts)
    cut = phrase_dedup.segments(docs, 13, 2).collect()
    sent = collections.Counter()
    for r in cut:
        if r["pack"] is not None:
            held = {}
            phrase_dedup._unpack(bytes(r["pack"]), held)
            sent.update(held.keys())
    assert sum(r["place"] is not None for r in cut) >= 400 * 18 and max(sent.values()) <= 4  # once a task
    assert rows_of(phrase_dedup.phrase_dedup(docs, 13, 2), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_phrases(texts, 13)


def test_phrase_dedup_of_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    words = [f"w{i}" for i in range(2_500_000)]
    words[1_000_000:1_000_000] = passage.split()
    long = "\n ".join(words)
    assert len(long) > 20 << 20
    got = phrase_dedup.digest(cases.table(spark, [(1, passage), (2, long), (3, "short")])).collect()
    want = hashlib.sha256(" ".join(w for w in words if w[0] != "p").encode()).hexdigest()
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in got} == {(1, 40, 0), (2, 2_500_040, 40), (3, 1, 0)}
    assert next(r["kept_sha256"] for r in got if r["doc_id"] == 2) == want


def test_phrase_dedup_of_many_null_ids(spark):
    texts = [(None, " ".join(f"n{i}x{j}" for j in range(20)) + " " + " ".join(f"c{j}" for j in range(20))) for i in range(5_000)]
    docs = cases.table(spark, texts + [(1, texts[7][1])])
    lists = phrase_dedup._recurring(phrase_dedup._rows(docs), 13, 50_000)
    assert max(len(r["seeds"]) for r in lists.collect()) < 40  # per row, not per id
    got = collections.Counter((r["doc_id"], r["n_removed"]) for r in phrase_dedup.digest(docs).collect())
    assert got == {(None, 0): 5_000, (1, 40): 1}


def test_phrase_dedup_empty_table(spark):
    assert phrase_dedup.digest(cases.empty(spark)).count() == 0


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    """2,000 edited copies of one text, whose pairs lie on both sides of the threshold: exact, and no pairs of the whole group."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(2_000):
        words = list(base)
        for at in rng.choice(80, rng.integers(0, 7), replace=False):
            words[at] = f"e{rng.integers(0, 60)}"
        lo = int(rng.integers(0, 25)) if i % 2 else 0
        texts.append((i, " ".join(words[lo:])))
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in texts)]
    number = {}
    held = np.zeros((len(sets), 20_000), np.float32)
    for i, x in enumerate(sets):
        held[i, [number.setdefault(g, len(number)) for g in x]] = 1
    both, size = held @ held.T, held.sum(1)
    link = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    comp = np.arange(len(sets))
    while True:
        near = np.array([comp[row].min() for row in link])
        near = np.minimum(near, near[near])
        if (near == comp).all():
            break
        comp = near
    assert 0.05 < link.mean() < 0.95 and len(set(comp)) > 20
    got = jaccard_join.linked(cases.table(spark, texts), 3, 80, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(comp.tolist()))


def test_line_dedup_equals_its_sql(spark):
    texts = list(enumerate(cases.corpus(3)))
    docs = cases.table(spark, texts)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(t) for t in texts])
    want = sorted(con.execute(line_dedup.SQL).fetchall(), key=repr)
    assert rows_of(line_dedup.digest(docs), "doc_id", "n_lines", "n_removed", "kept_sha256") == want
    assert sum(r[2] for r in want) > 10


def test_line_dedup_ties_and_repeats(spark):
    block = "one\n\ntwo\nthree\nfour"
    got = line_dedup.line_dedup(cases.table(spark, [(1, block), (1, block), (2, "zero\n" + block), (3, None), (4, "one\ntwo"), (None, "p\nq\nr"), (5, "p\nq\nr\ns")]))
    text = collections.defaultdict(list)
    for r in got.collect():
        text[r["doc_id"]].append(r["text"])
    assert text[1] == [block, block]  # a repeated row stands for the same document
    assert text[2] == ["zero\n"] and text[3] == [None] and text[4] == ["one\ntwo"] and text[None] == ["p\nq\nr"] and text[5] == ["s"]
    assert line_dedup.line_dedup(cases.empty(spark)).count() == 0
    kept = line_dedup.without_repeats(cases.table(spark, [(1, block), (2, block)]))
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_without_repeats_keeps_the_columns(spark):
    docs = cases.table(spark, [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, ""), (4, None)])
    kept = line_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def brute_groups(texts, n, num):
    sets = []
    for _, t in texts:
        w = cases.words_of(t, lower=True)
        sets.append(frozenset(zip(*[w[j:] for j in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else []))
    boss = list(range(len(sets)))

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
            boss[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    least = {i: min((texts[j][0] for j in g)) for g in groups.values() for i in g}
    return sorted(((texts[i][0], len(sets[i]), least[i]) for i in range(len(sets))), key=repr)


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 50)])
def test_links_are_exact(spark, n, num):
    texts = list(enumerate(cases.corpus(4, 90)))
    got = rows_of(jaccard_join.linked(cases.table(spark, texts), n, num, 100), "doc_id", "n_shingles", "component_id")
    want = brute_groups(texts, n, num)
    assert got == want and any(r[0] != r[2] for r in want)


def test_small_sets_at_the_edge(spark):
    words = [f"w{i}" for i in range(30)]
    texts = list(enumerate([" ".join(words[:k]) for k in (3, 11, 12, 13, 21, 22)] + ["W0 w1 W2", "w0 w1", "W0  w1", None, ""]))
    got = rows_of(jaccard_join.linked(cases.table(spark, texts), 3, 90, 100), "doc_id", "n_shingles", "component_id")
    assert got == brute_groups(texts, 3, 90)


def test_signatures_meet_whenever_sets_link():
    rng = np.random.default_rng(3)
    bands = jaccard_join.Bands(80, 100)
    for size in (9, 17, 40, 160, 900):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            differ = bands.difference(len(a), len(a)) // 2
            b = np.unique(np.concatenate([a[differ:], rng.integers(0, 1 << 63, differ, dtype=np.uint64)]))
            shared = []
            for s in (a, b):
                edges = bands.edges(4096)
                band = int(np.searchsorted(edges, len(s), "right")) - 1
                shared.append({x for j in (band, band + 1) for x in jaccard_join._signatures(
                    s, bands.difference(int(edges[j + 1]) - 1, int(edges[j + 1]) - 1), j, int(edges[max(j - 1, 0)])).tolist()})
            assert differ == 0 or shared[0] & shared[1]


def test_one_of_each_keeps_rows_and_columns(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = cases.table(spark, [(5, text), (3, text + " more"), (7, "something else entirely here now"), (8, None), (9, "")])
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8, 9]
    assert jaccard_join.linked(cases.empty(spark)).count() == 0


def test_phrase_seeds_are_not_written(spark, monkeypatch):
    """op4: all seeds of the corpus take most of the input's size; only those that recur may go on."""
    def fail(df):
        raise AssertionError("seeds are written")
    monkeypatch.setattr(phrase_dedup, "pin", fail)
    passage = " ".join(f"w{i}" for i in range(20))
    found = phrase_dedup._recurring(phrase_dedup._rows(cases.table(spark, [(1, passage), (2, passage), (3, "short")])), 13, 9).collect()
    assert sorted(r["doc"] for r in found) == [1, 2]
