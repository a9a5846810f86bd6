import math
import zlib

import numpy as np
import pytest

from podium.llm import core, decontaminate, html_text, language_id, packing, quality_rules, secret_scan

from . import cases

SMALL = "/root/testdata/sf0.001"


# quality rules

def brute_base(text):
    words = cases.words_of(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if cases.words_of(line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    marked = set()
    for i, t in enumerate(triples):
        if triples.count(t) > 1:
            marked |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked), failed


def brute_score(text, ratios):
    words = np.array([core.spans(core.running(np.frombuffer(w.encode(), np.uint8)), np.array([0]), np.array([len(w.encode())]))[0] for w in cases.words_of(text)], core.U)
    if not len(words):
        return 0.0
    grams = [int(w) >> (64 - quality_rules.BITS) for w in words] + [int(core.shingles(words[i:i + 2], 2)[0]) >> (64 - quality_rules.BITS) for i in range(len(words) - 1)]
    return float(np.mean([np.float32(ratios[g]) for g in grams]))


def labels_for(spark, n):
    rows = [(i, 0 if i % 6 == 3 else 1, 1 if i % 11 == 0 else 0, "x") for i in range(n)] + [(None, 1, 0, "x"), (5, None, None, "x"), (6, 1, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_quality_rules_against_brute_force(spark):
    texts = list(enumerate(cases.corpus(5)))[:-1] + [(2000, "a b c\na b c\n\n a b c\na  b c |<>"), (9, "again " * 60), (None, "p q r " * 20)]
    docs, labels = cases.table(spark, texts), labels_for(spark, 60)
    ratios, threshold = quality_rules.train(docs, labels)
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["score"], r["kept"])
                  for r in quality_rules.score(docs, ratios, threshold).collect()), key=repr)
    want = sorted(((i, *brute_base(t), t) for i, t in texts), key=lambda w: repr(w[:-1]))
    assert sorted((g[:7] for g in got), key=repr) == sorted((w[:7] for w in want), key=repr)
    scores = {}
    for i, t in texts:
        scores.setdefault(i, []).append(brute_score(t, ratios))
    for g in got:
        assert any(math.isclose(g[7], s, abs_tol=1e-6) for s in scores[g[0]])
        assert g[8] == (not g[6] and g[7] >= threshold)
    kept = sorted((r["doc_id"] for r in quality_rules.keep_good(docs, labels).collect()), key=repr)
    assert kept == sorted((g[0] for g in got if g[8]), key=repr)


def test_counts_cover_all_documents(spark):
    texts = [f"alpha beta {w}" for w in ("one", "two", "one")] * 5
    docs = cases.table(spark, texts)
    ratios, _ = quality_rules.train(docs, labels_for(spark, 15))
    assert np.isfinite(ratios).all() and np.count_nonzero(ratios) > 0


def test_quality_without_labels_or_rows(spark):
    none = labels_for(spark, 0).where("doc_id IS NULL")
    docs = cases.table(spark, [" ".join(f"w{i}" for i in range(60)), "short", None])
    assert [r["kept"] for r in quality_rules.quality_rules(docs, none).orderBy("doc_id").collect()] == [True, False, False]
    assert quality_rules.quality_rules(cases.empty(spark), none).count() == 0


def test_quality_separates_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    got = quality_rules.quality_rules(docs, labels).where("NOT base_failed").join(labels, "doc_id").where("toxic = 0").groupBy("quality", "kept").count().collect()
    count = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert count[1, True] > 0.97 * (count[1, True] + count.get((1, False), 0)) and count.get((0, False), 0) > 0.9 * sum(count.get((0, k), 0) for k in (True, False))


# decontamination

def plain(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text or "").split()


def brute_align(text, item):
    best, table = 0, np.zeros((len(item) + 1, len(text) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a == b else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
            best = max(best, table[i, j])
    return best / (2 * len(item))


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text, item = rng.integers(0, 5, rng.integers(1, 40)), rng.integers(0, 5, rng.integers(1, 20))
        score, start, end = decontaminate.align(text, item)
        assert score / (2 * len(item)) == brute_align(text.tolist(), item.tolist())
        assert score == 0 or decontaminate.align(text[start:end], item)[0] == score


def test_leaks_against_brute_force(spark):
    import random
    rng = random.Random(8)
    vocab = cases.vocabulary(rng, 3000)
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [prose(30), prose(24), prose(2), []]
    edited = list(items[0])
    for k in (4, 9, 15, 22, 27):
        edited[k] = rng.choice(vocab)
    texts = [" ".join(prose(80)), " ".join(prose(40) + items[0] + prose(10)), " ".join(edited + prose(60)).replace("a", "A"), " ".join(prose(30) + items[0][:9] + prose(40)),
             "", None, " ".join(prose(5) + items[1][:12] + prose(2) + items[1][12:]), ", ".join(items[2]), " ".join(items[1]) + ".", " ".join(items[1]) + "."]
    bench = spark.createDataFrame([(i, " ".join(t), "x", 1.0) for i, t in enumerate(items)] + [(9, None, "x", 1.0)], "item_id long, text string, doc_id string, score double")
    docs = cases.table(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items[:2]):
            share = brute_align(plain(t), plain(" ".join(item)))
            if share >= decontaminate.THRESHOLD:
                want[d, i] = share
    assert {k: v for k, v in got.items() if k[1] < 2} == pytest.approx(want) and {(1, 0), (2, 0), (6, 1), (8, 1), (9, 1)} <= set(want)
    assert (7, 2) in got
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.contaminated(cases.empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("item_id > 99")).count() == 0 and decontaminate.without_leaks(docs, bench.where("item_id > 99")).count() == len(texts)


# language

def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_rules(spark):
    texts = [("the cat sat on the mat with the hat " * 3), ("der hund und die katze schlafen nicht " * 3)] * 8
    rows = [(i, t, "en" if i % 2 == 0 else "de", "x", 0.5) for i, t in enumerate(texts)]
    rows += [(100, "Das ist die Katze und der Hund", None, "x", 0.5), (101, "THE CAT AND THE HAT", None, "x", 0.5), (102, None, "en", "x", 0.5), (103, "123 ... !!", "en", "x", 0.5),
             (104, "", None, "x", 0.5), (None, "the hat sat", "xx", "x", 0.5), (101, "THE CAT AND THE HAT", None, "x", 0.5), (105, "𐐀𐐁 漢字 the mat", None, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert got[100]["lang_pred"] == "de" and got[101]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (102, 103, 104))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None) and not got[None]["held_out"]
    assert {r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", docs.lang_pred.substr(9, 0)).where("lang IS NULL")).collect()} <= {"und"}
    assert language_id.language_id(docs.where("doc_id < 0")).count() == 0


def test_no_gram_is_lost_beyond_one_slice(spark):
    import random
    rng = random.Random(3)
    big, small = cases.vocabulary(rng, 300), ["quux", "zyzzyva", "jokyq", "xyloz"]
    rows = [(i, " ".join(rng.choice(big) for _ in range(40)), "aa") for i in range(60)] + [(100 + i, " ".join(rng.choice(small) for _ in range(6)), "zz") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    one, many = (sorted((tuple(r) for r in language_id.language_id(docs, grams=n).collect())) for n in (10**6, 150))
    assert len(one) == len(many) and all(a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3], abs=1e-6) and a[5] == pytest.approx(b[5], abs=1e-5) for a, b in zip(one, many))
    assert {r[2] for r in many if r[0] >= 100} == {"zz"}


def test_model_is_a_distribution():
    texts = ["abab abba baab", "aabb abab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    grams, _ = language_id._grams(data, np.array([0, len(texts[0]), len(data)]))
    unique, n = np.unique(grams, return_counts=True)
    model = language_id.Model(unique, n)
    letters = np.unique(grams & np.uint64(0xFFFF))
    for context in np.unique(grams >> np.uint64(16)):
        p = 2 ** -model.bits((context << np.uint64(16)) | letters)
        assert p.sum() == pytest.approx(1, abs=0.3) and (p > 0).all() and p.sum() <= 1 + 1e-6


# pages

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class=home>
<div id="cookie-banner"><p>We use cookies to improve the site and to show you what you like.</p></div>
<header class="site-header"><a href="/">Logo</a><ul class="menu"><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>About</a></ul></header>
<div class="layout"><div class="post-content"><h1>The &amp; title</h1><p>First   paragraph &mdash; with <a href=x>a link</a>, an <b>accent</b> and enough words to look like prose, it ends here.
<p>Second paragraph<br>goes on &lt;here&gt; with more words, as paragraphs in an article do, and then it stops.</p>
<div class="ad-slot"><p>Buy now, best offer of the week only here.</p></div>
<script>document.write("<p>no</p>")</script><ul><li>An item in the article, long enough to say something of its own.</ul></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=1>Other story</a></li><li><a href=2>Another story</a></li></ul></aside></div>
<section id="comments"><div class="comment"><p>I liked this article a lot, thank you for writing it, it was great.</p></div></section>
<form class="newsletter"><label>Your mail</label><input><button>Subscribe</button></form>
<footer>&copy; 2024 Site. All rights reserved.</footer></body>"""


def test_article_of_an_unseen_template(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    more = spark.createDataFrame([(900001, "u", PAGE), (900002, "u", None), (900003, "u", ""), (900004, "u", "<p>broken <b attr='"), (900005, "u", "just words")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(pages.unionByName(more)).collect()}
    assert got[900001]["text"].split("\n") == [
        "The & title", "First paragraph — with a link, an accent and enough words to look like prose, it ends here.",
        "Second paragraph goes on <here> with more words, as paragraphs in an article do, and then it stops.", "An item in the article, long enough to say something of its own."]
    assert got[900002]["text"] == got[900003]["text"] == "" and got[900002]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == pages.count() + 5


def test_article_of_every_page(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(4)
    field = html_text.Field()
    field.unary, field.step, field.fitted = rng.normal(size=(html_text.SIZE, 2)), rng.normal(size=(2, 2)), True
    rows = [sorted(rng.choice(html_text.SIZE, 3, replace=False).tolist()) for _ in range(9)]
    scores = field.scores(rows)
    value = lambda y: sum(scores[i, s] for i, s in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))
    best = max((tuple(map(int, np.binary_repr(k, 9))) for k in range(512)), key=value)
    assert tuple(field.decode(rows)) == best


def test_field_gradient_learns_transitions():
    rows = [[[1], [2], [2], [3]], [[1], [2], [3], [3]]] * 10
    labels = [[0, 1, 1, 0], [0, 1, 0, 0]] * 10
    field = html_text.Field().fit(list(zip(rows, labels)))
    assert all(field.decode(r) == y for r, y in zip(rows, labels))


def test_label_attributes_of_real_pages(spark):
    table = "<table><tr><td data-label='Price'>ten</td><td data-label=''>two</td><td data-label='0'>six</td></tr></table>"
    pages = spark.createDataFrame([(1, table)], "page_id long, html string")
    assert [r["text"] for r in html_text.extract(pages).collect()] == ["ten\ntwo\nsix"]
    assert html_text.labels_of(html_text.blocks(table)) is None


def test_few_labelled_pages_among_many_are_all_learned_from(spark):
    from pyspark.sql import functions as F
    page = "<html><body><nav><a href=x>Menu</a></nav><article><p>Some words of page {}, long enough to be prose.</p></article><footer>Foot</footer></body></html>"
    plain = spark.range(0, 3000).select(F.col("id").alias("page_id"), F.format_string("<div>text %d</div>", "id").alias("html"))
    few = spark.createDataFrame([(9000 + i, page.format(i)) for i in range(3)], "page_id long, html string")
    one, both = html_text.train(few, 10), html_text.train(plain.unionByName(few), 10)
    assert one.fitted and both.fitted and np.array_equal(one.unary, both.unary)


def test_pages_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "<div><p>a b</p><script>x</script>c</div>", "x")], "page_id long, html string, text string")
    assert [tuple(r) for r in html_text.extract(pages).collect()] == [(1, None, "a b\nc", 5)]
    assert html_text.extract(pages.where("page_id > 1")).count() == 0


# packing

def test_ids_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    code = packing.encoder(packing.default_ranks())
    texts = [t or "" for t in cases.corpus(6)][:-1] + ["a  b", " lead", "trail ", "tab\tand\nline \n x", "don't we'll <|endoftext|> x", " nbsp  em", "x" * 700, "12 345,6 é漢字 🙂 \x1c z"]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(30).collect()]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(code.ids(text), "<u4").tolist() == want.ids


def test_a_text_is_encoded_at_once(monkeypatch):
    code, asked = packing.encoder(packing.default_ranks()), []
    encode = code.encode
    monkeypatch.setattr(code, "encode", lambda text: asked.append(text) or encode(text))
    texts = [f"n{i}ab wi{i}ch lo{i}mu, er{i}to" for i in range(50)]  # words met once
    for text in texts:
        code.ids(text)
    assert asked == texts


def test_ids_of_long_white_space_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code, n = packing.encoder(packing.default_ranks()), 1_000_000  # more than the look-ahead has stack for
    runs = [" " * n, "\n" * n, " \n\t" * (n // 3), "\u3000" * 100_000]
    for text in [r for run in runs for r in (run, "a " + run, run + "b", "don't " + run + "stop, 12")] + [runs[0] + "a" + runs[1] + "b c", runs[3] + " é" + runs[0]]:
        assert np.frombuffer(code.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_layout(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_of_documents(spark):
    texts = list(enumerate(cases.corpus(7))) + [(3, "three again"), (3, "three again"), (None, "no id")]
    code = packing.encoder(packing.default_ranks())
    for size in (64, 2048):
        rows = packing.pack(cases.table(spark, texts), size).collect()
        n = check_layout(rows, size)
        total = sum(r["length"] for r in rows)
        assert n <= -(-total // size) + 1
        want = []
        for i, t in texts:
            ids = code.ids(t or "") + packing.END
            count = len(ids) // 4
            first = count if count <= size else count % size or size
            cuts = [0, *range(first, count + 1, size)]
            want += [(i, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=repr) == sorted(want, key=repr)
    assert packing.pack(cases.empty(spark)).count() == 0


def fewest(lengths, size):
    """Sequences needed at least, by exhaustive search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                rest = list(rooms)
                rest.remove(room)
                place(k + 1, rest + [room - lengths[k]])
        place(k + 1, rooms + [size - lengths[k]])

    place(0, [])
    return best


def test_bin_completion_against_exhaustive_search():
    rng = np.random.default_rng(2)
    better = 0
    for trial in range(40):
        size = 30
        lengths = rng.integers(3, 20, rng.integers(4, 10))
        counts = np.bincount(lengths, minlength=size + 1)
        plan = packing.bin_completion(counts, size)
        used = sum(t for _, t in plan)
        laid = np.zeros(size + 1, int)
        for fill, times in plan:
            assert sum(fill) <= size
            np.add.at(laid, list(fill), times)
        assert (laid == counts).all()
        first = sum(t for _, t in packing.best_fit(counts, size))
        least = fewest(lengths.tolist(), size)
        assert least <= used <= first and used <= least + 1
        better += used < first
    hard = np.bincount([6, 6, 5, 5, 4, 4, 10, 10, 10], minlength=21)
    assert sum(t for _, t in packing.bin_completion(hard, 20)) == 3


# secrets

def test_secrets_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.1/documents.parquet").where("doc_id < 4000")
    learned, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    labelled = secret_scan.provisional_labels(secret_scan.candidates(learned))
    got = secret_scan.secret_scan(held, labelled)
    want = secret_scan.provisional_labels(secret_scan.candidates(held)).select("doc_id", "nth", "label")
    wrong = got.join(want, ["doc_id", "nth"]).where("is_secret <> label").count()
    assert got.count() == want.count() > 50 and wrong <= 0.02 * want.count()


def test_candidates_and_places(spark):
    key = "9f14a7029c8514dfe98aba92898d323168e199da"
    texts = [f'é then token = "{key}" and 1234567890123456, at 10.20.30.40', None, "", "no digits ABCDEFGHIJKLMNOP", f"{key} {key}", "x" * 5000 + "1"]
    rows = [(r["doc_id"], r["nth"], r["start"], r["value"]) for r in secret_scan.candidates(cases.table(spark, texts)).orderBy("doc_id", "nth").collect()]
    first = [(0, k, texts[0].index(v), v) for k, v in enumerate([key, "1234567890123456"])]
    assert rows == [*first, (4, 0, 0, key), (4, 1, 41, key), (5, 0, 0, "x" * 5000 + "1")]
    one = secret_scan.secret_scan(cases.table(spark, [f"plain {key} here", f"plain {key} here"]))
    assert [(r["score"], r["is_secret"]) for r in one.collect()] == [(0.0, False)] * 2
    assert secret_scan.digest(cases.empty(spark)).count() == 0


def test_every_label_counts(spark):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality_rules.labelled(labels).count() == 25_000


def test_every_training_text_calibrates(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 in (2, 3)]
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 3, "en") for i in ids], "doc_id long, text string, lang string")
    assert np.isfinite(list(language_id.calibrate(docs, language_id.train(docs))[1].values())).all()
