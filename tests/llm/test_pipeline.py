import numpy as np

import corpus_pipeline
from podium.llm import decontaminate, packing, quality_rules

from . import cases
from .test_dedup import brute_groups
from .test_models import brute_base, brute_score, check_layout, plain

SMALL = "/root/testdata/sf0.001"


def brute_lines(texts):
    counted = {i: [(k, x) for k, x in enumerate((t or "").split("\n")) if cases.words_of(x)] for i, t in texts}
    seen, gone = set(), {i: set() for i, _ in texts}
    for i, _ in sorted(texts):
        mine = counted[i]
        for a, b, c in zip(mine, mine[1:], mine[2:]):
            window = (a[1], b[1], c[1])
            if window in seen:
                gone[i] |= {a[0], b[0], c[0]}
            seen.add(window)
    out = []
    for i, t in texts:
        if not gone[i]:
            out.append((i, t))
        elif len(gone[i]) < len(counted[i]):
            out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])))
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    ratios, threshold = quality_rules.train(docs, labels)
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = [[(i, t) for i, t in texts if not brute_base(t)[-1] and brute_score(t, ratios) >= threshold]]
    want.append(brute_lines(want[-1]))
    want.append([w for w, g in zip(want[-1], sorted(brute_groups(want[-1], 5, 80))) if g[0] == g[2]])
    clean = []
    for i, t in want[-1]:
        codes = {w: k for k, w in enumerate(dict.fromkeys(plain(t)))}
        text = np.array([codes[w] for w in plain(t)])
        shares = [decontaminate.align(text, np.array([codes.get(w, -1) for w in item]))[0] / (2 * len(item)) for item in items if item]
        if max(shares) < decontaminate.THRESHOLD:
            clean.append((i, t))
    want.append(clean)
    assert [len(w) for w in want] == sorted((len(w) for w in want), reverse=True) and len(want[3]) < len(want[0])
    now = docs
    for (_, stage), kept in zip(corpus_pipeline.STAGES[:-1], want):
        now = corpus_pipeline.pin(stage(spark, now, SMALL))
        assert now.columns == docs.columns
        assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == kept
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in want[3]}
    total, code = sum(r["length"] for r in rows), packing.encoder(packing.default_ranks())
    assert total == sum(len(code.ids(t)) // 4 + 1 for _, t in want[3])
    assert check_layout(rows, 2048) <= -(-total // 2048) + 1


def test_run_on_empty_documents(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_survive(spark, tmp_path):
    docs = cases.table(spark, cases.corpus(11))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.pin(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
