import duckdb
import pytest

import __spark_entry__ as entry
from podium.catalog import consensus_q, proxies, similarity_q
from podium.catalog.registry import Tables

PATH = "/root/testdata/sf0.001"
SAMPLE = ["f13_awards", "a01_season_context", "a09_stat_grains", "a19_consensus", "c05_best_fact", "t03_filtered_boards", "w07_prior_features"]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_queries_without_what_text_operators_need(monkeypatch):
    """A missing dependency takes the text queries away, and no others."""
    import sys

    import podium
    for name in [m for m in sys.modules if m.startswith("podium.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(podium, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    found = entry.queries()
    assert len(found) > 150 and "w01_competition_rank" in found and "pipeline" not in found and not [n for n in found if n.startswith("op")]
    assert set(entry.oracle_sql()) <= set(found)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "supplier", "customer", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{PATH}/{table}.parquet'")
    df = entry.queries()[name](spark, PATH)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert sorted(df.columns) == sorted(names) and len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or a == pytest.approx(b) for a, b in zip(g, w))


def test_derived_tables_are_made_once_a_query(spark, distributed):
    from podium.catalog import proxies
    from podium.catalog.registry import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    assert proxies.placement(t) is proxies.placement(t) and proxies.entity_event(t) is proxies.entity_event(t)


def test_event_totals_carry_two_keys(spark):
    """lines are summed by entity and month; what follows from both is added to the sums."""
    import re
    plan = proxies._entity_event(Tables(spark, PATH))._jdf.queryExecution().optimizedPlan().toString()
    assert [keys.count(",") for keys in re.findall(r"Aggregate \[(.*?)\], \[", plan)] == [1]
    assert "l_partkey" not in plan[:plan.index("Join Inner", plan.index("Aggregate"))]


def test_features_are_made_once(spark, distributed):
    """lines are read for the features once, whoever asks for them."""
    t = Tables(spark, PATH)
    assert similarity_q.features(t) is similarity_q.features(t)
    assert not any("lineitem" in f for f in similarity_q._features(t).inputFiles())


def test_rollups_read_lines_once_a_pass(spark, distributed):
    """participation comes from the event totals, ballot sizes from the ranked entries, ballots are made once."""
    t = Tables(spark, PATH)
    assert not any("lineitem" in f for f in consensus_q.rollup(t).inputFiles())
    assert not any("lineitem" in f for f in consensus_q.all_ballots(t).inputFiles())
