import pytest
from pyspark.sql import functions as F

from podium.plans import competition_rank, competition_ranks, exact_quantile, prefix_counts


def numbers(spark):
    return spark.range(400).select((F.col("id") % 3).alias("g"), (F.pmod(F.hash("id"), F.lit(40))).alias("v"), "id")


def brute_rank(rows):
    return {(r["id"], 1 + sum(1 for o in rows if o["g"] == r["g"] and o["v"] > r["v"])) for r in rows}


@pytest.mark.parametrize("mode", ["small", "large"])
def test_competition_rank(spark, mode, request):
    if mode == "large":
        request.getfixturevalue("distributed")
    df = numbers(spark)
    got = {(r["id"], r["rank"]) for r in competition_rank(df.repartition(5), ["g"], [("v", False)]).collect()}
    assert got == brute_rank(df.collect())


@pytest.mark.parametrize("mode", ["small", "large"])
def test_several_ranks_at_once(spark, mode, request):
    if mode == "large":
        request.getfixturevalue("distributed")
    df = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 40).alias("v"),
                                 F.format_string("%02d", F.col("id") * 13 % 50).alias("s")).repartition(5)
    boards = {"down": [("v", False)], "up": [("s", True), ("v", False)], "named": [("s", False), ("id", True)]}
    got = {r["id"]: r for r in competition_ranks(df, ["g"], boards).collect()}
    for name, order in boards.items():
        want = {r["id"]: r["rank"] for r in competition_rank(df, ["g"], order).collect()}
        assert {i: r[name] for i, r in got.items()} == want
        rows = [r for r in got.values() if r["g"] == 1]
        if name == "down":  # nulls come last
            assert all(r["down"] == 1 + sum(o["v"] is not None and (r["v"] is None or o["v"] > r["v"]) for o in rows) for r in rows)


def test_ties_share_the_smallest_rank(frame):
    df = frame("e string, v int", *[(c, v) for c, v in zip("abcdefgh", (30, 29, 28, 27, 26, 18, 18, 15))])
    ranks = {r["e"]: r["rank"] for r in competition_rank(df, [], [("v", False)]).collect()}
    assert (ranks["f"], ranks["g"], ranks["h"]) == (6, 6, 8)


@pytest.mark.parametrize("mode", ["small", "large"])
def test_quantile_interpolates(spark, mode, request):
    if mode == "large":
        request.getfixturevalue("distributed")
    df = spark.sql("SELECT * FROM VALUES ('a', 1.0D), ('a', 2.0D), ('b', 5.0D), ('b', null) AS t(g, v)")
    got = {r["g"]: r["p"] for r in exact_quantile(df, ["g"], "v", {"p": 0.25}).collect()}
    assert got == {"a": 1.25, "b": 5.0}


def test_weighted_prefix_counts(spark, distributed):
    df = spark.sql("SELECT * FROM VALUES (10, 1), (8, 1), (9, 0), (8, 1), (1, 0) AS t(v, w)")
    got = {r["v"]: (r["n_before"], r["n_same"]) for r in prefix_counts(df, [], [("v", False)], "w").collect()}
    assert got == {10: (0, 1), 9: (1, 0), 8: (1, 2), 1: (3, 0)}


def test_pin_keeps_no_shuffle_files(spark):
    """op4: what a pinned table was shuffled from is of no use once the table is written."""
    import gc
    import time
    from podium.plans import pin
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}

    gc.collect()
    before, deadline = shuffled(), time.time() + 10
    table = pin(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before and table.count() == 7
