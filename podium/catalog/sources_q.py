"""Queries for sources, sinks and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import publish, tables
from ..streaming import ingest
from . import functions_q as fq
from . import proxies as px
from .registry import cte, query


@query("s01_read_wrapped_rows", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""")
def s01(t):
    """Orders written as wrapped JSON documents of about a thousand rows, then read back."""
    row = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"),
                            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("title"))
    docs = t("orders").groupBy(F.expr("o_orderkey div 1000").alias("chunk")).agg(F.collect_list(row).alias("cargoquery"))
    path = publish.workspace(t.spark, "wrapped")
    docs.select(F.to_json(F.struct("cargoquery")).alias("value")).write.text(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "status", "date")])
    return tables.read_rows(t.spark, path, schema, "wrapped", multi_line=False)


@query("s02_filter_universe", """
SELECT season, event, count(*) AS rows FROM obs WHERE season <> 1996 AND event NOT IN ('1997-03', '1998-04') AND (series % 10 = 0 OR date <= DATE '2000-06-30') GROUP BY 1, 2""")
def s02(t):
    rows = px.obs(t, opponent=False).withColumn("date", F.when(F.col("series") % 10 != 0, F.col("date")))
    return tables.filter_universe(rows, [1996], ["1997-03", "1998-04"], "2000-06-30").groupBy("season", "event").agg(F.count(F.lit(1)).alias("rows"))


@query("s03_slim_observations", """
SELECT CAST(series AS VARCHAR) AS series, CAST(entity AS VARCHAR) AS entity, CASE WHEN series % 3 <> 0 THEN mode END AS mode, CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad
FROM obs WHERE bad % 7 <> 0 AND good % 11 <> 0""")
def s03(t):
    raw = px.obs(t, opponent=False).select(
        "series", "entity", "season", F.when(F.col("series") % 3 != 0, F.col("mode")).otherwise(" ").alias("mode"),
        F.when(F.col("good") % 11 != 0, F.col("good").cast("string")).otherwise("n/a").alias("good"),
        F.when(F.col("bad") % 7 != 0, F.concat(F.lit(" "), F.col("bad").cast("string"))).otherwise("").alias("bad"))
    return tables.slim_observations(raw, ["series", "entity", "mode"])


def star(t):
    events = t("orders").selectExpr("o_orderkey AS event_id", "date_format(o_orderdate, 'yyyy-MM') AS event", "year(o_orderdate) AS season",
                                    "to_date(o_orderdate) AS date", "CASE o_orderstatus WHEN 'F' THEN 'Major' WHEN 'O' THEN 'Minor' ELSE 'Premier' END AS tier")
    results = t("lineitem").selectExpr("l_orderkey AS event_id", "l_suppkey AS team", "l_linenumber AS place", "l_suppkey AS team_page")
    rosters = t("supplier").selectExpr("s_suppkey AS team_page", "explode(sequence(0, 4)) AS i", "s_nationkey").selectExpr(
        "team_page", "team_page * 10 + i AS link", "CASE i WHEN 0 THEN 'Coach' WHEN 4 THEN 'Substitute' END AS role")
    redirects = rosters.selectExpr("link", "link div 2 * 2 AS page").distinct()
    entities = t("supplier").selectExpr("explode(sequence(s_suppkey * 10, s_suppkey * 10 + 8, 2)) AS page").where("page % 3 <> 0")
    return events, results, rosters, redirects, entities


STAR = """
SELECT CAST(p AS BIGINT) AS entity, o.o_orderkey AS event_id, CAST(year(o_orderdate) AS INTEGER) AS season, l.l_suppkey AS team, l.l_linenumber AS place
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey, range(1, 5) AS r(i), LATERAL (SELECT (l.l_suppkey * 10 + i) // 2 * 2 AS p)
WHERE o_orderstatus IN ('F', 'P') AND p % 3 <> 0"""


@query("s04_resolve_star", f"SELECT season, entity, count(*) AS placements, count(*) FILTER (place = 1) AS wins, CAST(sum(place) AS BIGINT) AS place_sum FROM ({STAR}) GROUP BY 1, 2")
def s04(t):
    rows = tables.resolve_star(*star(t), tiers=["Major", "Premier"])
    return rows.groupBy("season", "entity").agg(F.count(F.lit(1)).alias("placements"), F.count_if(F.col("place") == 1).alias("wins"), F.sum("place").alias("place_sum"))


@query("s05_resolve_awards", """
SELECT a.id, a.kind AS type, a.page, e.n AS page_awards FROM awards a JOIN (SELECT page, count(*) AS n FROM awards GROUP BY 1) e ON e.page = a.page
WHERE a.kind IN ('Event MVP', 'Season MVP', 'CWL All-Star') AND a.page NOT LIKE '%Breaking Point Awards%'""")
def s05(t):
    rows = fq.awards(t)
    events = rows.groupBy("page").agg(F.count(F.lit(1)).alias("page_awards"))
    given = rows.select("id", F.col("kind").alias("type"), "page")
    return tables.resolve_awards(given, events, ["Event MVP", "Season MVP", "CWL All-Star"], "%Breaking Point Awards%")


@query("s06_distinct_events", """
SELECT 'page' || month AS page, season, CAST(min(date) AS VARCHAR) AS date, arg_min(event || series % 3, CAST(date AS VARCHAR) || event || (series % 3)) AS event
FROM obs WHERE season <> 1996 AND date <= DATE '2000-06-30' GROUP BY month, season""")
def s06(t):
    rows = px.obs(t, opponent=False).selectExpr("'page' || month AS page", "season", "date", "event || series % 3 AS event")
    return tables.distinct_events(rows, [1996], as_of="2000-06-30").withColumn("date", F.col("date").cast("string"))


@query("s07_merge_new", """
WITH b AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 4 <> 0 THEN l_linenumber END AS line, l_returnflag AS flag FROM lineitem)
SELECT k, line, flag FROM b WHERE k % 3 <> 0
UNION ALL SELECT DISTINCT k, line, flag FROM b WHERE k % 2 = 0 AND (k, coalesce(line, -1), flag) NOT IN (SELECT (k, coalesce(line, -1), flag) FROM b WHERE k % 3 <> 0)""")
def s07(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber")).alias("line"),
                                F.col("l_returnflag").alias("flag"))
    return tables.merge_new(rows.where("k % 3 <> 0"), rows.where("k % 2 = 0"), ["k", "line", "flag"])


@query("s08_incremental_ingest", """
SELECT event_type, count(*) AS rows, round(sum(value), 4) AS value FROM (SELECT DISTINCT * FROM events WHERE event_type <> 'error') GROUP BY 1""")
def s08(t):
    """Events land in files over two runs with repeats; the second run only takes what is new."""
    spark, source = t.spark, t("events")
    root = publish.workspace(spark, "ingest")
    source.where("event_id % 2 = 0").write.parquet(f"{root}/in/a")
    schema = source.schema
    args = (spark, f"{root}/in/*", schema, f"{root}/out", f"{root}/checkpoint", ["event_id"], "event_type <> 'error'")
    ingest.incremental_ingest(*args)
    source.where("event_id % 2 = 1 OR event_id % 10 = 0").write.parquet(f"{root}/in/b")
    ingest.incremental_ingest(*args)
    return ingest.landed(spark, f"{root}/out", schema).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("value"))


FINGER = """SELECT '{0}' AS source, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256({1}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM {0}"""
SOURCES = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "lineitem": "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
}
FIELD = "coalesce(length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
cte("prints", " UNION ALL ".join(FINGER.format(s, " || ".join(FIELD.format(c) for c in columns.split())) for s, columns in SOURCES.items()))


def prints(t):
    out = None
    for name, columns in SOURCES.items():
        one = publish.fingerprint(t(name).select(*columns.split()), name)
        out = one if out is None else out.unionByName(one)
    return out


@query("s09_fingerprint", "SELECT source, rows, digest FROM prints")
def s09(t):
    return prints(t)


def metadata(actual):
    return actual.select("source", F.lit("canonical").alias("status"), F.lit("1").alias("version"), F.lit("all").alias("scope"))


def previous_manifest(actual):
    """An older manifest in which one source had other content."""
    return actual.select("source", "rows", F.when(F.col("source") == "part", "0").otherwise(F.col("digest")).alias("digest"),
                         F.lit("2026-01-01").alias("provenance"), F.lit("batch-1").alias("batch_id"))


@query("s09_manifest", """
SELECT source, rows, digest, CASE WHEN source = 'part' THEN '2026-02-01T00:00:00Z' ELSE '2026-01-01' END AS provenance, CASE WHEN source = 'part' THEN 'batch-2' ELSE 'batch-1' END AS batch_id,
  CASE WHEN source = 'part' THEN 'second' ELSE 'date' END AS "precision" FROM prints""")
def s09m(t):
    actual = prints(t)
    rows = publish.build_manifest(actual, metadata(actual), previous_manifest(actual), "batch-2", "2026-02-01T00:00:00Z")
    return rows.select("source", "rows", "digest", "provenance", "batch_id", "precision")


@query("s10_check_fingerprint", """
SELECT source, CASE source WHEN 'orders' THEN 'row count differs,digest differs' WHEN 'customer' THEN 'bad timestamp,missing provenance'
  WHEN 'part' THEN 'not in manifest' ELSE 'source missing' END AS reasons FROM prints""")
def s10(t):
    actual = prints(t)
    manifest = publish.build_manifest(actual, metadata(actual).withColumn("source", F.col("source")), None, "batch-1", "2026-02-01T00:00:00Z") \
        .where("source <> 'part'") \
        .withColumn("rows", F.when(F.col("source") == "orders", F.col("rows") + 1).otherwise(F.col("rows"))) \
        .withColumn("digest", F.when(F.col("source") == "orders", F.lit("0")).otherwise(F.col("digest"))) \
        .withColumn("provenance", F.when(F.col("source") != "customer", F.col("provenance")))
    return publish.check_fingerprint(manifest.withColumn("source_name", F.lit("x")).withColumn("status", F.lit("canonical")),
                                     actual.where("source <> 'lineitem'"))


@query("s11_publish_if_valid", "SELECT season, entity, wins FROM es")
def s11(t):
    root = publish.workspace(t.spark, "published")
    seasons = px.entity_seasons(t).select("season", "entity", "wins")
    publish.publish_if_valid({"seasons": seasons, "context": px.context(t)}, root, {
        "wins within schedule": lambda f: f["seasons"].join(f["context"], "season").where("wins > denom")})
    return publish.read_current(t.spark, root, "seasons")


@query("s12_write_sharded", """
SELECT season, count(*) AS rows, CAST(sum(good) AS BIGINT) AS good FROM totals WHERE entity IN (SELECT entity FROM wins) GROUP BY season""")
def s12(t):
    path = publish.workspace(t.spark, "shards")
    tables.write_sharded(px.entity_event(t), px.wins(t).select("entity"), ["entity"], "season", path)
    return t.spark.read.parquet(path).groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.sum("good").alias("good"))
