"""Queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands, stats, text, values, weights
from ..operators import scoring
from . import proxies as px
from .registry import Tables, cte, query

NAME_ALIASES = {"red ring (brand#5)": "red ring", "small bolt": "tiny bolt"}
TITLE_ALIASES = {"economy and red ring": "budget red ring"}


def names(t: Tables) -> DataFrame:
    return t("part").selectExpr(
        "p_partkey AS id",
        "CASE p_partkey % 3 WHEN 0 THEN '  ' || upper(p_name) || ' (' || p_brand || ') '"
        " WHEN 1 THEN p_name || ' (alt) x' ELSE p_name END AS name",
        "p_type || '_' || p_type || ' & ' || p_name || ' ' || split_part(p_name, ' ', 2) AS title",
        "p_name || ' (' || p_brand || ')/' || p_type AS page")


cte("names", """
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '  ' || upper(p_name) || ' (' || p_brand || ') '
         WHEN 1 THEN p_name || ' (alt) x' ELSE p_name END AS name,
       p_type || '_' || p_type || ' & ' || p_name || ' ' || split_part(p_name, ' ', 2) AS title,
       p_name || ' (' || p_brand || ')/' || p_type AS page
FROM part""")
cte("keyed", r"""
SELECT id, name, lower(trim(name)) AS raw,
       trim(regexp_replace(lower(trim(name)), '\s*\(.*?\)\s*', '', 'g')) AS base FROM names""")


@query("f01_entity_key", r"""
SELECT id, trim(regexp_replace(name, '\s*\(.*?\)\s*', '', 'g')) AS bare,
       CASE WHEN raw = 'red ring (brand#5)' THEN 'red ring' WHEN raw = 'small bolt' THEN 'tiny bolt'
            WHEN raw LIKE '%(%' AND raw LIKE '%)%' THEN raw
            WHEN base = 'small bolt' THEN 'tiny bolt' WHEN base = 'red ring (brand#5)' THEN 'red ring'
            ELSE base END AS key
FROM keyed""")
def f01(t):
    return names(t).select("id", text.strip_paren(F.col("name")).alias("bare"),
                           text.entity_key(F.col("name"), NAME_ALIASES).alias("key"))


@query("f02_compact_key", r"""
SELECT id, regexp_replace(lower(trim(regexp_replace(name, '\s*\(.*?\)\s*', '', 'g'))), '[^a-z0-9]+', '', 'g') AS stripped,
       regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS plain,
       regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g') AS any_letter FROM names""")
def f02(t):
    c = F.col("name")
    return names(t).select("id", text.compact_key(c).alias("stripped"), text.compact_key(c, "plain").alias("plain"),
                           text.compact_key(c, "unicode").alias("any_letter"))


@query("f03_title_key", r"""
WITH w AS (SELECT id, string_split(trim(regexp_replace(lower(replace(replace(title, '_', ' '), '&', 'and')),
                     '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM names),
k AS (SELECT id, array_to_string(list_filter(words, lambda x, i: i = 1 OR x <> words[i - 1]), ' ') AS key FROM w)
SELECT id, CASE WHEN key = 'economy and red ring' THEN 'budget red ring' ELSE key END AS key FROM k""")
def f03(t):
    return names(t).select("id", text.title_key(F.col("title"), TITLE_ALIASES).alias("key"))


@query("f04_slug", r"""
SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
       regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS short_slug FROM names""")
def f04(t):
    return names(t).select("id", text.slug(F.col("name")).alias("slug"), text.slug(F.col("name"), "").alias("short_slug"))


@query("f05_url_for", """
SELECT id, 'https://example.org/' || replace(url_encode(replace(page, ' ', '_')), '%2F', '/') AS url FROM names""")
def f05(t):
    return names(t).select("id", text.url_for("https://example.org/", F.col("page")).alias("url"))


def known_names(t):
    return t("part").selectExpr(
        "CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_partkey || ' (' || p_brand || ')'"
        " WHEN 1 THEN upper(p_name) || ' ' || (p_partkey % 300) ELSE p_name || ' ' || (p_partkey % 300) END AS name").distinct()


def asked_names(t):
    return t("part").selectExpr(
        "p_partkey AS id",
        "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' ' || p_partkey WHEN 1 THEN ' ' || p_name || ' ' || (p_partkey % 300)"
        " WHEN 2 THEN p_name || ' ' || (p_partkey % 300) || ' (x)' ELSE p_name || ' ' || (p_partkey % 300) END AS query")


@query("f06_unique_lookup", r"""
WITH known AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_partkey || ' (' || p_brand || ')'
     WHEN 1 THEN upper(p_name) || ' ' || (p_partkey % 300) ELSE p_name || ' ' || (p_partkey % 300) END AS name FROM part),
asked AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' ' || p_partkey
     WHEN 1 THEN ' ' || p_name || ' ' || (p_partkey % 300) WHEN 2 THEN p_name || ' ' || (p_partkey % 300) || ' (x)'
     ELSE p_name || ' ' || (p_partkey % 300) END AS query FROM part),
lo AS (SELECT lower(trim(name)) AS k, min(name) AS v FROM known GROUP BY 1 HAVING count(DISTINCT name) = 1),
ba AS (SELECT lower(trim(regexp_replace(name, '\s*\(.*?\)\s*', '', 'g'))) AS k, min(name) AS v FROM known GROUP BY 1
       HAVING count(DISTINCT name) = 1)
SELECT id, query, coalesce(known.name, lo.v, CASE WHEN NOT regexp_matches(query, '\([^)]*\)') THEN ba.v END) AS resolved
FROM asked LEFT JOIN known ON trim(query) = known.name LEFT JOIN lo ON lower(trim(query)) = lo.k
LEFT JOIN ba ON lower(trim(regexp_replace(trim(query), '\s*\(.*?\)\s*', '', 'g'))) = ba.k""")
def f06(t):
    return text.canonical_names(known_names(t), asked_names(t))


def places(t):
    return t("orders").selectExpr(
        "o_orderkey AS id", "CAST(o_custkey % 20 + 1 AS INT) AS a", "CAST(o_custkey % 4 + 1 AS INT) AS b").selectExpr(
        "id", "CASE id % 7 WHEN 0 THEN CAST(a AS STRING) WHEN 1 THEN a || '-' || (a + b) WHEN 2 THEN '>' || a"
        " WHEN 3 THEN a || '-' || (a + b) || '*' WHEN 4 THEN 'DNS' WHEN 5 THEN a || ' - ' || (a + b) ELSE '' END AS place",
        "CASE WHEN id % 3 = 0 THEN CAST(a + 1 AS STRING) END AS number")


cte("places", """
SELECT id, CASE id % 7 WHEN 0 THEN CAST(a AS VARCHAR) WHEN 1 THEN a || '-' || (a + b) WHEN 2 THEN '>' || a
   WHEN 3 THEN a || '-' || (a + b) || '*' WHEN 4 THEN 'DNS' WHEN 5 THEN a || ' - ' || (a + b) ELSE '' END AS place,
   CASE WHEN id % 3 = 0 THEN CAST(a + 1 AS VARCHAR) END AS number
FROM (SELECT o_orderkey AS id, CAST(o_custkey % 20 + 1 AS INTEGER) AS a, CAST(o_custkey % 4 + 1 AS INTEGER) AS b FROM orders)""")
cte("parsed", r"""
SELECT id, place, number, replace(place, '*', '') AS p, try_cast(number AS INTEGER) AS n,
  try_cast(regexp_extract(replace(place, '*', ''), '^(\d+)\s*-\s*(\d+)$', 1) AS INTEGER) AS lo,
  try_cast(regexp_extract(replace(place, '*', ''), '^(\d+)\s*-\s*(\d+)$', 2) AS INTEGER) AS hi,
  try_cast(regexp_extract(replace(place, '*', ''), '^>(\d+)$', 1) AS INTEGER) AS beyond,
  try_cast(regexp_extract(replace(place, '*', ''), '^(\d+)$', 1) AS INTEGER) AS plain FROM places""")


@query("f07_place", """
SELECT id, coalesce(lo + hi, 2 * (beyond + 1), 2 * plain, 2 * n) AS place_x2,
       coalesce(n, lo, beyond + 1, plain) AS place_number, place NOT IN ('DNS', '') AS is_result FROM parsed""")
def f07(t):
    p, n = F.col("place"), F.col("number")
    return places(t).select("id", values.place_x2(p, n).alias("place_x2"), values.place_number(p, n).alias("place_number"),
                            values.is_result(p).alias("is_result"))


@query("f08_lenient_place", r"""
SELECT id, CASE WHEN place LIKE '%*%' THEN NULL ELSE coalesce(CAST(plain AS DOUBLE), (lo + hi) / 2.0, beyond + 1.0) END AS midpoint,
  CASE WHEN n IS NOT NULL THEN CAST(n AS DOUBLE) WHEN place LIKE '%*%' THEN NULL
       ELSE coalesce(CAST(plain AS DOUBLE), (lo + hi) / 2.0, beyond + 1.0) END AS number_first,
  CAST(coalesce(n, try_cast(trim(split_part(place, '-', 1)) AS INTEGER)) AS DOUBLE) AS head FROM parsed""")
def f08(t):
    p, n = F.col("place"), F.col("number")
    return places(t).select("id", *[values.lenient_place(p, n, s).alias(s) for s in ("midpoint", "number_first", "head")])


@query("f09_typed_values", r"""
SELECT o_orderkey AS id, CASE WHEN regexp_full_match(i, '-?\d+') THEN CAST(i AS BIGINT) END AS int_value,
  try_cast(f AS DOUBLE) AS float_value,
  CASE WHEN lower(b) IN ('1','true','t','yes','y','win','won') THEN TRUE
       WHEN lower(b) IN ('0','false','f','no','n','loss','lost') THEN FALSE END AS bool_value
FROM (SELECT o_orderkey, replace(CASE o_orderkey % 4 WHEN 0 THEN '1,' || (100 + o_custkey % 900) WHEN 1 THEN '-' || o_custkey
   WHEN 2 THEN '1.5' ELSE 'n/a' END, ',', '') AS i,
   CASE o_orderkey % 3 WHEN 0 THEN '1.25' WHEN 1 THEN '' ELSE 'x' END AS f,
   trim(CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' LOST' WHEN 2 THEN '1' WHEN 3 THEN 'f' WHEN 4 THEN 'maybe' ELSE '' END) AS b FROM orders)""")
def f09(t):
    raw = t("orders").selectExpr(
        "o_orderkey AS id",
        "CASE o_orderkey % 4 WHEN 0 THEN '1,' || (100 + o_custkey % 900) WHEN 1 THEN '-' || o_custkey WHEN 2 THEN '1.5' ELSE 'n/a' END AS i",
        "CASE o_orderkey % 3 WHEN 0 THEN '1.25' WHEN 1 THEN '' ELSE 'x' END AS f",
        "CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' LOST' WHEN 2 THEN '1' WHEN 3 THEN 'f' WHEN 4 THEN 'maybe' ELSE '' END AS b")
    return raw.select("id", values.to_int(F.col("i")).alias("int_value"), values.to_float(F.col("f")).alias("float_value"),
                      values.to_bool(F.col("b")).alias("bool_value"))


@query("f10_parse_money", r"""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL
   ELSE CAST((CAST(floor(o_totalprice) AS INTEGER) // 1000) || lpad(CAST(CAST(floor(o_totalprice) AS INTEGER) % 1000 AS VARCHAR), 3, '0') AS BIGINT) END AS amount
FROM orders""")
def f10(t):
    money = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE concat('$', CAST(floor(o_totalprice) AS INT) div 1000, ',',"
                   " lpad(CAST(CAST(floor(o_totalprice) AS INT) % 1000 AS STRING), 3, '0'), ' USD') END")
    return t("orders").select(F.col("o_orderkey").alias("id"), values.parse_money(money).alias("amount"))


@query("f11_mode_split", """
SELECT l_returnflag AS flag, CASE WHEN l_returnflag = 'N' THEN 'respawn' ELSE 'snd' END AS split, count(*) AS maps
FROM lineitem GROUP BY 1, 2""")
def f11(t):
    label = F.expr("CASE l_returnflag WHEN 'R' THEN 'Search & Destroy' WHEN 'A' THEN 'Search and Destroy' ELSE 'Hardpoint' END")
    return (t("lineitem").select(F.col("l_returnflag").alias("flag"), values.split_of(label).alias("split"))
            .groupBy("flag", "split").agg(F.count(F.lit(1)).alias("maps")))


def event_names(t):
    return px.played(t).selectExpr("season", "month", "event",
        "CASE month % 4 WHEN 0 THEN 'Call of Duty Championship ' || season WHEN 1 THEN 'Call of Duty World League Championship ' || season"
        " WHEN 2 THEN 'Call of Duty Championship ' || season || ' Finals' ELSE 'Open ' || season END AS name")


@query("f12_is_championship", r"""
SELECT event, month % 4 IN (0, 1) AND season >= 2000 AS is_championship FROM played""")
def f12(t):
    return event_names(t).select("event", text.is_championship(F.col("name")).alias("is_championship"))


def awards(t):
    """Awards given to suppliers: one candidate per order."""
    kinds = list(text.AWARD_TYPES) + ["Media Pick"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t("orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("entity"), kind.alias("kind"),
        F.expr("CASE o_custkey % 4 WHEN 0 THEN 'Call of Duty League/20' || lpad(CAST(o_custkey % 20 AS STRING), 2, '0') || ' Season'"
               " WHEN 1 THEN 'CWL/Stage ' || o_custkey % 3 WHEN 2 THEN 'Breaking Point Awards ' || year(o_orderdate)"
               " ELSE 'Call of Duty Championship 20' || lpad(CAST(o_custkey % 20 AS STRING), 2, '0') END").alias("page"),
        F.expr("CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'Call of Duty Championship 20' || lpad(CAST(o_custkey % 20 AS STRING), 2, '0') END").alias("event"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'Major' WHEN 'O' THEN 'Minor' ELSE 'Premier' END").alias("tier"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


cte("awards", """
SELECT o_orderkey AS id, o_custkey % 50 AS entity,
  (['Event MVP','Grand Finals MVP','Season MVP','Rookie of the Year','CDL First Team','CDL Second Team','CWL All-Star','Media Pick'])[o_orderkey % 8 + 1] AS kind,
  CASE o_custkey % 4 WHEN 0 THEN 'Call of Duty League/20' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') || ' Season'
     WHEN 1 THEN 'CWL/Stage ' || o_custkey % 3 WHEN 2 THEN 'Breaking Point Awards ' || year(o_orderdate)
     ELSE 'Call of Duty Championship 20' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') END AS page,
  CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'Call of Duty Championship 20' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') END AS event,
  CASE o_orderstatus WHEN 'F' THEN 'Major' WHEN 'O' THEN 'Minor' ELSE 'Premier' END AS tier,
  strftime(o_orderdate, '%Y-%m-%d') AS date
FROM orders""")
cte("typed_awards", r"""
SELECT *, CASE WHEN kind = 'Event MVP' AND regexp_full_match(CASE WHEN event = '' THEN page ELSE event END,
                'Call of Duty (World League |League )?Championship 20\d\d') THEN 'champs_mvp'
     ELSE CASE kind WHEN 'Event MVP' THEN 'event_mvp' WHEN 'Grand Finals MVP' THEN 'grand_finals_mvp' WHEN 'Season MVP' THEN 'season_mvp'
       WHEN 'Rookie of the Year' THEN 'rookie_of_the_year' WHEN 'CDL First Team' THEN 'cdl_first_team'
       WHEN 'CDL Second Team' THEN 'cdl_second_team' WHEN 'CWL All-Star' THEN 'cwl_all_star' END END AS award,
  page NOT LIKE '%Breaking Point Awards%' AND CASE
     WHEN kind IN ('Event MVP', 'Grand Finals MVP') THEN tier IN ('Major', 'Premier')
     WHEN kind IN ('Season MVP', 'Rookie of the Year', 'CDL First Team', 'CDL Second Team') THEN regexp_full_match(page, 'Call of Duty League/20\d\d Season')
     WHEN kind = 'CWL All-Star' THEN page LIKE 'CWL/%' ELSE FALSE END AS kept,
  coalesce(nullif(regexp_extract(page || ' ' || event, '(?:^|/)(20\d\d) Season\b', 1), ''),
           nullif(regexp_extract(page || ' ' || event, '\b(20\d\d)\b', 1), ''), substr(date, 1, 4)) AS year
FROM awards""")


def typed_awards(t):
    k, p, e = F.col("kind"), F.col("page"), F.col("event")
    return awards(t).select("*", text.award_type(k, e, p).alias("award"), text.keep_award(k, p, F.col("tier")).alias("kept"),
                            text.award_year(p, e, F.col("date")).alias("year"))


@query("f13_awards", "SELECT id, award, kept, year FROM typed_awards")
def f13(t):
    return typed_awards(t).select("id", "award", "kept", "year")


@query("f14_career_position", """
SELECT o.o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN s.b > s.a THEN
   least(greatest(date_diff('day', s.a, CAST(o_orderdate AS DATE)) / date_diff('day', s.a, s.b), 0.0), 1.0) END AS position
FROM orders o JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1) s
  ON o.o_custkey = s.o_custkey""")
def f14(t):
    orders = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    span = orders.groupBy("o_custkey").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return orders.join(span, "o_custkey").select(
        F.col("o_orderkey").alias("id"), F.year("d").alias("year"),
        values.career_position(F.col("a"), F.col("d"), F.col("b")).alias("position"))


@query("f15_step_multipliers", """
SELECT o_orderkey AS id, CASE WHEN v >= 50 THEN 1.3 WHEN v >= 25 THEN 1.2 WHEN v >= 10 THEN 1.1 WHEN v >= 3 THEN 1.05 ELSE 1.0 END::DOUBLE AS votes,
  CASE o_custkey % 4 WHEN 0 THEN 1.2 WHEN 1 THEN 1.15 WHEN 2 THEN 0.9 ELSE 1.0 END::DOUBLE AS timing,
  CASE o_custkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 WHEN 4 THEN 0.3 ELSE 1.0 END::DOUBLE AS season
FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 60 END AS v FROM orders)""")
def f15(t):
    timing = F.element_at(F.array(*[F.lit(x) for x in [*weights.TIMING, "unknown"]]), (F.col("o_custkey") % 4 + 1).cast("int"))
    season = F.element_at(F.array(*[F.lit(x) for x in [*weights.SEASON_COVERAGE, "unknown"]]), (F.col("o_custkey") % 6 + 1).cast("int"))
    votes = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 60)
    return t("orders").select(F.col("o_orderkey").alias("id"), weights.vote_multiplier(votes).alias("votes"),
                              weights.timing_multiplier(timing).alias("timing"),
                              weights.season_coverage_multiplier(season).alias("season"))


@query("f16_reception", """
SELECT o_orderkey AS id, round(CASE WHEN s > 0 THEN least(1.25, greatest(0.75, 1 + 0.25 * ln(1 + s) / ln(1 + 40.0)))
   WHEN s < 0 THEN least(1.25, greatest(0.75, 1 - 0.25 * ln(1 - s) / ln(1 + 50.0))) ELSE 1.0 END, 6) AS weight
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS INTEGER) % 101 - 50 AS s FROM orders)""")
def f16(t):
    s = F.expr("CAST(floor(o_totalprice) AS INT) % 101 - 50")
    return t("orders").select(F.col("o_orderkey").alias("id"),
                              F.round(weights.reception_raw(s, F.lit(40), F.lit(50)), 6).alias("weight"))


@query("f17_rank_points", """
SELECT l_orderkey AS id, l_linenumber AS line, count(*) AS n, CAST(8 - l_linenumber AS DOUBLE) / 7.0 AS ballot,
       round(pow(greatest(0.0, (31 - l_linenumber) / 30.0), 2.5), 6) AS season FROM lineitem GROUP BY 1, 2""")
def f17(t):
    line = F.col("line")
    return (t("lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("ballot", weights.ballot_points(line, F.lit(7)))
            .withColumn("season", F.round(weights.season_points(line), 6)))


@query("f18_bands", """
SELECT diff_band, ratio_band, label, association, count(*) AS n FROM (
SELECT CASE WHEN good - bad <= -20 THEN '-20 or worse' WHEN good - bad <= -10 THEN '-19 to -10' WHEN good < bad THEN '-9 to -1'
   WHEN good = bad THEN 'Tied (0)' WHEN good - bad < 10 THEN '+1 to +9' WHEN good - bad < 20 THEN '+10 to +19' ELSE '+20 or better' END AS diff_band,
 CASE WHEN bad = 0 THEN 'No deaths' WHEN good = bad THEN 'Exactly 1.00' WHEN good / bad < 0.8 THEN 'Below 0.80' WHEN good / bad < 1 THEN '0.80–0.99'
   WHEN good / bad < 1.2 THEN '1.01–1.19' ELSE '1.20+' END AS ratio_band,
 CASE WHEN good < 10 THEN 'very small sample' WHEN good < 25 THEN 'small sample' ELSE 'descriptive' END AS label,
 CASE WHEN bad % 5 < 2 THEN 'unavailable — no outcome variation' WHEN bad % 7 < 2 THEN 'unavailable — no K/D variation'
   WHEN good < 10 THEN 'unstable — very small sample' WHEN good < 25 THEN 'unstable — small sample' ELSE 'descriptive — larger sample' END AS association
FROM obs) GROUP BY ALL""")
def f18(t):
    g, b = F.col("good"), F.col("bad")
    return px.obs(t, opponent=False).select(
        bands.difference_band(g - b).alias("diff_band"), bands.ratio_band(g, b).alias("ratio_band"),
        bands.sample_label(g).alias("label"), bands.association_label(g, b % 5, b % 7).alias("association")) \
        .groupBy("diff_band", "ratio_band", "label", "association").agg(F.count(F.lit(1)).alias("n"))


@query("f19_fisher_interval", """
SELECT id, round(CASE WHEN n >= 4 AND abs(r) < 1 THEN tanh(atanh(r) - 1.96 / sqrt(n - 3)) END, 6) AS low,
       round(CASE WHEN n >= 4 AND abs(r) < 1 THEN tanh(atanh(r) + 1.96 / sqrt(n - 3)) END, 6) AS high
FROM (SELECT o_orderkey AS id, (o_custkey % 21 - 10) / 10.0 AS r, 3 + o_custkey % 30 AS n FROM orders
      WHERE abs((o_custkey % 21 - 10) / 10.0) < 1
      UNION ALL SELECT o_orderkey, NULL, 3 FROM orders WHERE abs((o_custkey % 21 - 10) / 10.0) >= 1)""")
def f19(t):
    r, n = F.expr("(o_custkey % 21 - 10) / 10.0D"), F.expr("3 + o_custkey % 30")
    return t("orders").select(F.col("o_orderkey").alias("id"), F.round(stats.fisher_bound(r, n, -1), 6).alias("low"),
                              F.round(stats.fisher_bound(r, n, 1), 6).alias("high"))


@query("f20_safe_ratio", "SELECT entity, CASE WHEN sum(bad % 2) = 0 THEN NULL ELSE CAST(sum(good) AS DOUBLE) / sum(bad % 2) END AS ratio FROM obs GROUP BY entity")
def f20(t):
    return px.obs(t, opponent=False).groupBy("entity").agg(values.ratio(F.sum("good"), F.sum(F.col("bad") % 2)).alias("ratio"))


@query("f21_average_place", """
SELECT entity, ((sum(2 * place) * 100 + count(*)) // (2 * count(*))) / 100.0::DOUBLE AS average_place FROM placement GROUP BY entity""")
def f21(t):
    return px.placement(t).groupBy("entity").agg(
        values.average_from_x2(F.sum(F.col("place") * 2), F.count(F.lit(1))).alias("average_place"))


@query("f22_markup_cells", r"""
WITH r AS (SELECT page_id, unnest(string_split(html, '<li>')) AS raw, generate_subscripts(string_split(html, '<li>'), 1) - 1 AS row_no FROM pages),
c AS (SELECT page_id, row_no, unnest(string_split(raw, '</a>')) AS raw, generate_subscripts(string_split(raw, '</a>'), 1) - 1 AS cell_no FROM r)
SELECT page_id, CAST(row_no AS INTEGER) AS row_no, CAST(cell_no AS INTEGER) AS cell_no,
  trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(trim(raw), '^\|\s*', ''),
    '^(?:[A-Za-z-]+=(?:"[^"]*"|[^|\s]+)\s*)+\|\s*', ''), '''''''', ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS cell FROM c""")
def f22(t):
    return text.table_cells(t("pages"), "html", ["page_id"], "<li>", "</a>").select("page_id", "row_no", "cell_no", "cell")


# The places of columns in the two kinds of career tables.
LAYOUTS = [
    text.Layout("placed", 17, 1, {"team": 2}, {"placing": 3, "maps": 4, "kd": 5, "rate": 6},
                {"mode_maps": {"A": 7, "B": 10, "C": 13}, "mode_kd": {"A": 8, "B": 11, "C": 14}}),
    text.Layout("dated", 21, 1, {"date": 0, "team": 2}, {"maps": 3, "kd": 4, "rate": 5},
                {"mode_maps": {"A": 6, "B": 10, "C": 14, "D": 17}, "mode_kd": {"A": 7, "B": 11, "C": 15, "D": 18}})]
ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_quantity", "l_tax", "l_discount"]
GENERIC = {"team": 1, "maps": 2, "kd": 3, "rate": 4}


def written_tables(t):
    """Career tables as markup, one per supplier, of three forms: wide rows of two kinds and narrow ones; some rows without a link or too short."""
    filler = lambda n: "repeat(' || -', %d)" % n
    link = "'[[Ev_' || l_partkey % 50 || if(l_orderkey % 2 = 0, '|Event ' || l_partkey % 50, '') || ']]'"
    number = "if(l_quantity = 7, '-', cast(cast(l_quantity as int) as string))"
    wide = ("'| ' || {first} || ' || ' || " + link + " || ' || Team ' || l_linenumber || ' || ' || {own}" + f"{number} || ' || ' || l_tax || ' || <b>' || l_discount || '</b>'")
    placed = wide.format(first="'1'", own="if(l_linenumber = 1, 'N/A', cast(l_linenumber as string)) || ' || ' || ") + " || ' || ' || l_linenumber" + " || " + filler(10)
    dated = wide.format(first="l_shipdate", own="") + " || ' || ' || l_linenumber || ' || 0.5' || " + filler(14)
    narrow = f"'| ' || if(l_linenumber % 2 = 0, {link}, l_shipdate || ' || ' || {link}) || ' || Team ' || l_linenumber || ' || ' || {number} || ' || ' || l_tax || ' || ' || l_discount || ' || x'"
    row = f"CASE WHEN l_orderkey % 11 = 0 THEN '| too || short' WHEN l_orderkey % 13 = 0 THEN '| a || b || c || d || e || f || g' " \
          f"WHEN l_orderkey % 3 = 0 THEN {narrow} WHEN l_suppkey % 2 = 0 THEN {placed} ELSE {dated} END"
    rows = t("lineitem").select("l_suppkey", "l_orderkey", *ORDER, F.expr(row).alias("row"))
    return rows.groupBy("l_suppkey", "l_orderkey").agg(
        F.concat(F.lit("{| class=\"wikitable\"\n|-\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*ORDER, "row"))), lambda r: r["row"]), "\n|-\n"),
                 F.lit("\n|-\n|}")).alias("text")).withColumn("kind", F.expr("if(l_suppkey % 2 = 0, 'placed', 'dated')"))


@query("f22_table_records", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_quantity, l_tax, l_discount) AS row_no,
  l_orderkey % 3 = 0 AS narrow, l_suppkey % 2 = 0 AS placed FROM lineitem)
SELECT l_suppkey, l_orderkey, CAST(row_no AS INTEGER) AS row_no,
  CASE WHEN l_orderkey % 2 = 0 THEN 'Event ' || l_partkey % 50 ELSE 'Ev ' || l_partkey % 50 END AS event, 'Ev ' || l_partkey % 50 AS event_target, 'Team ' || l_linenumber AS team,
  CASE WHEN narrow THEN CASE WHEN l_linenumber % 2 <> 0 THEN CAST(l_shipdate AS VARCHAR) END WHEN NOT placed THEN CAST(l_shipdate AS VARCHAR) END AS date,
  CASE WHEN NOT narrow AND placed AND l_linenumber <> 1 THEN CAST(l_linenumber AS DOUBLE) END AS placing,
  CASE WHEN l_quantity <> 7 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS maps, CAST(l_tax AS DOUBLE) AS kd, CAST(l_discount AS DOUBLE) AS rate,
  CASE WHEN NOT narrow THEN CAST(l_linenumber AS DOUBLE) END AS mode_a_maps, CASE WHEN NOT narrow AND NOT placed THEN 0.5::DOUBLE END AS mode_a_kd,
  CASE WHEN narrow THEN 0 WHEN placed THEN 3 ELSE 4 END AS modes
FROM r WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0""")
def f22r(t):
    found = text.table_records(written_tables(t), "text", "kind", ["l_suppkey", "l_orderkey"], LAYOUTS, GENERIC)
    return found.select("l_suppkey", "l_orderkey", "row_no", "event", "event_target", "team", "date", "placing", "maps", "kd", "rate",
                        F.try_element_at("mode_maps", F.lit("A")).alias("mode_a_maps"), F.try_element_at("mode_kd", F.lit("A")).alias("mode_a_kd"),
                        F.size("mode_maps").alias("modes"))


@query("f23_era_dimension", """
SELECT season, CASE WHEN pre_epoch THEN 'early' WHEN season >= 2000 THEN 'late' ELSE 'middle' END AS selection_id FROM ctx
UNION ALL SELECT season, 'all' FROM ctx UNION ALL SELECT season, 'post' FROM ctx WHERE NOT pre_epoch""")
def f23(t):
    return era_selection(px.context(t))


def era_selection(context: DataFrame) -> DataFrame:
    return scoring.era_selection(context, late_from=2000)
