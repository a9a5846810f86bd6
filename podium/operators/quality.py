"""Source quality: identity, duplicates, conflicts, reconciliation, completeness, claims.

Every check returns the offending rows; ``fail_if_any`` turns a non-empty result into an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, compact_key, entity_key, strip_paren
from ..plans.ordered import join_null_safe, prefix_counts
from ..plans.sizing import broadcast_if_small, pin

# Facts an observation must carry, the fields that identify it, and the group shape rules.
REQUIRED_FIELDS = ["event", "season", "mode", "date", "team", "team_vs", "map", "series", "good", "bad"]
BASE_FIELDS = ["entity", "event", "date", "series", "map", "mode", "team", "team_vs"]
UPSTREAM_PREFIX, DERIVED_PREFIX, DERIVED_LENGTH = "wiki:", "derived:", 24
GROUP_ROWS, TEAM_ROWS, TEAMS = 8, 4, 2


class ConflictError(RuntimeError):
    """Raised when unresolved conflicts remain."""


def first_violations(violations: DataFrame, id_col: str = "id", n: int = 5) -> DataFrame:
    """The first few violation ids; each task keeps n rows, so nothing large reaches the driver."""
    return violations.select(F.col(id_col).cast("string").alias("id")).orderBy("id").limit(n)


def fail_if_any(violations: DataFrame, label: str, id_col: str = "id") -> None:
    """Stop the job when there is any violation, naming the first five."""
    first = [r[0] for r in first_violations(violations, id_col).collect()]
    if first:
        raise ConflictError(f"{label}: {', '.join(first)}")


def event_registry(frames: Sequence[DataFrame], drop_seasons: Sequence = (), drop_events: Sequence = ()) -> DataFrame:
    """Distinct (season, event, event_id) facts of all frames, blank and excluded rows left out."""
    facts = None
    for f in frames:
        part = f.select("season", "event", "event_id")
        facts = part if facts is None else facts.unionByName(part)
    facts = facts.where("season IS NOT NULL AND event <> '' AND event_id <> ''")
    if drop_seasons:
        facts = facts.where(~F.col("season").isin(list(drop_seasons)))
    if drop_events:
        facts = facts.where(~F.col("event").isin(list(drop_events)))
    return facts.distinct()


def registry_conflicts(registry: DataFrame) -> DataFrame:
    """Names with two ids and ids with two names, with the competing values counted."""
    def clash(key: str, other: str, kind: str) -> DataFrame:
        return (registry.groupBy("season", key)
                .agg(F.count_distinct(other).alias("n"), F.min(other).alias("first"), F.max(other).alias("last"))
                .where("n > 1").select(F.lit(kind).alias("kind"), "season", F.col(key).alias("key"), "n", "first", "last"))
    return clash("event", "event_id", "event name has several ids").unionByName(
        clash("event_id", "event", "event id has several names"))


def attach_event_id(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Own id, else the registered id of the name, else the name; and the canonical name of the id."""
    by_name = registry.groupBy("season", "event").agg(F.min("event_id").alias("_id"))
    by_id = registry.groupBy("season", "event_id").agg(F.min("event").alias("event_name"))
    return (df.join(broadcast_if_small(by_name), ["season", "event"], "left")
            .withColumn("event_id", F.coalesce(blank_to_null(F.col("event_id")), "_id", "event")).drop("_id")
            .join(broadcast_if_small(by_id), ["season", "event_id"], "left")
            .withColumn("event_name", F.coalesce("event_name", blank_to_null(F.col("event")), "event_id")))


def signature(columns: Sequence[str]) -> Column:
    """Canonical text of a row's content, independent of column order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def observation_id(df: DataFrame, id_col: str = "stat_id", base: Sequence[str] = BASE_FIELDS) -> DataFrame:
    """Stable identity: the upstream id, else a hash of the base fields and an occurrence number.

    The occurrence is the rank of the row's content among the distinct contents that share the
    base fields, so it does not depend on row order.
    """
    sig = signature(df.columns)
    df = pin(df)  # read three times
    upstream = blank_to_null(F.col(id_col).cast("string"))
    base_text = F.to_json(F.array(*[F.coalesce(F.lower(F.col(c).cast("string")) if c == "entity" else F.col(c).cast("string"),
                                               F.lit("")) for c in base]))
    rows = df.withColumn("_up", upstream).withColumn("_hash", F.xxhash64(base_text))
    # Base fields with one content only need no rank; hashes leave a few too many, which are ranked like the rest.
    sums = rows.where("_up IS NULL").select("_hash", F.xxhash64(sig).alias("_x"), F.hash(sig).alias("_m"))
    several = pin(sums.groupBy("_hash").agg(F.min("_x").alias("a"), F.max("_x").alias("b"), F.min("_m").alias("c"), F.max("_m").alias("d"))
                  .where("a <> b OR c <> d").select("_hash"))
    contents = pin(rows.where("_up IS NULL").join(several, "_hash", "left_semi").select(F.sha2(base_text, 256).alias("_base"), sig.alias("_order")).distinct())
    ranked = prefix_counts(contents, ["_base"], [("_order", True)], dense=True).select(
        "_base", F.sha2("_order", 256).alias("_sig"), (F.col("n_before") + 1).alias("_rank"))
    ranked = pin(ranked)
    keyed = rows.join(several.withColumn("_several", F.lit(True)), "_hash", "left") \
        .withColumn("_base", F.when(F.col("_several"), F.sha2(base_text, 256))).withColumn("_sig", F.when(F.col("_several"), F.sha2(sig, 256)))
    joined = keyed.join(ranked, ["_base", "_sig"], "left").withColumn("_rank", F.coalesce("_rank", F.lit(1).cast("long")))
    occurrence = F.when(F.col("_up").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("_rank"))
    derived = F.concat(F.lit(DERIVED_PREFIX), F.substring(
        F.sha2(F.concat_ws("|", base_text, occurrence.cast("string")), 256), 1, DERIVED_LENGTH))
    return (joined.withColumn("occurrence", occurrence)
            .withColumn("observation_id", F.when(F.col("_up").isNotNull(), F.concat(F.lit(UPSTREAM_PREFIX), "_up"))
                        .otherwise(derived))
            .drop("_sig", "_base", "_hash", "_several", "_up", "_rank"))


def observation_conflicts(df: DataFrame, id_col: str = "stat_id", required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """(kind, key, n) of missing fields, missing entities, exact duplicates and reused upstream ids."""
    sig = F.sha2(signature(df.columns), 256)
    rows = df.withColumn("_sig", sig).withColumn("_up", blank_to_null(F.col(id_col).cast("string")))
    missing = F.array_compact(F.array(
        *[F.when(blank_to_null(F.col(c).cast("string")).isNull(), F.lit(f"missing required field {c}")) for c in required],
        F.when(blank_to_null(F.col("entity").cast("string")).isNull(), F.lit("missing entity"))))
    absent = rows.select(F.explode(missing).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")) \
        .select("kind", F.lit("").alias("key"), "n")
    copies = rows.where("_up IS NULL").groupBy("_sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select(F.lit("exact duplicate without an upstream id").alias("kind"), F.col("_sig").alias("key"), "n")
    reused = (rows.where("_up IS NOT NULL").groupBy(F.col("_up").alias("key"))
              .agg(F.count(F.lit(1)).alias("n"), F.min("_sig").alias("a"), F.max("_sig").alias("b")).where("n > 1")
              .select(F.when(F.col("a") == F.col("b"), "exact duplicate of an upstream id")
                      .otherwise("conflicting facts for an upstream id").alias("kind"), "key", "n"))
    return absent.unionByName(copies).unionByName(reused)


def best_fact(df: DataFrame, decisions: DataFrame | None = None, key: Sequence[str] = ("entity", "event")) -> DataFrame:
    """One placement per key: the best; tied best rows of different teams need a reviewed decision.

    decisions(key..., chosen_team, rationale, evidence, reviewed_at).  The result has
    ``status``: ``single``, ``decided``, ``conflict`` or ``unparseable``; conflicting keys keep no team.
    """
    per = df.groupBy(*key).agg(
        F.count_if(F.col("place_x2").isNull()).alias("_bad"), F.min("place_x2").alias("place_x2"), F.count(F.lit(1)).alias("facts"))
    tied = df.join(per.select(*key, F.col("place_x2")), [*key, "place_x2"])
    teams = tied.groupBy(*key).agg(F.count_distinct("team").alias("n_teams"), F.min("team").alias("team"),
                                   F.count(F.lit(1)).alias("tied"))
    out = per.join(teams, list(key), "left")
    if decisions is None:
        out = out.withColumn("_chosen", F.lit(None).cast(df.schema["team"].dataType)).withColumn("_hits", F.lit(0)) \
                 .withColumn("_complete", F.lit(False))
    else:
        filled = F.lit(True)
        for c in ("rationale", "evidence", "reviewed_at"):
            filled = filled & blank_to_null(F.col(c)).isNotNull()
        chosen = decisions.select(*key, F.col("chosen_team").alias("_chosen"), filled.alias("_complete"))
        hits = tied.join(chosen, list(key)).where(F.col("team") == F.col("_chosen")).groupBy(*key).agg(F.count(F.lit(1)).alias("_hits"))
        out = out.join(chosen, list(key), "left").join(hits, list(key), "left")
    decided = (F.coalesce(F.col("_hits"), F.lit(0)) == 1) & F.coalesce("_complete", F.lit(False))
    status = (F.when(F.col("_bad") > 0, "unparseable").when(F.col("n_teams") == 1, "single")
              .when(decided, "decided").otherwise("conflict"))
    return (out.withColumn("status", status)
            .withColumn("team", F.when(F.col("status") == "single", F.col("team")).when(F.col("status") == "decided", F.col("_chosen")))
            .select(*key, "place_x2", "team", "facts", "tied", "status"))


def conflict_ledger(facts: DataFrame, resolved: DataFrame, registry_issues: DataFrame, competing: DataFrame,
                    policy: str = "participation") -> DataFrame:
    """Every multi-fact key and identity clash with its rule, resolution state, fact count and the competing facts.

    competing(entity, event, place_x2, team) are the single facts; an unreadable place is listed as a question mark."""
    told = competing.groupBy("entity", "event").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(
        "@", F.col("team").cast("string"), F.coalesce(F.col("place_x2").cast("string"), F.lit("?"))))), ",").alias("competing"))
    several = facts.where("facts > 1").join(told, ["entity", "event"], "left")
    rule = F.when(F.col("status").isin("conflict", "unparseable"), F.lit(None).cast("string")) \
            .when(F.col("tied") > 1, "explicitReviewedDecision").otherwise("bestPlacement")
    rows = several.select(
        F.concat_ws(":", F.lit("participation"), F.col("entity").cast("string"), "event").alias("id"),
        F.lit("participation").alias("subject"), rule.alias("rule"),
        F.when(rule.isNotNull(), F.lit(policy)).alias("policy"), (~F.col("status").isin("conflict", "unparseable")).alias("resolved"),
        F.col("facts").cast("long").alias("facts"), "competing")
    identity = registry_issues.select(
        F.concat_ws(":", F.lit("event-identity"), F.col("season").cast("string"), "key").alias("id"),
        F.lit("event").alias("subject"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("policy"),
        F.lit(False).alias("resolved"), F.col("n").cast("long").alias("facts"), F.lit(None).cast("string").alias("competing"))
    excluded = resolved.select(F.col("id"), F.lit("event").alias("subject"), F.lit("excludedBeforeIdentity").alias("rule"),
                               F.lit("exclusions").alias("policy"), F.lit(True).alias("resolved"), F.col("facts").cast("long").alias("facts"),
                               F.lit(None).cast("string").alias("competing"))
    return rows.unionByName(identity).unionByName(excluded)


def reconcile_winners(events: DataFrame, team_results: DataFrame) -> DataFrame:
    """Events without exactly one first-placed team, or whose stated winner is another team."""
    firsts = team_results.where("place = 1 AND team IS NOT NULL").groupBy("event").agg(
        F.count_distinct("team").alias("winners"), F.min("team").alias("team"))
    stated = compact_key(F.col("winner"))
    rows = events.join(firsts, "event", "left").withColumn("winners", F.coalesce("winners", F.lit(0).cast("long")))
    reason = (F.when(F.col("winners") != 1, "expected one winner")
              .when((stated != "") & (stated != compact_key(F.col("team"))), "stated winner differs"))
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("event", "winners", "winner", "reason")


def reconcile_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, with the side named."""
    tagged = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(2).alias("_s")))
    sides = tagged.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    return sides.where("_lo = _hi").select(*keys, F.when(F.col("_lo") == 1, "left_only").otherwise("right_only").alias("side"))


def require_subset(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key is missing in ``b`` (must be empty)."""
    return a.select(*keys).distinct().join(b, list(keys), "left_anti")


def ambiguous_names(names: DataFrame, listed: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Disambiguated names that are no alias but whose bare form is a listed entity."""
    raw = F.lower(F.trim(F.col("name")))
    bare = entity_key(strip_paren(F.col("name")), aliases)
    rows = names.select("name", bare.alias("key")).distinct() \
        .where((strip_paren(F.col("name")) != F.trim(F.col("name"))) & ~raw.isin(list(aliases)))
    return rows.join(listed.select(F.col("key")).distinct(), "key", "left_semi")


def reconstruction_check(derived: DataFrame, published: DataFrame) -> DataFrame:
    """Listed entities whose derived total differs from the published one (missing counts as zero)."""
    got = F.coalesce(F.col("derived"), F.lit(0))
    return (published.select("entity", "published").join(derived.select("entity", F.col("total").alias("derived")), "entity", "left")
            .withColumn("derived", got).where(F.col("derived") != F.col("published")))


def drift(live: DataFrame, published: DataFrame, newcomers: int = 10) -> DataFrame:
    """Listed entities whose live value moved or vanished, and the top unlisted ones at the list's floor."""
    moved = (published.join(live.select("entity", F.col("value").alias("live")), "entity", "left")
             .where(~F.col("live").eqNullSafe(F.col("published")))
             .select(F.lit("drift").alias("kind"), "entity", "published", "live"))
    floor = published.agg(F.min("published").alias("_floor"))
    fresh = (live.join(published, "entity", "left_anti").join(F.broadcast(floor), F.col("value") >= F.col("_floor"))  # one row
             .orderBy(F.desc("value"), F.desc("entity")).limit(newcomers)
             .select(F.lit("newcomer").alias("kind"), "entity", F.lit(None).cast("long").alias("published"), F.col("value").alias("live")))
    return moved.unionByName(fresh)


def group_violations(obs: DataFrame, key: Sequence[str], check_opponent: bool = True, group_rows: int = GROUP_ROWS,
                     team_rows: int = TEAM_ROWS) -> DataFrame:
    """Completeness of each map: all keys with their row count and comma-joined reasons ('' = valid).

    Two levels of pre-aggregation (map and team, then map), so a huge group is combined map-side.
    """
    team = F.coalesce(F.col("team").cast("string"), F.lit(""))
    per_team = obs.withColumn("team", team).groupBy(*key, "team").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("won").alias("wins"),
        F.min(F.col("team_vs").cast("string")).alias("vs_lo"), F.max(F.col("team_vs").cast("string")).alias("vs_hi"))
    entities = obs.groupBy(*key).agg(F.count_distinct("entity").alias("entities"))
    named = F.col("team") != ""
    per = per_team.groupBy(*key).agg(
        F.sum("rows").alias("rows"), F.sum("wins").alias("wins"), F.count_if(named).alias("named"), F.count(F.lit(1)).alias("teams"),
        F.count_if(named & (F.col("wins") > 0) & (F.col("wins") < F.col("rows"))).alias("mixed"),
        F.count_if(named & (F.col("rows") != team_rows)).alias("uneven"),
        F.min("team").alias("t_lo"), F.max("team").alias("t_hi"),
        F.min_by(F.struct("vs_lo", "vs_hi"), "team").alias("lo_vs"), F.max_by(F.struct("vs_lo", "vs_hi"), "team").alias("hi_vs"))
    two = (F.col("teams") == TEAMS) & (F.col("named") == TEAMS)
    resolves = (F.col("lo_vs.vs_lo").eqNullSafe(F.col("t_hi")) & F.col("lo_vs.vs_hi").eqNullSafe(F.col("t_hi"))
                & F.col("hi_vs.vs_lo").eqNullSafe(F.col("t_lo")) & F.col("hi_vs.vs_hi").eqNullSafe(F.col("t_lo")))
    checks = [(F.col("rows") != group_rows, "row count"), (F.col("entities") != F.col("rows"), "duplicate entity"),
              (~two, "teams"), (F.col("mixed") > 0, "inconsistent team result")]
    if check_opponent:
        checks += [(two & (F.col("uneven") > 0), "team size"), (two & ~resolves, "opponent")]
    else:
        checks += [((F.col("wins") != group_rows // 2) | (F.col("rows") - F.col("wins") != group_rows // 2), "win and loss rows")]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))
    return join_null_safe(per, entities, list(key)).select(*key, "rows", F.array_join(F.sort_array(reasons), ",").alias("reasons"))


def valid_groups(obs: DataFrame, violations: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the groups without a reason."""
    good = violations.where("reasons = ''").select(*[F.col(k).alias(f"_{k}") for k in key])
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return obs.join(good, cond, "left_semi")


def normalize_with_rejects(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Clean rows and counts per reject reason; a row is charged to the first rule it fails."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(list(rules)):
        reason = F.when(F.coalesce(failed, F.lit(True)), F.lit(name)).otherwise(reason)
    tagged = df.withColumn("_reason", reason)
    counts = tagged.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return tagged.where("_reason IS NULL").drop("_reason"), counts


def result_index(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """One result per key over all sources; ``contradictory`` keys carry both results."""
    facts = None
    for f in frames:
        part = f.where("won IS NOT NULL").select(*key, "won")
        facts = part if facts is None else facts.unionByName(part)
    return facts.groupBy(*key).agg(F.bool_or("won").alias("won"), (F.bool_or("won") != F.bool_and("won")).alias("contradictory"))


def enrich_results(obs: DataFrame, index: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Observations with a known result, and the distinct keys that have none."""
    joined = join_null_safe(obs.drop("won"), index.where("NOT contradictory").select(*key, "won"), list(key), "left")
    return joined.where("won IS NOT NULL"), joined.where("won IS NULL").select(*key).distinct()


def exclude_groups(df: DataFrame, key: Sequence[str], members: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of groups in which no listed member appears in any of ``columns``, and the dropped keys."""
    listed = members.select(F.col("member"))
    hit = None
    for c in columns:
        part = df.join(broadcast_if_small(listed), F.col(c) == F.col("member"), "left_semi").select(*key)
        hit = part if hit is None else hit.unionByName(part)
    hit = hit.distinct()
    return df.join(hit, list(key), "left_anti"), hit


def as_of_sums(claims: DataFrame, facts: DataFrame, filters: dict[str, str], measures: Sequence[str]) -> DataFrame:
    """(id, *measures): for each claim the sums of its entity's facts up to its date, under its lists of allowed values.

    claims(id, entity, as_of, lists...), facts(entity, date, dimensions..., measures); filters maps a claim's list column to the dimension it
    restricts, and a null list restricts nothing.  Facts become sums per day and claims one row per combination of listed values; both are
    lined up by date once and summed on, and a claim reads the sum at its place.  A key has one row a day and one per claim,
    so an entity with many facts and many claims costs their sum, not their product.  Undated facts count as earlier than any date.
    """
    lists, dims = list(filters), list(filters.values())
    first = F.lit("1900-01-01").cast("date")
    daily = facts.where(F.col("entity").isNotNull()).groupBy("entity", *dims, F.coalesce(F.col("date").cast("date"), first).alias("date")) \
        .agg(*[F.sum(m).alias(m) for m in measures])
    asked = claims.select("id", "entity", F.col("as_of").cast("date").alias("date"), *lists)
    latest = pin(asked.groupBy("entity").agg(F.max("date").alias("_latest")))
    daily = pin(daily.join(latest, "entity").where("date <= _latest").drop("_latest"))  # read for every combination of lists
    kinds = asked.select(*[F.col(c).isNull().alias(c) for c in lists]).distinct().collect()  # at most two to the number of lists
    lined = None
    for number, kind in enumerate(kinds):
        kept = [(c, d) for c, d in filters.items() if not kind[c]]
        names = [d for _, d in kept]
        any_value = [F.lit(None).cast(facts.schema[d].dataType).alias(d) for d in dims if d not in names]
        own = asked.where(" AND ".join([f"{c} IS {'NULL' if kind[c] else 'NOT NULL'}" for c in lists] or ["TRUE"]))
        known = daily.join(own.select("entity").distinct(), "entity", "left_semi")  # an entity's days go only where its claims are
        known = known.dropna(subset=names) if names else known
        days = known.groupBy("entity", *names, "date").agg(*[F.sum(m).alias(m) for m in measures]) \
            .select("entity", *names, *any_value, "date", *measures, F.lit(False).alias("asks"), F.lit(None).cast(claims.schema["id"].dataType).alias("id"))
        for c, d in kept:
            own = own.withColumn(d, F.explode(F.array_distinct(c)))
        own = own.select("entity", *[F.col(d).cast(facts.schema[d].dataType).alias(d) for d in names], *any_value, "date",
                         *[F.lit(None).cast(daily.schema[m].dataType).alias(m) for m in measures], F.lit(True).alias("asks"), "id")
        part = days.unionByName(own).withColumn("kind", F.lit(number))
        lined = part if lined is None else lined.unionByName(part)
    if lined is None:
        return claims.select("id", *[F.lit(0).cast("double").alias(m) for m in measures])
    so_far = W.partitionBy("kind", "entity", *dims).orderBy(F.col("date").asc_nulls_first(), "asks").rowsBetween(W.unboundedPreceding, 0)
    read = lined.select("id", "asks", *[F.sum(m).over(so_far).alias(m) for m in measures]).where("asks")
    sums = read.groupBy("id").agg(*[F.sum(m).alias(m) for m in measures])
    return claims.select("id").join(sums, "id", "left").select("id", *[F.coalesce(F.col(m), F.lit(0)).cast("double").alias(m) for m in measures])


def audit_claims(claims: DataFrame, wins: DataFrame, placements: DataFrame, observations: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Compare each claimed number with the tables, as of the claim's date.

    claims(id, metric, entity, as_of, seasons, events, modes, expected map<string,double>, tolerance);
    a null filter list matches everything.  Counts compare exactly, ratios and their difference within the tolerance,
    and every expected name has to match.  ``kd_delta`` sets the observations beside those of another source (``others``): maps and
    ratio of both, and local minus other.
    """
    by_event = {"seasons": "season", "events": "event"}
    by_mode = by_event | {"modes": "mode"}

    def long(sums: DataFrame, **values: Column) -> DataFrame:
        return sums.select("id", *[v.alias(n) for n, v in values.items()]).unpivot("id", list(values), "name", "actual")

    def of(*metrics: str) -> DataFrame:
        return claims.where(F.col("metric").isin(list(metrics)))

    one = F.lit(1)
    won = as_of_sums(of("raw_wins", "championships"), wins.withColumn("won", one).withColumn("titles", F.col("championship").cast("int")), by_event, ["won", "titles"])
    won = won.join(claims.select("id", "metric"), "id")
    parts = [long(won, value=F.when(F.col("metric") == "raw_wins", F.col("won")).otherwise(F.col("titles")))]
    finals = placements.select("*", F.when(F.col("place") == 1, 1).alias("wins"), F.when(F.col("place") == 2, 1).alias("losses"))
    parts.append(long(as_of_sums(of("finals_record"), finals, by_event, ["wins", "losses"]), wins=F.col("wins"), losses=F.col("losses")))

    def kd(side: str = "") -> Column:
        return F.round(F.try_divide(F.col(f"{side}good"), F.nullif(F.col(f"{side}bad"), F.lit(0.0))), 3)

    stats = ["good", "bad", "maps"]
    local = as_of_sums(of("overall_kd", "kd_delta"), observations.withColumn("maps", one), by_mode, stats)
    parts.append(long(local, good=F.col("good"), bad=F.col("bad"), maps=F.col("maps"), kd=kd()))
    if others is not None:
        there = as_of_sums(of("kd_delta"), others.withColumn("maps", one), by_mode, stats).select("id", *[F.col(c).alias(f"other_{c}") for c in stats])
        parts.append(long(local.join(there, "id"), other_maps=F.col("other_maps"), other_kd=kd("other_"), maps_delta=F.col("maps") - F.col("other_maps"),
                          kd_delta=F.round(kd() - kd("other_"), 3)))
    actual = parts[0]
    for part in parts[1:]:
        actual = actual.unionByName(part)
    wanted = claims.select("id", "metric", "tolerance", F.explode("expected").alias("name", "expected"))
    close = F.when(F.col("name").isin("kd", "other_kd", "kd_delta"), F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance")) \
             .otherwise(F.col("actual") == F.col("expected"))
    checked = wanted.join(actual, ["id", "name"], "left").withColumn("ok", F.coalesce(close, F.lit(False)))
    return checked.groupBy("id", "metric").agg(F.bool_and("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def validate_evidence(sources: DataFrame, entries: DataFrame, claims: DataFrame) -> DataFrame:
    """(source_id, problem) for incomplete sources, duplicate ids/ranks/entities and dangling references.

    sources(source_id, status, family, url, published_date, ranking_size); entries(source_id, rank,
    entity, tags); claims(source_id, entity, claimant, tags).
    """
    problems = []
    def report(df: DataFrame, text: str) -> None:
        problems.append(df.select("source_id", F.lit(text).alias("problem")).distinct())
    ranking = F.col("family").startswith("authored")
    seeded = sources.where("status = 'seeded'")
    report(sources.groupBy("source_id").count().where("count > 1"), "duplicate source")
    report(sources.where(~F.col("status").isin("seeded", "verification_lead")), "unknown status")
    report(seeded.where(blank_to_null(F.col("url")).isNull() | blank_to_null(F.col("published_date")).isNull()), "seeded source misses fields")
    report(sources.where(ranking & F.coalesce(F.col("ranking_size") <= 0, F.lit(True))), "ranking source needs a size")
    report(entries.join(sources, "source_id", "left_anti"), "ranking of an unknown source")
    report(entries.join(sources.where("status <> 'seeded'"), "source_id", "left_semi"), "ranking source is not seeded")
    report(entries.groupBy("source_id", "rank").count().where("count > 1"), "duplicate rank")
    report(entries.groupBy("source_id", "entity").count().where("count > 1"), "duplicate entity")
    report(entries.where("rank <= 0"), "rank must be positive")
    report(entries.where(F.coalesce(F.size("tags") <= 0, F.lit(True))), "entry needs tags")
    report(seeded.where(ranking).join(entries, "source_id", "left_anti"), "seeded ranking source has no entries")
    report(claims.join(seeded, "source_id", "left_anti"), "claim source is not seeded")
    report(claims.where(F.coalesce(F.size("tags") <= 0, F.lit(True))), "claim needs tags")
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p)
    return out
