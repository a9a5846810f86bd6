"""Text keys: name normalisation, slugs, titles, award labels, markup cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# These patterns and labels define the keys, so results depend on them.
PARENTHETICAL = r"\s*\(.*?\)\s*"
CHAMPIONSHIP_NAME = r"^Call of Duty (World League |League )?Championship 20\d\d$"
AWARD_TYPES = {
    "Event MVP": "event_mvp",
    "Grand Finals MVP": "grand_finals_mvp",
    "Season MVP": "season_mvp",
    "Rookie of the Year": "rookie_of_the_year",
    "CDL First Team": "cdl_first_team",
    "CDL Second Team": "cdl_second_team",
    "CWL All-Star": "cwl_all_star",
}
CHAMPIONSHIP_MVP = "champs_mvp"
EVENT_AWARDS = ["Event MVP", "Grand Finals MVP"]
SEASON_AWARDS = ["Season MVP", "Rookie of the Year", "CDL First Team", "CDL Second Team"]
ALL_STAR_AWARDS = ["CWL All-Star"]
TOP_TIERS = ["Major", "Premier"]
SEASON_PAGE = r"^Call of Duty League/20\d\d Season$"
ALL_STAR_PAGE_PREFIX = "CWL/"
EXCLUDED_AWARD_PAGES = "%Breaking Point Awards%"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def lookup(values: Mapping[str, str], key: Column) -> Column:
    """Literal map lookup; null when the key is absent or the map is empty."""
    if not values:
        return F.lit(None).cast("string")
    flat = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def strip_paren(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, PARENTHETICAL, ""))


def entity_key(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Lower-case name; a parenthetical survives unless an alias claims the whole name."""
    aliases = dict(aliases or {})
    raw = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    base = F.lower(strip_paren(raw))
    has_paren = raw.contains("(") & raw.contains(")")
    return F.coalesce(lookup(aliases, raw), F.when(has_paren, raw), lookup(aliases, base), base)


def compact_key(c: Column, style: str = "stripped") -> Column:
    """``stripped`` drops the parenthetical first, ``plain`` keeps its text, ``unicode`` keeps any letter or digit."""
    text = F.coalesce(c, F.lit(""))
    if style == "unicode":
        return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    if style == "stripped":
        text = strip_paren(text)
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def title_key(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Space-separated lower-case words with immediate repeats collapsed."""
    def words_of(x: Column) -> Column:
        spaced = F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("_"), F.lit(" ")), F.lit("&"), F.lit("and"))
        words = F.split(F.trim(F.regexp_replace(F.lower(spaced), "[^a-z0-9]+", " ")), " ")
        kept = F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))
        return F.array_join(kept, " ")
    key = words_of(c)
    return key if not aliases else words_of(F.coalesce(lookup(aliases, key), key))


def slug(c: Column, separator: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", separator), "^-+|-+$", "")


def url_for(base: str, page: Column) -> Column:
    encoded = F.url_encode(F.replace(F.coalesce(page, F.lit("")), F.lit(" "), F.lit("_")))
    for seen, wanted in (("%2F", "/"), ("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(seen), F.lit(wanted))
    return F.concat(F.lit(base), encoded)


def canonical_names(names: DataFrame, queries: DataFrame, name: str = "name", query: str = "query") -> DataFrame:
    """Resolve free-text names: exact, then case-insensitive, then parenthetical-free, unique keys only."""
    def unique(key: Column, out: str) -> DataFrame:
        return (names.select(key.alias(f"{out}_key"), F.col(name).alias(out))
                .where(F.col(f"{out}_key") != "")
                .groupBy(f"{out}_key").agg(F.count_distinct(out).alias("_n"), F.min(out).alias(out))
                .where("_n = 1").drop("_n"))
    exact = names.select(F.col(name).alias("exact_key"), F.col(name).alias("exact")).distinct()
    lower = unique(F.lower(F.trim(F.col(name))), "by_lower")
    bare = unique(F.lower(strip_paren(F.col(name))), "by_bare")
    text = F.trim(F.col(query))
    return (queries
            .join(exact, text == F.col("exact_key"), "left")
            .join(lower, F.lower(text) == F.col("by_lower_key"), "left")
            .join(bare, F.lower(strip_paren(text)) == F.col("by_bare_key"), "left")
            .withColumn("resolved", F.coalesce(
                "exact", "by_lower", F.when(~text.rlike(r"\([^)]*\)"), F.col("by_bare"))))
            .drop("exact_key", "exact", "by_lower_key", "by_lower", "by_bare_key", "by_bare"))


def is_championship(name: Column, pattern: str = CHAMPIONSHIP_NAME) -> Column:
    return F.coalesce(name, F.lit("")).rlike(pattern)


def award_type(kind: Column, event: Column, page: Column, pattern: str = CHAMPIONSHIP_NAME) -> Column:
    named = F.coalesce(blank_to_null(event), page)
    return F.when((kind == "Event MVP") & is_championship(named, pattern), F.lit(CHAMPIONSHIP_MVP)) \
            .otherwise(lookup(AWARD_TYPES, kind))


def keep_award(kind: Column, page: Column, tier: Column) -> Column:
    return F.coalesce(
        ~page.like(EXCLUDED_AWARD_PAGES)
        & ((kind.isin(EVENT_AWARDS) & tier.isin(TOP_TIERS))
           | (kind.isin(SEASON_AWARDS) & page.rlike(SEASON_PAGE))
           | (kind.isin(ALL_STAR_AWARDS) & page.startswith(ALL_STAR_PAGE_PREFIX))),
        F.lit(False))


def award_year(page: Column, event: Column, date: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(page, F.lit("")), F.coalesce(event, F.lit("")))
    in_season = F.nullif(F.regexp_extract(text, r"(?:^|/)(20\d\d) Season\b", 1), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(text, r"\b(20\d\d)\b", 1), F.lit(""))
    return F.coalesce(in_season, anywhere, F.substring(F.coalesce(date, F.lit("")), 1, 4))


def clean_markup(c: Column) -> Column:
    """Visible text of one cell: attributes, bold marks, tags and repeated space removed."""
    text = F.regexp_replace(F.trim(c), r"^\|\s*", "")
    text = F.regexp_replace(text, r'^(?:[A-Za-z-]+=(?:"[^"]*"|[^|\s]+)\s*)+\|\s*', "")
    text = F.regexp_replace(F.replace(text, F.lit("'''"), F.lit("")), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def link_target(c: Column) -> Column:
    return clean_markup(F.replace(blank_to_null(F.regexp_extract(c, r"\[\[([^|\]]+)", 1)), F.lit("_"), F.lit(" ")))


def link_label(c: Column) -> Column:
    label = blank_to_null(F.regexp_extract(c, r"\[\[[^|\]]+\|([^\]]+)\]\]", 1))
    return clean_markup(F.coalesce(label, blank_to_null(F.regexp_extract(c, r"\[\[([^|\]]+)", 1)), c))


def table_cells(df: DataFrame, text: str, keys: Sequence[str], row_mark: str, cell_mark: str) -> DataFrame:
    """Explode marked-up text into one row per (record, row, cell) with its visible text."""
    rows = df.select(*keys, F.posexplode(F.split(F.col(text), row_mark)).alias("row_no", "row_text"))
    return (rows.select(*keys, "row_no", F.posexplode(F.split("row_text", cell_mark)).alias("cell_no", "cell_raw"))
            .withColumn("cell", clean_markup(F.col("cell_raw"))))


def number(c: Column) -> Column:
    """The number a cell shows; null for blanks, dashes and words."""
    text = clean_markup(c)
    return F.when(~text.isin("", "-", "N/A"), text.try_cast("double"))


def link(c: Column) -> tuple[Column, Column]:
    """Label and target of the first link of a cell; a cell without one is its own label."""
    target = F.regexp_extract(c, r"\[\[([^|\]]+)(?:\|[^\]]+)?\]\]", 1)
    label = F.coalesce(F.nullif(F.regexp_extract(c, r"\[\[[^|\]]+\|([^\]]+)\]\]", 1), F.lit("")), F.replace(F.trim(target), F.lit("_"), F.lit(" ")))
    has = target != ""
    return F.when(has, clean_markup(label)).otherwise(clean_markup(c)), F.when(has, clean_markup(F.replace(F.trim(target), F.lit("_"), F.lit(" "))))


@dataclass(frozen=True)
class Layout:
    """Where a table of ``kind`` keeps its columns, for rows of at least ``least`` cells; places count from 0."""

    kind: str
    least: int
    link: int
    texts: Mapping[str, int]
    numbers: Mapping[str, int]
    groups: Mapping[str, Mapping[str, int]]


def row_cells(row: Column) -> Column:
    """Cells of one marked-up row: on one line between double bars, or one a line."""
    inline = F.transform(F.split(F.trim(row), r"\|\|"), lambda c: F.trim(c))
    lines = F.transform(F.split(F.trim(row), "\n"), lambda c: F.trim(c))
    return F.when(F.contains(row, F.lit("||")), inline).otherwise(F.filter(lines, lambda c: c.startswith("|") & ~c.startswith("|}")))


def table_records(df: DataFrame, text: str, kind: str, keys: Sequence[str], layouts: Sequence[Layout], generic: Mapping[str, int],
                  least: int = 6) -> DataFrame:
    """One record per row of the marked-up tables in ``text``: link label and target, texts, numbers and groups of numbers.

    A row of fewer than ``least`` cells is none.  A row that is wide enough for a layout of its table's kind is read by it; any other has its
    columns where ``generic`` puts them after its first linked cell (with a text before it as ``date``, if that is the second cell), and none without one.
    """
    names = list(dict.fromkeys(n for x in layouts for n in x.numbers))
    texts = list(dict.fromkeys(n for x in layouts for n in x.texts))
    groups = list(dict.fromkeys(g for x in layouts for g in x.groups))
    rows = df.select(*keys, F.col(kind).alias("_kind"), F.posexplode(F.split(F.col(text), r"\n\|-\n")).alias("row_no", "_raw"))
    cells = rows.where(F.ltrim(F.col("_raw")).startswith("|")).withColumn("_cells", row_cells(F.col("_raw"))).where(F.size("_cells") >= least)
    at = F.array_position(F.transform("_cells", lambda c: F.contains(c, F.lit("[["))), True) - 1
    cells = cells.withColumn("_at", at.cast("int"))

    def cell(place: int | Column) -> Column:
        return F.get("_cells", F.lit(place) if isinstance(place, int) else place)

    def fits(x: Layout) -> Column:
        return (F.col("_kind") == x.kind) & (F.size("_cells") >= x.least)

    known = F.lit(False)
    for x in layouts:
        known = known | F.coalesce(fits(x), F.lit(False))
    reach = max(generic.values())
    cells = cells.where(known | ((F.col("_at") >= 0) & (F.size("_cells") > F.col("_at") + reach)))

    def pick(of, other: Column) -> Column:
        out = other
        for x in reversed(layouts):
            value = of(x)
            out = F.when(fits(x), F.lit(None) if value is None else value).otherwise(out)
        return out

    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    after = {n: cell(F.col("_at") + g) for n, g in generic.items()}
    label = pick(lambda x: link(cell(x.link))[0], link(cell(F.col("_at")))[0])
    target = pick(lambda x: link(cell(x.link))[1], link(cell(F.col("_at")))[1])
    out = [label.alias("event"), target.alias("event_target")]
    for n in texts:
        other = clean_markup(after[n]) if n in after else F.when(F.col("_at") == 1, blank_to_null(clean_markup(cell(0)))) if n == "date" else no_text
        value = pick(lambda x, n=n: clean_markup(cell(x.texts[n])) if n in x.texts else no_text, other)
        out.append((blank_to_null(value) if n == "date" else value).alias(n))
    for n in names:
        out.append(pick(lambda x, n=n: number(cell(x.numbers[n])) if n in x.numbers else nothing, number(after[n]) if n in after else nothing).alias(n))
    no_map = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    for g in groups:
        out.append(pick(lambda x, g=g: F.create_map(*[v for m, i in x.groups[g].items() for v in (F.lit(m), number(cell(i)))]) if x.groups.get(g) else no_map,
                        no_map).alias(g))
    return cells.select(*keys, "row_no", *out).where(F.coalesce(F.col("event"), F.lit("")) != "")
