"""Typed values from text: integers, floats, results, placements, money, modes, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a result, placements that are not a result, top placement bounds.
TRUE_WORDS = ["1", "true", "t", "yes", "y", "win", "won"]
FALSE_WORDS = ["0", "false", "f", "no", "n", "loss", "lost"]
NON_PLACEMENTS = ["DNS", "DNP", "DQ", ""]


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def to_int(c: Column) -> Column:
    digits = F.replace(_text(c), F.lit(","), F.lit(""))
    return F.when(digits.rlike(r"^-?\d+$"), digits.try_cast("bigint"))


def to_float(c: Column) -> Column:
    return F.nullif(_text(c), F.lit("")).try_cast("double")


def to_bool(c: Column) -> Column:
    word = F.lower(_text(c))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def parse_money(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", ""), F.lit("")).try_cast("bigint")


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, n).cast("int"))


RANGE, OPEN, PLAIN = r"^(\d+)\s*-\s*(\d+)$", r"^>(\d+)$", r"^(\d+)$"


def place_x2(place: Column, place_number: Column | None = None) -> Column:
    """Twice the placement as an exact integer: a range is the sum of its ends."""
    text = F.replace(_text(place), F.lit("*"), F.lit(""))
    number = F.lit(None).cast("int") if place_number is None else _group(_text(place_number), PLAIN, 1)
    return F.coalesce(_group(text, RANGE, 1) + _group(text, RANGE, 2),
                      (_group(text, OPEN, 1) + 1) * 2,
                      _group(text, PLAIN, 1) * 2,
                      number * 2)


def place_number(place: Column, number: Column) -> Column:
    """The stated number, else the best end of a range, n + 1 for an open placement, or n."""
    text = F.replace(_text(place), F.lit("*"), F.lit(""))
    return F.coalesce(_group(_text(number), PLAIN, 1), _group(text, RANGE, 1),
                      _group(text, OPEN, 1) + 1, _group(text, PLAIN, 1))


def lenient_place(place: Column, number: Column | None = None, style: str = "midpoint") -> Column:
    """Looser readings: ``midpoint`` of the text only, ``number_first``, or ``head`` before the dash."""
    text = _text(place)
    if style == "number_first":
        text = F.coalesce(F.nullif(_text(number), F.lit("")), text)
    if style == "head":
        head = F.trim(F.element_at(F.split(text, "-"), 1))
        stated = F.lit(None).cast("int") if number is None else _text(number).try_cast("int")
        return F.coalesce(stated, head.try_cast("int")).cast("double")
    return F.coalesce(_group(text, PLAIN, 1).cast("double"),
                      (_group(text, RANGE, 1) + _group(text, RANGE, 2)) / F.lit(2.0),
                      (_group(text, OPEN, 1) + 1).cast("double"))


def is_result(place: Column) -> Column:
    return ~F.coalesce(_text(place), F.lit("")).isin(NON_PLACEMENTS)


def is_search_mode(mode: Column) -> Column:
    text = F.replace(F.lower(_text(mode)), F.lit("&"), F.lit("and"))
    return text.contains("search") & text.contains("destroy")


def split_of(mode: Column) -> Column:
    return F.when(is_search_mode(mode), F.lit("snd")).otherwise(F.lit("respawn"))


def career_position(first: Column, at: Column, last: Column) -> Column:
    """Where a date falls between two others, clamped to 0..1; null without a positive span."""
    span = F.date_diff(last, first)
    return F.when((span > 0) & at.isNotNull(), F.least(F.greatest(F.date_diff(at, first) / span, F.lit(0.0)), F.lit(1.0)))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def half_away(value: Column, digits: int) -> Column:
    """Rounding of the binary value, as SQL engines on doubles do it: scaled, to the nearest whole, halves away from zero, scaled back.

    ``round`` works on the shortest decimal text instead, which moves values such as 1.0005 up.
    """
    scale = F.lit(float(10 ** digits))
    return F.round(value * scale) / scale


def average_from_x2(sum_x2: Column, n: Column) -> Column:
    """Half-up to two decimals, computed in integers."""
    total, count = sum_x2.cast("bigint"), F.nullif(n.cast("bigint"), F.lit(0).cast("bigint"))
    return F.floor((total * 100 + count) / (count * 2)) / F.lit(100.0)
