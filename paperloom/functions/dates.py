"""Dates and years in names, folders and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.matching import find_all, let

_YEAR = r"(?:20\d{2}|19\d{2})"
# Month names as the year patterns know them, and these patterns: years by themselves, after day and month,
# and after a month's name; each match ends in the year.
MONTHS = r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?"
YEAR_PATTERNS = (
    rf"(?iU)(?<!\d){_YEAR}(?!\d)",
    rf"(?iU)(?<!\d)\d{{1,2}}[ _\.-]\d{{1,2}}[ _\.-]{_YEAR}(?!\d)",
    rf"(?iU)(?:(?:{MONTHS})\s*\d{{1,2}}[ ,._-]*)?{_YEAR}",
)


def parse_date(text: Column) -> Column:
    """First valid date: year-month-day forms, then the first run of 8 digits, then month-day-year forms."""
    first = lambda dates: F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))
    ymd = F.regexp_extract_all(text, F.lit(rf"(?U)\b{_YEAR}[._/-]\d{{1,2}}[._/-]\d{{1,2}}\b"), F.lit(0))
    ymd = F.transform(ymd, lambda m: F.try_to_date(F.regexp_replace(m, "[._/-]", "-"), "yyyy-M-d"))
    run = F.regexp_extract(text, rf"(?U)\b({_YEAR}\d{{4}})\b", 1)
    mdy = F.regexp_extract_all(text, F.lit(rf"(?U)\b\d{{1,2}}[._/-]\d{{1,2}}[._/-]{_YEAR}\b"), F.lit(0))
    mdy = F.transform(mdy, lambda m: F.try_to_date(F.regexp_replace(m, "[._/-]", "-"), "M-d-yyyy"))
    return F.coalesce(first(ymd), F.try_to_date(F.nullif(run, F.lit("")), "yyyyMMdd"), first(mdy))


def date_produced(rel_dir: Column, filename: Column, default) -> Column:
    """Date of the second folder, else of any folder from the top, else of the name, else ``default``."""
    parts = F.filter(F.split(rel_dir, "/"), lambda p: p != "")
    second = F.get(parts, F.lit(1))
    # Only what can hold a year is parsed, and nothing behind the first date.
    tokens = F.filter(F.array_distinct(F.concat(F.array(second), parts, F.array(filename))), lambda t: F.contains(t, F.lit("19")) | F.contains(t, F.lit("20")))
    found = F.aggregate(tokens, F.lit(None).cast("date"), lambda date, t: F.coalesce(date, parse_date(t)))
    return F.coalesce(found, F.lit(default).cast("date"))


def pdf_date_year(text: Column) -> Column:
    """Year of a date like ``D:20210105...``; null without four digits in front."""
    return F.nullif(F.regexp_extract(text, r"(?U)^(?:D:)?(\d{4})", 1), F.lit("")).try_cast("int")


def without_label(name: Column) -> Column:
    """A name without a label in front, so that the label's number is no year."""
    return F.regexp_replace(name, r"(?U)^[A-Za-z]+\d{4,}[ _.-]*", "")


def _years(text: Column, k: int, low: int, high: int) -> Column:
    """Array of (pattern, start, end, year) of the k-th pattern within the bounds."""
    year = lambda m: F.right(m["text"], F.lit(4)).try_cast("int")
    found = F.transform(find_all(text, YEAR_PATTERNS[k - 1]), lambda m: F.struct(F.lit(k).alias("pattern"), m["start"].alias("start"), m["end"].alias("end"), year(m).alias("year")))
    return F.filter(found, lambda c: c["year"].between(low, high))


def _first_year(text: Column, k: int, low: int, high: int) -> Column:
    """The first of ``_years``. Only if the first match is out of bounds are all of them looked for.

    The text up to the match's end is taken at once: ``split`` would compile the pattern for each row.
    """
    ahead = f"(?s)^(.*?){YEAR_PATTERNS[k - 1]}"

    def picked(upto):
        year = F.right(upto, F.lit(4)).try_cast("int")
        one = F.struct(F.lit(k).alias("pattern"), F.char_length(F.regexp_extract(text, ahead, 1)).alias("start"), F.char_length(upto).alias("end"), year.alias("year"))
        return F.when(upto == "", None).when(year.between(low, high), one).otherwise(F.get(_years(text, k, low, high), F.lit(0)))

    return let(F.regexp_extract(text, ahead, 0), picked)


def year_candidates(text: Column, low: int, high: int) -> Column:
    """Array of (pattern, start, end, year) within the bounds, by pattern, then place."""
    return F.concat(*[_years(text, k, low, high) for k in range(1, len(YEAR_PATTERNS) + 1)])


def year_of(text: Column, low: int, high: int, policy: str, by_place: bool = False) -> Column:
    """What ``pick_year`` picks of ``year_candidates``; patterns are tried only while one may still decide, and only where a text can have a year."""
    if by_place or policy in ("last", "max"):
        found = pick_year(year_candidates(text, low, high), policy, by_place)
    else:  # the second pattern's years are the first one's as well
        found = F.coalesce(_first_year(text, 1, low, high), _first_year(text, 3, low, high))
    return F.when(F.contains(text, F.lit("19")) | F.contains(text, F.lit("20")), found)


def pick_year(candidates: Column, policy: str, by_place: bool = False) -> Column:
    """The candidate a policy picks: ``max`` the largest (the earliest of equal ones), ``last`` the last, else the first.

    ``by_place`` orders by the place in the text instead of by pattern.
    """
    if policy == "max":
        keyed = F.transform(candidates, lambda c, i: F.struct((-c["year"]).alias("k"), i.alias("i"), c.alias("c")))
    elif by_place:
        sign = -1 if policy == "last" else 1
        keyed = F.transform(candidates, lambda c, i: F.struct((sign * c["start"]).alias("k"), (sign * i).alias("i"), c.alias("c")))
    else:
        sign = -1 if policy == "last" else 1
        keyed = F.transform(candidates, lambda c, i: F.struct((sign * i).alias("k"), i.alias("i"), c.alias("c")))
    return F.get(F.array_sort(keyed), F.lit(0))["c"]


def iso_utc(ts: Column) -> Column:
    """A timestamp as ISO text in UTC, whatever the session's zone is."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
