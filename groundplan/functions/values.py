"""Cleaning of text cells into strings, numbers, booleans, years and dates; all return columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean no value, and the boolean words of each source.
NULL_WORDS = ("null", "none", "n/a", "unknown", "tbc", "tbd", "not stated", "not applicable", "not available", "not provided", "not assessed", "")
TRUE_WORDS = ("true", "yes", "1", "present", "installed", "provided", "fitted")
FALSE_WORDS = ("false", "no", "0", "not present", "not installed", "none", "n/a")
SCHEDULE_TRUE = ("yes", "true", "1", "y")
#: Fixed formats, tried in order.
DATE_FORMATS = ("d MMMM yyyy", "d MMM yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "yyyy.M.d", "d.M.yyyy", "MMMM d, yyyy", "MMM d, yyyy")
MONTH_FORMATS = ("MMMM yyyy", "MMM yyyy")
COLUMN_LIMITS = {"property_reference": 100, "postcode": 10, "address": 500}


def text_or_null(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*NULL_WORDS), F.trim(c))


def money(c: Column, zero_is_null: bool = True, signs: str = "£,") -> Column:
    """A number without currency signs, commas and blanks; what is none is null, and so is 0 unless kept."""
    number = F.regexp_replace(c, rf"[{signs}\s]", "").try_cast("double")
    return F.nullif(number, F.lit(0.0)) if zero_is_null else number


def whole_number(c: Column) -> Column:
    """Rounded half to even."""
    return F.bround(money(c), 0).cast("int")


def boolean(c: Column) -> Column:
    """True and false words; others are null."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def schedule_boolean(c: Column) -> Column:
    """True words are true, any other text is false, null stays null."""
    return F.lower(F.trim(c)).isin(*SCHEDULE_TRUE)


def unit_interval(c: Column, default: float = 0.5) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.try_cast("double"))), F.lit(default))


def year(c: Column) -> Column:
    """A year between 1700 and 2029 in text: whole numbers, years inside, or two-digit ranges' midpoints."""
    plain = c.try_cast("double").cast("int")
    inside = F.nullif(F.regexp_extract(c, r"(1[789]\d{2}|20[012]\d)", 1), F.lit("")).cast("int")
    low, high = (F.nullif(F.regexp_extract(c, r"^(?i)(\d{2})TO(\d{2})", k), F.lit("")).cast("int") for k in (1, 2))
    return F.coalesce(inside, F.when(plain.between(1700, 2030), plain), F.floor((low + high + 3800) / 2).cast("int"))


def insured_year(header: str) -> int:
    """The year a header names; of a range the later one; 0 without one. Headers are few, so this is plain Python."""
    import re

    if found := re.search(r"(\d{2,4})[/\-](\d{2,4})", header):
        return max(int(y) if len(y) == 4 else 2000 + int(y) for y in found.groups())
    return max((int(y) for y in re.findall(r"20\d{2}", header)), default=0)


def insured_year_of(header: Column) -> Column:
    """``insured_year`` of a column of headings."""
    part = lambda k: F.regexp_extract(header, r"(\d{2,4})[/\-](\d{2,4})", k)
    full = lambda y: F.when(F.length(y) == 4, y.try_cast("int")).otherwise(y.try_cast("int") + 2000)
    alone = F.array_max(F.transform(F.regexp_extract_all(header, F.lit(r"20\d{2}"), 0), lambda y: y.cast("int")))
    return F.coalesce(F.greatest(full(part(1)), full(part(2))), alone, F.lit(0))


def storeys(c: Column) -> Column:
    """The first number; one less, but 1 at least, where a basement is counted."""
    n = F.nullif(F.regexp_extract(c, r"\b(\d+)\b", 1), F.lit("")).cast("int")
    return F.when(F.lower(c).contains("basement"), F.greatest(n - 1, F.lit(1))).otherwise(n)


def date(c: Column) -> Column:
    """ISO prefix, else the formats in order, after ordinal endings are cut; null if none fits."""
    s = F.trim(c)
    plain = F.regexp_replace(s, r"(?i)(\d+)(st|nd|rd|th)\b", "$1")
    tries = [F.try_to_date(plain, f) for f in DATE_FORMATS]
    months = [F.try_to_date(F.concat(F.lit("1 "), plain), f"d {f}") for f in MONTH_FORMATS]
    return F.coalesce(F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"), *tries, *months)


def in_date(valid_until: Column, as_of: Column) -> Column:
    return valid_until >= as_of


def expiring(valid_until: Column, as_of: Column, days: int = 90) -> Column:
    return valid_until.between(as_of, F.date_add(as_of, days))


def back_off(attempt: Column, first: int = 60, most: int = 21_600) -> Column:
    """Seconds before the next try: doubled each time, at most six hours."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most))).cast("long")


def retained_until(created: Column, days: int = 2555) -> Column:
    return F.date_add(created, days)


def clamped(c: Column, name: str) -> Column:
    return F.left(c, F.lit(COLUMN_LIMITS[name])) if name in COLUMN_LIMITS else c
