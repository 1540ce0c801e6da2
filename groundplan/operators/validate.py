"""Record checks and JSON repair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """What a column must hold: presence, a pattern, a range, or a list of values."""

    column: str
    required: bool = False
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    allowed: Sequence[str] | None = None


def errors(checks: Sequence[Check]) -> Column:
    """Array of ``column: kind`` for each check that a row fails; one entry per column."""
    found = []
    for c in checks:
        v = F.col(c.column)
        kind = F.when(v.isNull(), "required" if c.required else None)
        if c.pattern:
            kind = kind.when(~v.cast("string").rlike(c.pattern), "pattern")
        if c.least is not None or c.most is not None:
            low = v < c.least if c.least is not None else F.lit(False)
            high = v > c.most if c.most is not None else F.lit(False)
            kind = kind.when(low | high, "range")
        if c.allowed is not None:
            kind = kind.when(~v.isin(*c.allowed), "enum")
        found.append(F.when(kind.isNotNull(), F.concat(F.lit(f"{c.column}: "), kind)))
    return F.array_compact(F.array(*found))


def _repaired(value: Column, fixed: Column, warning: Column) -> Column:
    """(value, warning): the repaired value, and the warning where a given value was not taken as it is."""
    return F.struct(fixed.alias("value"), F.when(value.isNotNull(), warning).alias("warning"))


def repaired_number(value: Column, least: float, most: float, whole: bool = False) -> Column:
    """A number within bounds, else null with a warning; a whole one loses its fraction."""
    number = value.try_cast("double")
    inside = number.between(least, most)
    fixed = F.when(inside, number.cast("long") if whole else number)
    bounds = f"outside {least:g}-{most:g}, nulled"
    return _repaired(value, fixed, F.when(number.isNull(), "not a number, nulled").when(~inside, bounds))


def repaired_choice(value: Column, allowed: Sequence[str], other: str | None = None) -> Column:
    """A value in small letters, of those allowed; any other becomes ``other``, with a warning."""
    low = F.lower(F.trim(value))
    ok = low.isin(*allowed)
    return _repaired(value, F.when(ok, low).otherwise(F.when(value.isNotNull(), F.lit(other))), F.when(~ok, f"not a valid value, set to {other}" if other else "not a valid value, nulled"))


def repaired_flag(value: Column) -> Column:
    """Words and digits for yes and no; anything else becomes null, with a warning."""
    low = F.lower(F.trim(value))
    fixed = F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)
    return _repaired(value, fixed, F.when(fixed.isNull(), "not a yes or no, nulled"))


def repaired_date(value: Column) -> Column:
    """A date written in one of three ways; anything else becomes null, with a warning."""
    fixed = F.coalesce(*(F.try_to_timestamp(value, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")))
    return _repaired(value, fixed, F.when(fixed.isNull(), "not a date, nulled"))


def repaired_json(text: Column) -> Column:
    """The outermost braces of a text, without trailing commas, Python literals turned into JSON ones."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    bare = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    for old, new in (("True", "true"), ("False", "false"), ("None", "null")):
        bare = F.regexp_replace(bare, rf"(?<=[:\[,]\s{{0,8}}){old}\b", new)
    return F.nullif(bare, F.lit(""))
