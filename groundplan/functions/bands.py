"""Ordered bands of numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds (exclusive) and names of the age bands, by source.
AGE_BANDS = {
    "schedule": [(1919, "Pre-1919"), (1945, "1919-1944"), (1965, "1945-1964"), (1981, "1965-1980"), (1991, "1981-1990"), (2001, "1991-2000"), (2011, "2001-2010"), (None, "Post-2010")],
    "first": [(1919, "Pre-1919"), (1945, "1919-1944"), (1965, "1945-1964"), (1981, "1965-1980"), (2001, "1981-2000"), (None, "Post-2000")],
    "dashboard": [(1919, "Pre-1919"), (1946, "1919-1945"), (1981, "1946-1980"), (2001, "1981-2000"), (None, "Post-2000")],
}
HEIGHT_BANDS = [(11, "<11m"), (18, "11-18m"), (30, "18-30m"), (None, "30m+")]
SCOTTISH_HEIGHT_BANDS = [(18, "<18m"), (None, "18m+")]


def banded(value: Column, bands: list[tuple[float | None, str]], missing: str | None = None) -> Column:
    """The name of the first band whose bound lies above the value."""
    found = F.when(value.isNull(), F.lit(missing))
    for bound, name in bands:
        found = found.otherwise(F.lit(name)) if bound is None else found.when(value < bound, name)
    return found


def age_band(year: Column, kind: str = "schedule") -> Column:
    return banded(year, AGE_BANDS[kind])


def height_band(height: Column, nation: Column | None = None, missing: str | None = "Unknown") -> Column:
    """Four bands; two where the nation is Scotland."""
    plain = banded(height, HEIGHT_BANDS, missing)
    return plain if nation is None else F.when(nation == "SCO", banded(height, SCOTTISH_HEIGHT_BANDS, missing)).otherwise(plain)
