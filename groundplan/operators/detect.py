"""Column type detection: all detectors over all columns in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.functions.address import POSTCODE

#: Thresholds, word lists and formats of the detectors.
THRESHOLDS = {"postcode": 0.7, "uprn": 0.7, "date": 0.7, "address": 0.6, "numeric_id": 0.9, "categorical": 0.0, "boolean": 0.8, "year": 0.8, "latitude": 0.8, "longitude": 0.8, "city": 0.6, "region": 0.6, "house_type": 0.6, "epc_rating": 0.7}
STREETS = r"\b(street|st|road|rd|live|ave|avenue|close|court|terrace|place|square|way|crescent|drive|gardens)\b"
BOOLEANS = ("yes", "no", "true", "false", "1", "0", "y", "n", "t", "f")
CITIES = ("glasgow", "edinburgh", "aberdeen", "dundee", "inverness", "london", "manchester", "birmingham", "cardiff", "belfast")
REGIONS = ("scotland", "england", "wales", "northern ireland")
HOUSE_TYPES = ("high-rise flat", "detached house", "semi-detached", "terraced", "bungalow", "apartment", "cottage", "maisonette", "duplex", "studio", "villa", "townhouse")
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyyMMdd")
FILE_KINDS = (("fraew_document", ("fraew", "external wall", "pas9980")), ("fra_document", ("fra", "fire risk")), ("property_schedule", ("sov", "schedule", "property")), ("epc_data", ("epc",)))


def _shaped(s: Column, date_format: str) -> Column:
    """Whether a text has the digits and signs of a format where that has them; a cheap look before the calendar's."""
    shape = "".join(r"\d" if c.isalpha() else "\\" + c for c in date_format)
    return s.rlike(f"^{shape}$")


def _matches(s: Column) -> dict[str, Column]:
    """For each detector whether a text value matches; null values match nothing."""
    low, number = F.lower(s), s.try_cast("double")
    return {
        "postcode": F.upper(s).rlike(rf"^{POSTCODE}$"), "uprn": F.length(F.regexp_replace(s, r"\D", "")) == 12, **{f"date{k}": _shaped(s, f) & F.try_to_timestamp(s, F.lit(f)).isNotNull() for k, f in enumerate(DATE_FORMATS)},
        "address": low.rlike(STREETS) & s.rlike(r"\d"), "numeric_id": number.isNotNull(), "boolean": low.isin(*BOOLEANS), "year": number.between(1900, 2100), "latitude": number.between(49, 61), "longitude": number.between(-8, 2),
        "city": low.isin(*CITIES), "region": low.isin(*REGIONS), "house_type": low.isin(*HOUSE_TYPES), "epc_rating": low.isin(*"abcdefg"),
    }


def scores(df: DataFrame, thresholds: bool = True) -> DataFrame:
    """A row per column with the share of matching values for each detector; below its threshold a share is 0.

    Columns are turned into (column, value) rows and counted by value first, so a
    detector looks at every distinct value once, and distinct values need no expansion.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in df.columns)))
    counted = df.select(cells.alias("c")).select("c.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    found = _matches(F.col("value"))
    rows = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    numbers = F.sum(F.when(F.col("value").try_cast("double").isNotNull(), F.col("n")))
    sums = counted.groupBy("column").agg(rows.alias("_rows"), numbers.alias("_numbers"), F.count("value").alias("_distinct"), *(F.sum(F.when(m, F.col("n"))).alias(f"_{k}") for k, m in found.items()))
    numeric = ("year", "latitude", "longitude")
    share = {k: F.coalesce(F.col(f"_{k}"), F.lit(0)) / F.nullif(F.col("_numbers" if k in numeric else "_rows"), F.lit(0)) for k in found}
    share["date"] = F.greatest(*(share.pop(f"date{k}") for k in range(len(DATE_FORMATS))))
    distinct = F.col("_distinct") / F.nullif(F.col("_rows"), F.lit(0))
    share["categorical"] = F.when(distinct <= 0.05, 1 - distinct).otherwise(0.0)

    def kept(kind: str) -> Column:
        value = F.coalesce(share[kind], F.lit(0.0))
        return (F.when(value >= THRESHOLDS[kind], value).otherwise(0.0) if thresholds else value).alias(kind)

    return sums.select("column", *map(kept, THRESHOLDS))


def types(df: DataFrame) -> DataFrame:
    """(column, detected_type, confidence): coordinates above 0.8 first, else the highest share, the first of equal ones."""
    best, first = F.greatest(*THRESHOLDS), F.lit("unknown")
    for k in reversed(THRESHOLDS):
        first = F.when((F.col(k) == best) & (best > 0), k).otherwise(first)
    kind = F.when(F.col("latitude") > 0.8, "latitude").when(F.col("longitude") > 0.8, "longitude").otherwise(first)
    confidence = F.when(F.col("latitude") > 0.8, F.col("latitude")).when(F.col("longitude") > 0.8, F.col("longitude")).otherwise(best)
    return scores(df).select("column", kind.alias("detected_type"), F.round(confidence, 6).alias("confidence"))


def file_kind(name: Column) -> Column:
    """The kind of file its name tells, by ordered keyword lists."""
    low, found = F.lower(name), F.lit("unknown")
    for kind, words in reversed(FILE_KINDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        found = F.when(hit, kind).otherwise(found)
    return found
