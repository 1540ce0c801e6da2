"""Addresses and postcodes: extraction, standard order, tokens and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: postcodes, and how flats, pairs of numbers, and floors are written.
POSTCODE = r"[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}"
VALID_POSTCODE = r"^[A-Z]{1,2}[0-9][0-9A-Z]?\s[0-9][A-Z]{2}$"
FLAT_WORDS = r"(flat|unit|apt|apartment|room|suite)"
PAIR = r"(?:^|[\s,])(\d+)\s*/\s*(\d+)"
PAIR_ALONE = PAIR + r"(?=[\s,]|$)"
FLOOR_PAIR = r"(?i)\b(\d+)\s*f\s*(\d+)\b"
FLOORS = r"(?i)\b(gfl|gfr|bfl|bfr|ground\s+floor|basement)\b"


def postcode(c: Column) -> Column:
    """The first postcode in the text, upper-cased, at most ten characters."""
    return F.nullif(F.left(F.regexp_extract(F.upper(F.trim(c)), rf"({POSTCODE})", 1), F.lit(10)), F.lit(""))


def normal_postcode(c: Column) -> Column:
    """Without blanks but for one before the last three characters, from five characters on."""
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    return F.when(F.length(s) >= 5, F.concat(F.substr(s, F.lit(1), F.length(s) - 3), F.lit(" "), F.right(s, F.lit(3)))).otherwise(s)


def valid_postcode(c: Column) -> Column:
    return F.upper(c).rlike(VALID_POSTCODE)


def assembled(parts: Column) -> Column:
    """The non-blank fragments that are no postcode, joined by commas; null if none is left."""
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~F.upper(p).rlike(rf"^{POSTCODE}$"))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")


def distinct_segments(c: Column) -> Column:
    """The segments without those that repeat an earlier one in any case; order is kept."""
    parts = segments(c)
    lowered = F.transform(parts, lambda p: F.lower(p))
    return F.array_join(F.filter(parts, lambda p, i: F.array_position(lowered, F.lower(p)) == i + 1), ", ")


def without_postcode(address: Column, code: Column) -> Column:
    """The address without the postcode, its segments distinct."""
    parts = F.filter(segments(address), lambda p: F.upper(F.regexp_replace(p, r"\s", "")) != F.upper(F.regexp_replace(code, r"\s", "")))
    return F.when(code.isNull(), address).otherwise(distinct_segments(F.array_join(parts, ", ")))


def standard(address: Column) -> Column:
    """Flat notation first: a trailing ``x/y`` of a segment, else a flat or ``x/y`` segment further back."""
    parts = segments(address)
    trailing = r"^(.+?)\s+(\d+/\d+)\s*$"
    hits = F.transform(parts, lambda p: p.rlike(trailing) & ~p.rlike(rf"(?i)^{FLAT_WORDS}\b"))
    at = F.array_position(hits, True)
    notation = F.regexp_extract(F.get(parts, (at - 1).cast("int")), trailing, 2)
    stripped = F.transform(parts, lambda p, i: F.when(i + 1 == at, F.regexp_extract(p, trailing, 1)).otherwise(p))
    with_notation = F.when(F.get(stripped, F.lit(0)).rlike(r"^\d+/\d+"), stripped).otherwise(F.concat(F.array(notation), stripped))
    later = F.transform(parts, lambda p, i: (i > 0) & (p.rlike(rf"(?i)^{FLAT_WORDS}\s+\S+") | p.rlike(r"^\d+/\d+$")))
    back = F.array_position(later, True)
    moved = F.concat(F.array(F.get(parts, (back - 1).cast("int"))), F.filter(parts, lambda p, i: i + 1 != back))
    return F.when(F.size(parts) == 0, address).when(at > 0, F.array_join(with_notation, ", ")).when(back > 0, F.array_join(moved, ", ")).otherwise(address)


def has_flat_token(address: Column) -> Column:
    plain = F.regexp_replace(address, rf"(?i){POSTCODE}", "")
    return address.rlike(rf"(?i)\b{FLAT_WORDS}\b") | plain.rlike(PAIR_ALONE) | address.rlike(FLOOR_PAIR) | address.rlike(FLOORS)


def _without_flat(address: Column) -> Column:
    plain = F.regexp_replace(address, rf"(?i){POSTCODE}", "")
    plain = F.regexp_replace(plain, rf"(?i)\b{FLAT_WORDS}\s+\d+(?:\s*/\s*\d+)?\b", "")
    return F.regexp_replace(F.regexp_replace(plain, PAIR, " "), FLOOR_PAIR, "")


def building_number(address: Column) -> Column:
    return F.nullif(F.regexp_extract(_without_flat(address), r"\b(\d+)\b", 1), F.lit(""))


def flat_number(address: Column) -> Column:
    """The flat of ``Flat 3``, ``Flat 0/1`` or ``x/y``: of a pair the second number."""
    plain = F.regexp_replace(address, rf"(?i){POSTCODE}", "")
    pick = lambda pattern, k: F.nullif(F.regexp_extract(plain, pattern, k), F.lit(""))
    keyword = rf"(?i)\b(?:{FLAT_WORDS[1:-1]})\s+(\d+)(?:\s*/\s*(\d+))?\b"
    return F.coalesce(pick(keyword, 2), pick(keyword, 1), pick(FLOOR_PAIR, 2), pick(PAIR_ALONE, 2))


def street_tokens(address: Column) -> Column:
    plain = F.regexp_replace(_without_flat(F.lower(address)), r"[^\w\s]", " ")
    return F.array_distinct(F.filter(F.split(F.trim(plain), r"\s+"), lambda t: (t != "") & ~t.rlike(r"^\d+$")))


def normal(address: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(address), r"[^\w\s]", " "), r"\s+", " "))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens by the larger number of tokens; 0 if one side has none."""
    size = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / size).otherwise(0.0)


def tokens(address: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal(address), " "), lambda t: t != ""))
