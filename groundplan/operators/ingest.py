"""Schedules of values: from workbook rows to typed properties.

A sheet is profiled by one aggregation. Its header row alone decides on its plan, the
column of each field; the plans are a table by workbook and sheet that is joined to the
rows, and everything else is one projection over the cells. So any number of workbooks,
with sheets of equal names and other columns, is one job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan.functions import address, values
from groundplan.functions.bands import age_band
from groundplan.operators.lineage_cut import cut
from groundplan.operators.numbering import numbered

#: Words that mark sheets, headers and columns.
NOISE = ("broker fee", "indexation", "questionnaire", "payroll", "wages", "turnover", "vehicle", "salary", "matrix", "comparison", "working", "notes", "summary", "pivot", "validation", "void")
DATA = ("stock", "rented", "rental", "dwelling", "property", "listing", "schedule", "residential", "unit", "flat", "house", "block", "portfolio", "leasehold")
HEADER_WORDS = ("address", "postcode", "post code", "ref", "insur", "block", "storey", "bedroom", "type", "year", "add 1", "prty_id")
TOTALS = ("total", "subtotal", "grand total", "sum of", "count of")
SKIPPED = ("correspondence", "mailing", "indicative rent", "tenant", "gross book", "net book", "title number", "weekly rent")
#: By field the words of which a header has one, and those of which it has none; "=" asks for the whole header.
FIELDS = {
    "property_reference": (("property ref", "asset ref", "jrf ref", "place ref", "council ref", "prop id", "property id", "unit ref", "uprn", "asset reference", "prty_id", "property code", "reconciliation", "=reference"), ("block", "parent", "policy")),
    "block_reference": (("block ref", "parent ref", "block name", "block id", "jll block", "default block", "parent asset", "parent asset ref"), ()),
    "address": (("full address", "address details", "address line 1", "add 1", "add1", "risk address", "address 1", "address"), ()),
    "address_2": (("address line 2", "add 2", "add2", "address 2"), ()),
    "address_3": (("address line 3", "add 3", "add3", "address 3", "town", "city"), ()),
    "postcode": (("postcode", "post code", "pc", "post_code"), ()),
    "occupancy_type": (("occupancy", "tenure", "rental type", "tenancy", "asset tenancy", "classification", "letting type", "insurance tenure", "rent type", "need category desc", "insurance - category"), ()),
    "sum_insured": (("sum insured", "declared value", "rebuild", "reinstate", "insurance value", "block rebuild", "di value", "reinstatement"), ("type", "basis")),
    "sum_insured_type": (("si type", "insured type", "basis of", "sum insured type"), ()),
    "property_type": (("property type", "asset type", "location type", "type", "unit description", "built form"), ()),
    "avid_property_type": (("avid",), ()),
    "wall_construction": (("wall construction", "wall material", "external wall", "construction", "non traditional"), ("date",)),
    "roof_construction": (("roof construction", "roof material", "roof type"), ()),
    "floor_construction": (("floor construction", "floor material"), ()),
    "year_of_build": (("year built", "year of build", "construction date", "year build", "build year", "built", "build date"), ()),
    "age_banding": (("age band", "age banding"), ()),
    "bedrooms": (("bedroom", "beds", "no. of bed", "no of bed", "bedrooms", "number of bed", "bed size", "lettablebeds"), ()),
    "storeys": (("storey", "stories", "floors", "no of floor", "number of floor", "storeys above", "number of storey", "no. of stor", "no of floors"), ()),
    "units": (("no. of unit", "number of unit", "units in block", "number of units", "no of unit", "max occs"), ()),
    "has_basement": (("basement",), ()),
    "is_listed": (("listed",), ()),
    "security_features": (("security",), ()),
    "fire_protection": (("fire protection", "sprinkler"), ()),
    "alarms": (("alarm",), ()),
    "flood_insured": (("flood",), ()),
    "storm_insured": (("storm",), ()),
    "deductible": (("deductible", "excess"), ()),
    "basis_of_deductible": (("basis of deductible", "basis of ded", "eel/sec", "eel sec"), ()),
    "insure_flag": (("insure yes", "insure y/n", "insured yes"), ()),
}
FRAGMENTS = (("address line 1", "address line 2", "address line 3"), ("add 1", "add 2", "add 3"), ("add_1", "add_2", "add_3"), ("hse no", "street", "flat"), ("address 1", "address 2", "address 3"))
HEADER_SCAN = 10
#: So many plans, a row a sheet, are broadcast to the rows; more are joined by shuffles, a sheet in so many shares.
BROADCAST_PLANS, SHARES = 20_000, 64


@dataclass
class SheetPlan:
    sheet: str
    header_row: int
    columns: dict[str, int]
    address: list[int] = field(default_factory=list)
    rows: int = 0
    path: str | None = None
    sheet_idx: int | None = None


@dataclass
class JoinPlan:
    """What a primary sheet lacks and another sheet holds under the same key."""

    primary_key: int
    sheet: str
    key: int
    strip_suffix: bool = False
    fields: list[str] = field(default_factory=list)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def header_scores(rows: DataFrame) -> DataFrame:
    """Of each sheet the most header-like of its first rows, with its cells; the first of equal ones."""
    cells = F.filter("cells", lambda c: F.trim(c) != "")
    text = F.lower(F.array_join(cells, " "))
    numbers = F.exists(cells, lambda c: c.try_cast("double") > 100)
    strings = F.size(F.filter(cells, lambda c: c.try_cast("double").isNull()))
    words = sum((F.when(text.contains(w), 3).otherwise(0) for w in HEADER_WORDS), F.lit(0))
    scored = rows.where(F.col("row_idx") < HEADER_SCAN).withColumn("score", F.when(strings >= 2, strings + words - F.when(numbers, 2).otherwise(0)))
    best = F.max_by(F.struct("row_idx", "cells"), F.struct("score", (-F.col("row_idx")).alias("o")))
    return scored.where("score is not null").groupBy("path", "sheet", "sheet_idx").agg(best.alias("b")).select("path", "sheet", "sheet_idx", "b.row_idx", "b.cells")


def sheet_scores(rows: DataFrame) -> DataFrame:
    """A score per sheet from its name, size and density of large numbers; the best holds the data."""
    name = F.lower("sheet")
    numbers = F.size(F.filter("cells", lambda c: F.regexp_replace(c, r"[£,\s]", "").try_cast("double") > 1000))
    score = F.log2(F.count("*") + 1) + 5 * F.max(_any(name, DATA).cast("int")) - 8 * F.max(_any(name, NOISE).cast("int")) + 3 * F.least(F.avg(numbers), F.lit(2.0))
    return rows.groupBy("path", "sheet", "sheet_idx").agg(F.count("*").alias("rows"), F.round(score, 4).alias("score"))


def column_map(headers: list[str | None]) -> tuple[dict[str, int], list[int]]:
    """Field to column number, and the columns of a fragmented address. Of several insured sums the latest year's."""
    low = [(h or "").lower() for h in headers]
    named = [(k, h) for k, h in enumerate(low) if h and not any(w in h for w in SKIPPED)]

    def rank(name: str, k: int, h: str) -> tuple | None:
        """The smaller the better; None if the header is none of the field."""
        wanted, forbidden = FIELDS[name]
        if any(w in h for w in forbidden) or not any(w[1:] == h.strip() if w[0] == "=" else w in h for w in wanted):
            return None
        whole = not any(w in h for w in wanted if w[0] != "=")
        return (-values.insured_year(h), -k) if name == "sum_insured" else (whole, k)

    ranked = {name: [(r, k) for k, h in named if (r := rank(name, k, h)) is not None] for name in FIELDS}
    found = {name: min(hits)[1] for name, hits in ranked.items() if hits}
    for pattern in FRAGMENTS:
        parts = [next((k for k, h in enumerate(low) if fragment in h), None) for fragment in pattern]
        parts = list(dict.fromkeys(k for k in parts if k is not None))
        if len(parts) >= 2:
            for name in ("address", "address_2", "address_3"):
                found.pop(name, None)
            return found, parts
    return found, []


@F.udf(T.StructType([T.StructField("columns", T.MapType(T.StringType(), T.IntegerType())), T.StructField("parts", T.ArrayType(T.IntegerType()))]))
def _mapped(headers: list[str | None]) -> tuple[dict[str, int], list[int]]:
    return column_map(headers)


def _planned(rows: DataFrame) -> DataFrame:
    """(path, sheet_idx, sheet, header_row, columns, parts): of each sheet with a column that is known. The mapper sees one header a sheet."""
    mapped = header_scores(rows).withColumn("m", _mapped("cells")).select("path", "sheet_idx", "sheet", F.col("row_idx").alias("header_row"), "m.columns", "m.parts")
    return mapped.where((F.size("columns") > 0) | (F.size("parts") > 0))


def plans(rows: DataFrame) -> DataFrame:
    """The plan of each sheet with a column that is known, with its number of ``rows``."""
    return _planned(rows).join(rows.groupBy("path", "sheet_idx").agg(F.count("*").alias("rows")), ["path", "sheet_idx"])


def with_plans(rows: DataFrame, wanted: DataFrame, most: int = BROADCAST_PLANS) -> DataFrame:
    """``rows`` with the plans (path, sheet_idx, ...) of their sheets; a sheet of any length is many tasks."""
    on = ["path", "sheet_idx"]
    if wanted.count() <= most:
        return rows.join(F.broadcast(wanted), on)
    shares = wanted.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return rows.withColumn("_share", F.pmod("row_idx", F.lit(SHARES))).join(shares, [*on, "_share"]).drop("_share")


def plan(rows: DataFrame) -> list[SheetPlan]:
    """The plans of one workbook, for a person or a join plan to look at; a row a sheet comes to the driver."""
    found = plans(rows).collect()
    return [SheetPlan(r.sheet, r.header_row, r.columns, r.parts, r.rows, r.path, r.sheet_idx) for r in sorted(found, key=lambda r: (r.path, r.sheet_idx))]


def role(p: SheetPlan) -> str:
    """``primary`` with an address or many references, ``secondary`` with insured sums and a key, else ``ignore``."""
    keyed = {"property_reference", "block_reference"} & p.columns.keys()
    if p.address or "address" in p.columns:
        return "primary"
    if "sum_insured" in p.columns and keyed:
        return "secondary"
    return "primary" if "property_reference" in p.columns and p.rows > 20 else "ignore"


def join_plan(plans: list[SheetPlan], least_rows: int = 3) -> JoinPlan | None:
    """How the first primary sheet, if it has no insured sums, gets them from the first other sheet with sums and a key."""
    key_of = lambda p: next((p.columns[k] for k in ("block_reference", "property_reference") if k in p.columns), None)
    first = next((p for p in plans if role(p) == "primary"), None)
    if first is None or "sum_insured" in first.columns or key_of(first) is None:
        return None
    for p in plans:
        if p.sheet != first.sheet and p.rows >= least_rows and "sum_insured" in p.columns and key_of(p) is not None:
            return JoinPlan(key_of(first), p.sheet, key_of(p), False, [f for f in p.columns if f not in first.columns])
    return None


def validated(raw: list[dict], sheets: set[str], width: int = 40) -> list[SheetPlan]:
    """Plans from outside: unknown sheets and fields and negative or too large columns are dropped, a missing header row is 0.

    A sheet's name may differ by blanks around it.
    """
    by_name = {name.strip(): name for name in sorted(sheets)}
    plans = []
    for r in raw:
        sheet = r.get("sheet") if r.get("sheet") in sheets else by_name.get(str(r.get("sheet") or "").strip())
        if sheet is None:
            continue
        inside = lambda k: isinstance(k, (int, float)) and not isinstance(k, bool) and 0 <= k < width
        columns = {f: int(k) for f, k in (r.get("columns") or {}).items() if f in FIELDS and inside(k)}
        plans.append(SheetPlan(sheet, int(r.get("header_row") or 0), columns, [int(k) for k in r.get("address") or [] if inside(k)]))
    return plans


def validated_join(raw: dict | None, sheets: set[str]) -> JoinPlan | None:
    """A join plan from outside; none without its three keys or with an unknown sheet. Fields may be names or named objects."""
    needed = ("primary_key", "sheet", "key")
    if not isinstance(raw, dict) or any(k not in raw for k in needed) or raw["sheet"] not in sheets:
        return None
    names = [f.get("name") if isinstance(f, dict) else str(f) for f in raw.get("fields") or []]
    return JoinPlan(int(raw["primary_key"] or 0), raw["sheet"], int(raw["key"] or 0), bool(raw.get("strip_suffix")), [f for f in names if f in FIELDS])


def joined(rows: DataFrame, primary: SheetPlan, plan_: JoinPlan, secondary: SheetPlan) -> DataFrame:
    """The typed rows of ``primary`` with the fields of the join plan from the secondary sheet, by key: exact, bare or by prefix."""
    from groundplan.operators import lookup

    cell = lambda k: F.nullif(F.trim(F.get("cells", F.lit(k))), F.lit(""))
    key = lookup.bare(cell(plan_.key)) if plan_.strip_suffix else cell(plan_.key)
    typed = extract(rows.where(F.col("sheet") == plan_.sheet), secondary, "_key", key)
    fields = [f for f in plan_.fields if f in typed.columns]
    # of a key that comes several times, the first row that has the field
    first = cut(typed.groupBy("_key").agg(F.min("row_idx").alias("order"), *(F.min_by(f, F.when(F.col(f).isNotNull(), F.col("row_idx"))).alias(f"_{f}") for f in fields)))
    base = extract(rows, primary, "_key", cell(plan_.primary_key))
    matches = lookup.references(base.select(F.col("_key").alias("key")), first.select(F.col("_key").alias("key"), "order")).select(F.col("key").alias("_key"), "matched")
    filled = base.join(matches.join(first.withColumnRenamed("_key", "matched").drop("order"), "matched").drop("matched"), "_key", "left")
    return filled.select(*((F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c)) for c in base.columns if c != "_key"))


def keep_row(cells: Column) -> Column:
    """Neither blank nor a total, filter or report line."""
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    total = F.exists(filled, lambda c: (F.length(c) <= 30) & _any(F.lower(c), TOTALS))
    meta = F.exists(filled, lambda c: (F.length(F.trim(c)) > 120) | F.lower(F.trim(c)).rlike("^(filter|report|export):"))
    return (F.size(filled) > 0) & ~total & ~meta


def _typed(body: DataFrame, extra: str | None = None, value: Column | None = None) -> DataFrame:
    """Rows with ``sheet``, ``columns`` and ``parts`` of their plan, typed."""
    text = lambda k: F.nullif(F.trim(F.get("cells", k)), F.lit(""))
    cell = lambda name: text(F.try_element_at("columns", F.lit(name)))
    pieces = F.transform("parts", lambda k: F.coalesce(F.get("cells", k), F.lit("")))
    full = F.when(F.size("parts") > 0, address.assembled(pieces)).otherwise(cell("address"))
    year = values.year(cell("year_of_build"))
    more = [] if extra is None else [value.alias(extra)]
    flag = lambda name: values.schedule_boolean(cell(name)).alias(name)
    typed = body.select(
        *more, "path", "sheet", "sheet_idx", "row_idx", values.clamped(cell("property_reference"), "property_reference").alias("property_reference"), cell("block_reference").alias("block_reference"), address.standard(full).alias("address"),
        F.coalesce(address.postcode(cell("postcode")), address.postcode(full)).alias("postcode"), cell("occupancy_type").alias("occupancy_type"), values.money(cell("sum_insured")).alias("sum_insured"), cell("property_type").alias("property_type"),
        cell("wall_construction").alias("wall_construction"), year.alias("year_of_build"), F.coalesce(age_band(year), cell("age_banding")).alias("age_banding"), values.storeys(cell("storeys")).alias("storeys"), values.whole_number(cell("units")).alias("units"),
        cell("address_2").alias("address_2"), cell("address_3").alias("address_3"), cell("sum_insured_type").alias("sum_insured_type"), cell("avid_property_type").alias("avid_property_type"), cell("roof_construction").alias("roof_construction"),
        cell("floor_construction").alias("floor_construction"), values.whole_number(cell("bedrooms")).alias("bedrooms"), flag("has_basement"), flag("is_listed"), cell("security_features").alias("security_features"),
        cell("fire_protection").alias("fire_protection"), cell("alarms").alias("alarms"), flag("flood_insured"), flag("storm_insured"), values.money(cell("deductible")).alias("deductible"), cell("basis_of_deductible").alias("basis_of_deductible"),
        F.coalesce(values.schedule_boolean(cell("insure_flag")), F.lit(True)).alias("insured"),
    )
    kept = typed.where(F.col("insured") & (F.col("property_reference").isNotNull() | F.col("address").isNotNull() | F.lit(extra is not None))).drop("insured")
    if extra is not None:
        return kept.where(F.col(extra).isNotNull()).drop("sheet")
    # only rows without a reference are numbered
    made = numbered(kept.where(F.col("property_reference").isNull()), ["path", "sheet_idx"], "row_idx", "_nth")
    made = made.withColumn("property_reference", F.concat(F.lit("AUTO_"), "sheet", F.lit("_"), F.lpad(F.col("_nth").cast("string"), 5, "0"))).drop("_nth")
    return kept.where(F.col("property_reference").isNotNull()).unionByName(made).drop("sheet")


def extract(rows: DataFrame, p: SheetPlan, extra: str | None = None, value: Column | None = None) -> DataFrame:
    """The typed properties of one sheet; with ``extra`` a column of that name more, the ``value`` over its cells, which rows must have.

    A plan without a path holds for the sheets of its name in all workbooks.
    """
    own = F.col("sheet") == p.sheet
    if p.path is not None:
        own = own & (F.col("path") == p.path) & (F.col("sheet_idx") == p.sheet_idx)
    columns = F.create_map(*(x for f, k in p.columns.items() for x in (F.lit(f), F.lit(k)))) if p.columns else F.create_map().cast("map<string,int>")
    parts = F.array(*map(F.lit, p.address)).cast("array<int>")
    body = rows.where(own & (F.col("row_idx") > p.header_row) & keep_row(F.col("cells")))
    return _typed(body.withColumns({"columns": columns, "parts": parts}), extra, value)


def properties(rows: DataFrame) -> DataFrame:
    """All workbooks' properties, by the plan of each sheet; of a repeated reference of a workbook the first by sheet and row."""
    from groundplan.operators.relational import first_per_group

    wanted = cut(_planned(rows).where(F.map_contains_key("columns", F.lit("property_reference")) | F.map_contains_key("columns", F.lit("address")) | (F.size("parts") > 0)).drop("sheet"))
    if wanted.isEmpty():
        raise ValueError("no sheet has a reference or an address column")
    body = with_plans(rows, wanted).where((F.col("row_idx") > F.col("header_row")) & keep_row(F.col("cells")))
    # references seldom repeat: dealt first, so that no task sorts all rows of its part of the input to drop some
    dealt = _typed(body).repartition("path", "property_reference")
    return first_per_group(dealt, ["path", "property_reference"], [F.col("sheet_idx"), F.col("row_idx")])
