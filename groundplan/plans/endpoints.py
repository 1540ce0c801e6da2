"""What the application asks for in one request: composition, completeness, readiness, block reports, association statistics.

Each gives the rows of one response for all portfolios or associations at once, so a
request is a filter on its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.functions import rules
from groundplan.plans.aggregates import FORM_SQL, _money, _n, fill_rates, money, n_if
from groundplan.plans.registry import query
from groundplan.plans.relational import latest_fra, latest_fraew, severity
from groundplan.plans.silver import Silver

col = F.col
_FRA = "SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY block_id ORDER BY assessment_date DESC NULLS LAST, created_seq DESC, fra_id DESC) AS rn FROM fra_features f) x WHERE rn = 1"
_FRAEW = "SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY block_id ORDER BY created_seq DESC, fraew_id DESC) AS rn FROM fraew_features f) x WHERE rn = 1"

# --- composition ------------------------------------------------------------

#: Age bands of the composition, with their order.
_BANDS = (("Pre-1919", 1920), ("1920-1944", 1945), ("1945-1979", 1980), ("1980-2000", 2001))
_BAND_SQL = "CASE WHEN build_year IS NULL THEN 'Unknown' " + " ".join(f"WHEN build_year < {y} THEN '{n}'" for n, y in _BANDS) + " ELSE '2001+' END"
_ORDER_SQL = "CASE label " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate((*(n for n, _ in _BANDS), "2001+"), 1)) + " ELSE 6 END"
_ALONE_SQL = "CASE WHEN trim(block_reference) <> '' THEN FALSE WHEN form IN ('house', 'bungalow') THEN TRUE ELSE FALSE END"
_BASE_SQL = f"SELECT portfolio_id, sum_insured, coalesce(tenure, 'Not recorded') AS tenancy, coalesce(block_reference, 'No block') AS block, coalesce(property_type, 'Not recorded') AS kind, {_BAND_SQL} AS age, CASE WHEN responsible_party IN ('RTM', 'Freeholder') THEN 'third_party' ELSE 'ha_controlled' END AS party, coalesce(form, 'unknown') AS form, {_ALONE_SQL} AS alone FROM (SELECT p.*, {FORM_SQL} AS form FROM properties p) y"
#: Breakdown, and the expression of its label.
_BREAKDOWNS = (("tenancy", "tenancy"), ("block", "block"), ("property_type", "kind"), ("age_banding", "age"), ("dwelling", "form"), ("responsible", "concat(kind, ' / ', party)"))


def _breakdown_sql(name: str, label: str) -> str:
    return f"SELECT portfolio_id, '{name}' AS breakdown, {label} AS label, CAST(count(*) AS BIGINT) AS units, {_money('sum_insured')} AS value, {_n('alone')} AS standalone_units FROM base GROUP BY 1, 2, 3"


_COMPOSITION_SQL = f"""WITH base AS ({_BASE_SQL}), parts AS ({' UNION ALL '.join(_breakdown_sql(*b) for b in _BREAKDOWNS)}),
 total AS (SELECT portfolio_id, {_money('sum_insured')} AS total, count(*) AS n FROM base GROUP BY 1)
 SELECT p.*, CASE WHEN breakdown = 'responsible' THEN round(units * 100.0 / n, 1) WHEN total > 0 THEN round(value / total * 100, 1) ELSE 0 END AS pct, breakdown = 'block' AND label <> 'No block' AND value > 5000000 AS over_5m,
  CASE WHEN breakdown = 'age_banding' THEN {_ORDER_SQL} END AS place FROM parts p JOIN total t ON t.portfolio_id = p.portfolio_id"""


def composition_base(s: Silver) -> DataFrame:
    """Properties with the labels of all breakdowns."""
    p = s.properties
    band = F.when(col("build_year").isNull(), "Unknown")
    for name, year in _BANDS:
        band = band.when(col("build_year") < year, name)
    form = rules.dwelling_form(col("property_type"), col("built_form"))
    return p.withColumn("form", form).select(
        "portfolio_id", "sum_insured", F.coalesce("tenure", F.lit("Not recorded")).alias("tenancy"), F.coalesce("block_reference", F.lit("No block")).alias("block"), F.coalesce("property_type", F.lit("Not recorded")).alias("kind"),
        band.otherwise("2001+").alias("age"), F.when(col("responsible_party").isin("RTM", "Freeholder"), "third_party").otherwise("ha_controlled").alias("party"),
        F.coalesce("form", F.lit("unknown")).alias("form"), F.coalesce(rules.is_standalone(col("form"), col("block_reference")), F.lit(False)).alias("alone"),
    )


@query("endpoint_composition", _COMPOSITION_SQL)
def composition(s: Silver) -> DataFrame:
    """All breakdowns of all portfolios in one pass: a row becomes one for each breakdown, which combine before the shuffle."""
    base = composition_base(s)
    labels = F.explode(F.array(*(F.struct(F.lit(n).alias("breakdown"), F.expr(e).alias("label")) for n, e in _BREAKDOWNS))).alias("b")
    parts = base.select("portfolio_id", "sum_insured", "alone", labels).groupBy("portfolio_id", "b.breakdown", "b.label").agg(F.count("*").alias("units"), money("sum_insured").alias("value"), n_if("alone").alias("standalone_units"))
    total = base.groupBy("portfolio_id").agg(money("sum_insured").alias("total"), F.count("*").alias("n"))
    place = reduce(lambda w, kn: w.when(col("label") == kn[1], kn[0]), enumerate((*(n for n, _ in _BANDS), "2001+"), 1), F.when(F.lit(False), 0)).otherwise(6)
    pct = F.when(col("breakdown") == "responsible", F.round(col("units") * F.lit(100.0) / col("n"), 1)).when(col("total") > 0, F.round(col("value") / col("total") * 100, 1)).otherwise(0.0)
    over = (col("breakdown") == "block") & (col("label") != "No block") & (col("value") > 5_000_000)
    return parts.join(total, "portfolio_id").select("portfolio_id", "breakdown", "label", "units", "value", "standalone_units", pct.alias("pct"), over.alias("over_5m"), F.when(col("breakdown") == "age_banding", place).alias("place"))


@query("endpoint_composition_totals", f"""WITH base AS ({_BASE_SQL}), b AS (SELECT portfolio_id, block, sum(sum_insured) AS v FROM base WHERE block <> 'No block' GROUP BY 1, 2), o AS (SELECT portfolio_id, count(*) AS blocks, {_n('v > 5000000')} AS over_5m FROM b GROUP BY 1)
 SELECT t.*, coalesce(blocks, 0) AS block_count, coalesce(over_5m, 0) AS blocks_over_5m FROM (SELECT portfolio_id, count(*) AS units, {_money('sum_insured')} AS value, {_n("block = 'No block'")} AS no_block_units, {_n('alone')} AS standalone_units, {_n("party = 'third_party'")} AS third_party_units,
  {_n("form IN ('garage', 'infrastructure', 'commercial') OR (form IN ('house', 'bungalow') AND alone)")} AS fra_not_required_units FROM base GROUP BY 1) t LEFT JOIN o ON o.portfolio_id = t.portfolio_id""")
def composition_totals(s: Silver) -> DataFrame:
    """The figures beside the breakdowns: blocks, those above five million, standalone units, and units that need no assessment."""
    base = composition_base(s)
    blocks = base.where("block <> 'No block'").groupBy("portfolio_id", "block").agg(F.sum("sum_insured").alias("v")).groupBy("portfolio_id").agg(F.count("*").alias("block_count"), n_if("v > 5000000").alias("blocks_over_5m"))
    free = rules.fra_requirement(col("form"), col("alone")) == "not_required"
    sums = base.groupBy("portfolio_id").agg(F.count("*").alias("units"), money("sum_insured").alias("value"), n_if("block = 'No block'").alias("no_block_units"), n_if("alone").alias("standalone_units"), n_if("party = 'third_party'").alias("third_party_units"), F.count_if(free).alias("fra_not_required_units"))
    return sums.join(blocks, "portfolio_id", "left").fillna(0, ["block_count", "blocks_over_5m"])


# --- completeness and readiness ----------------------------------------------

_DOC_A = ("property_reference", "block_reference", "tenure", "address", "postcode", "units", "sum_insured", "wall_construction", "roof_construction", "build_year", "age_banding", "storeys", "property_listed")
_DOC_B = ("name", "unit_count", "total_sum_insured", "max_storeys", "height_max_m", "predominant_wall", "predominant_roof", "is_listed", "fra_date", "has_sprinkler_system", "has_fire_alarm_system", "has_combustible_cladding", "has_remedial_actions", "building_height_m", "pas_9980_compliant")
_ROOFS = "(SELECT block_id AS roof_block, min(roof_construction) AS predominant_roof FROM (SELECT block_id, roof_construction, row_number() OVER (PARTITION BY block_id ORDER BY count(*) DESC, roof_construction) AS rn FROM properties WHERE roof_construction IS NOT NULL GROUP BY 1, 2) x WHERE rn = 1 GROUP BY 1)"
_DOC_B_SQL = f"SELECT b.*, r.predominant_roof, f.assessment_date AS fra_date, f.has_sprinkler_system, f.has_fire_alarm_system, w.has_combustible_cladding, w.has_remedial_actions, w.building_height_m, w.pas_9980_compliant FROM blocks b LEFT JOIN {_ROOFS} r ON r.roof_block = b.block_id LEFT JOIN ({_FRA}) f ON f.block_id = b.block_id LEFT JOIN ({_FRAEW}) w ON w.block_id = b.block_id"


def _rates_sql(table: str, doc: str, fields: tuple[str, ...]) -> str:
    rates = ", ".join(f"round(avg(CASE WHEN {f} IS NOT NULL THEN 1.0 ELSE 0.0 END), 3) AS f_{f}" for f in fields)
    mean = " + ".join(f"f_{f}" for f in fields)
    each = ", ".join(f"concat('{f}=', CAST(CAST(round(f_{f} * 1000) AS INT) AS VARCHAR))" for f in fields)
    return f"SELECT portfolio_id, '{doc}' AS doc, n AS total, CAST({len(fields)} AS INT) AS total_fields, round(({mean}) / {len(fields)} * 100, 1) AS completeness_pct, concat_ws(',', {each}) AS field_detail FROM (SELECT portfolio_id, count(*) AS n, {rates} FROM {table} GROUP BY 1) z"


def _doc(rows: DataFrame, doc: str, fields: tuple[str, ...]) -> DataFrame:
    rates = fill_rates(rows, ["portfolio_id"], fields).join(rows.groupBy("portfolio_id").agg(F.count("*").alias("total")), "portfolio_id")
    each = [F.concat(F.lit(f"{f}="), F.round(col(f"f_{f}") * 1000).cast("int").cast("string")) for f in fields]
    return rates.select("portfolio_id", F.lit(doc).alias("doc"), "total", F.lit(len(fields)).alias("total_fields"), "completeness_pct", F.concat_ws(",", *each).alias("field_detail"))


@query("endpoint_doc_completeness", _rates_sql("(SELECT p.*, CASE WHEN build_year IS NOT NULL THEN 'x' END AS age_banding FROM properties p) q", "doc_a", _DOC_A) + " UNION ALL " + _rates_sql(f"({_DOC_B_SQL}) q", "doc_b", _DOC_B))
def doc_completeness(s: Silver) -> DataFrame:
    """Thirteen fields of each property and fifteen of each block, its documents among them; rates per mille in ``field_detail``."""
    stock = s.properties.withColumn("age_banding", F.when(col("build_year").isNotNull(), "x"))
    fra = latest_fra(s, ("assessment_date", "has_sprinkler_system", "has_fire_alarm_system")).withColumnRenamed("assessment_date", "fra_date")
    walls = latest_fraew(s, ("has_combustible_cladding", "has_remedial_actions", "building_height_m", "pas_9980_compliant"), by_created=True)
    counted = s.properties.where("roof_construction is not null").groupBy("block_id", "roof_construction").agg(F.count("*").alias("n"))
    roofs = counted.groupBy("block_id").agg(F.min(F.struct(-col("n"), "roof_construction"))["roof_construction"].alias("predominant_roof"))
    blocks = s.blocks.join(roofs, "block_id", "left").join(fra, "block_id", "left").join(walls, "block_id", "left")
    return _doc(stock, "doc_a", _DOC_A).unionByName(_doc(blocks, "doc_b", _DOC_B))


_READY = (("uprn", "uprn IS NOT NULL"), ("postcode", "postcode IS NOT NULL"), ("geo", "latitude IS NOT NULL AND longitude IS NOT NULL"), ("height", "height_m IS NOT NULL"), ("build_year", "build_year IS NOT NULL"), ("construction", "wall_construction IS NOT NULL"), ("risk_rating", "risk_rating IS NOT NULL"))


@query("gold_readiness_v1", "SELECT portfolio_id, ha_id, count(*) AS total_properties, " + ", ".join(f"round(avg(CASE WHEN {p} THEN 1.0 ELSE 0.0 END), 2) AS pct_has_{n}" for n, p in _READY) + " FROM properties GROUP BY 1, 2")
def readiness(s: Silver) -> DataFrame:
    """Per portfolio the shares of properties that have each field."""
    return s.properties.groupBy("portfolio_id", "ha_id").agg(F.count("*").alias("total_properties"), *(F.round(F.avg(F.expr(p).cast("double")), 2).alias(f"pct_has_{n}") for n, p in _READY))


@query("endpoint_readiness", "SELECT r.*, round((" + " + ".join(f"pct_has_{n}" for n, _ in _READY) + ") / 7 * 100, 1) AS readiness FROM (SELECT portfolio_id, " + ", ".join(f"round(avg(CASE WHEN {p} THEN 1.0 ELSE 0.0 END), 2) AS pct_has_{n}" for n, p in _READY) + " FROM properties GROUP BY 1) r")
def readiness_score(s: Silver) -> DataFrame:
    shares = readiness(s).drop("ha_id", "total_properties")
    mean = reduce(lambda a, b: a + b, (col(f"pct_has_{n}") for n, _ in _READY)) / 7
    return shares.withColumn("readiness", F.round(mean * 100, 1))


# --- reports of a block -------------------------------------------------------

_FRAEW_FIELDS = ("fraew_id", "rag_status", "assessment_date", "assessment_valid_until", "building_height_m", "num_storeys", "retrofit_year", "has_combustible_cladding", "eps_insulation_present", "aluminium_composite_cladding", "bs8414_test_evidence", "interim_measures_required", "has_remedial_actions", "pas_9980_compliant", "asbestos_suspected")
_RANK = "CASE {0} WHEN 'RED' THEN 1 WHEN 'AMBER' THEN 2 WHEN 'GREEN' THEN 3 ELSE 4 END"


@query("endpoint_fraew_blocks", f"SELECT b.portfolio_id, b.block_id, b.name AS block_name, b.unit_count, b.height_max_m, b.total_sum_insured, {', '.join(f'CAST(w.{c} AS DATE) AS {c}' if c == 'assessment_valid_until' else f'w.{c}' for c in _FRAEW_FIELDS)}, f.rag_status AS fra_rag, {_RANK.format('w.rag_status')} AS severity FROM blocks b LEFT JOIN ({_FRAEW}) w ON w.block_id = b.block_id LEFT JOIN ({_FRA}) f ON f.block_id = b.block_id")
def fraew_blocks(s: Silver) -> DataFrame:
    """Each block with the last external wall report that came in, and the rating of its latest fire risk assessment."""
    walls = latest_fraew(s, _FRAEW_FIELDS, by_created=True)
    fra = latest_fra(s, ("rag_status",)).withColumnRenamed("rag_status", "fra_rag")
    blocks = s.blocks.select("portfolio_id", "block_id", col("name").alias("block_name"), "unit_count", "height_max_m", "total_sum_insured")
    return blocks.join(walls, "block_id", "left").join(fra, "block_id", "left").withColumn("severity", severity("rag_status"))


@query("endpoint_fraew_summary", f"SELECT b.portfolio_id, count(*) AS total_blocks, {_n(chr(39).join(('w.rag_status = ', 'RED', '')))} AS red, {_n(chr(39).join(('w.rag_status = ', 'AMBER', '')))} AS amber, {_n(chr(39).join(('w.rag_status = ', 'GREEN', '')))} AS green, {_n('w.rag_status IS NULL')} AS unassessed, {_n('w.has_combustible_cladding')} AS combustible_cladding, {_n(chr(39).join(('w.has_combustible_cladding AND w.bs8414_test_evidence = ', 'no', '')))} AS no_bs8414_evidence FROM blocks b LEFT JOIN ({_FRAEW}) w ON w.block_id = b.block_id GROUP BY 1")
def fraew_summary(s: Silver) -> DataFrame:
    rated = {"red": "rag_status = 'RED'", "amber": "rag_status = 'AMBER'", "green": "rag_status = 'GREEN'", "unassessed": "rag_status is null", "combustible_cladding": "has_combustible_cladding", "no_bs8414_evidence": "has_combustible_cladding and bs8414_test_evidence = 'no'"}
    return fraew_blocks(s).groupBy("portfolio_id").agg(F.count("*").alias("total_blocks"), *(n_if(p).alias(n) for n, p in rated.items()))


_ACTIONS = ("total_action_count", "overdue_action_count", "outstanding_action_count", "high_action_count", "no_date_action_count")


@query("endpoint_fra_block_actions", f"SELECT b.ha_id, b.block_id, b.name AS block_name, f.fra_id, f.rag_status, f.assessment_date, CAST(f.assessment_valid_until AS DATE) AS assessment_valid_until, {', '.join(f'coalesce(f.{c}, 0) AS {c}' for c in _ACTIONS)}, CASE WHEN f.fra_id IS NULL THEN 'No FRA on record for this block.' END AS message FROM blocks b LEFT JOIN ({_FRA}) f ON f.block_id = b.block_id")
def fra_block_actions(s: Silver) -> DataFrame:
    """The action counts of each block's latest fire risk assessment."""
    last = latest_fra(s, ("fra_id", "rag_status", "assessment_date", "assessment_valid_until", *_ACTIONS))
    joined = s.blocks.select("ha_id", "block_id", col("name").alias("block_name")).join(last, "block_id", "left").fillna(0, list(_ACTIONS))
    return joined.withColumn("message", F.when(col("fra_id").isNull(), "No FRA on record for this block."))


# --- statistics of an association ----------------------------------------------

_HAVE = (("uprn", "uprn IS NOT NULL"), ("postcode", "postcode IS NOT NULL"), ("geocoding", "latitude IS NOT NULL AND longitude IS NOT NULL"), ("risk_rating", "risk_rating IS NOT NULL"), ("height", "height_m IS NOT NULL"), ("build_year", "build_year IS NOT NULL"))
_SUMMARY_SQL = "SELECT ha_id, count(*) AS total_properties, " + ", ".join(f"round(count(CASE WHEN {p} THEN 1 END) * 100.0 / count(*), 1) AS {n}_percentage" for n, p in _HAVE) + " FROM properties GROUP BY 1"


@query("endpoint_ha_stats", f"SELECT c.*, round((uprn_percentage + postcode_percentage + geocoding_percentage + risk_rating_percentage) / 4, 1) AS data_quality_score FROM ({_SUMMARY_SQL}) c")
def ha_stats(s: Silver) -> DataFrame:
    """Completeness of each association's properties, and its quality score."""
    counted = s.properties.groupBy("ha_id").agg(F.count("*").alias("total_properties"), *(F.round(n_if(p) * F.lit(100.0) / F.count("*"), 1).alias(f"{n}_percentage") for n, p in _HAVE))
    return counted.withColumn("data_quality_score", F.round((col("uprn_percentage") + col("postcode_percentage") + col("geocoding_percentage") + col("risk_rating_percentage")) / 4, 1))


def _with_share(counted: DataFrame, total: DataFrame) -> DataFrame:
    return counted.join(total, "ha_id").withColumn("percentage", F.round(col("count") * F.lit(100.0) / col("total"), 1)).drop("total")


@query("endpoint_ha_risk_distribution", "SELECT p.ha_id, risk_rating, count(*) AS count, round(count(*) * 100.0 / max(t.n), 1) AS percentage FROM properties p JOIN (SELECT ha_id, count(*) AS n FROM properties GROUP BY 1) t ON t.ha_id = p.ha_id WHERE risk_rating IS NOT NULL GROUP BY 1, 2")
def ha_risk_distribution(s: Silver) -> DataFrame:
    total = s.properties.groupBy("ha_id").agg(F.count("*").alias("total"))
    return _with_share(s.properties.where("risk_rating is not null").groupBy("ha_id", "risk_rating").agg(F.count("*").alias("count")), total)


@query("endpoint_ha_height_bands", "SELECT p.ha_id, CASE WHEN height_m < 11 THEN '<11m' WHEN height_m < 18 THEN '11-18m' WHEN height_m < 30 THEN '18-30m' WHEN height_m >= 30 THEN '30m+' ELSE 'Unknown' END AS height_band, count(*) AS count, CAST(coalesce(sum(units), 0) AS BIGINT) AS total_units, round(count(*) * 100.0 / max(t.n), 1) AS percentage FROM properties p JOIN (SELECT ha_id, count(*) AS n FROM properties GROUP BY 1) t ON t.ha_id = p.ha_id GROUP BY 1, 2")
def ha_height_bands(s: Silver) -> DataFrame:
    band = F.when(col("height_m") < 11, "<11m").when(col("height_m") < 18, "11-18m").when(col("height_m") < 30, "18-30m").when(col("height_m") >= 30, "30m+").otherwise("Unknown")
    total = s.properties.groupBy("ha_id").agg(F.count("*").alias("total"))
    return _with_share(s.properties.groupBy("ha_id", band.alias("height_band")).agg(F.count("*").alias("count"), F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("total_units")), total)


@query("endpoint_ha_data_gaps", "SELECT ha_id, count(*) AS total_properties, " + ", ".join(f"{_n(f'NOT ({p})')} AS missing_{n}" for n, p in _HAVE) + " FROM properties GROUP BY 1")
def ha_data_gaps(s: Silver) -> DataFrame:
    return s.properties.groupBy("ha_id").agg(F.count("*").alias("total_properties"), *(n_if(f"not ({p})").alias(f"missing_{n}") for n, p in _HAVE))


_CRITICAL = _HAVE[:4]


def _missing(pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.array_compact(F.array(*(F.when(~F.expr(p), n) for n, p in pairs)))


@query("endpoint_ha_critical_gaps", "SELECT ha_id, property_id, uprn, address, postcode, risk_rating, missing_fields, gap_count FROM (SELECT p.*, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({p}) THEN '{n}' END" for n, p in _CRITICAL) + ") AS missing_fields, CAST(" + " + ".join(f"CASE WHEN {p} THEN 0 ELSE 1 END" for _, p in _CRITICAL) + " AS INT) AS gap_count FROM properties p) x WHERE gap_count >= 2")
def ha_critical_gaps(s: Silver) -> DataFrame:
    """Properties that lack at least two of the four critical fields."""
    found = _missing(_CRITICAL)
    rows = s.properties.withColumns({"missing_fields": F.array_join(found, ","), "gap_count": F.size(found)})
    return rows.where("gap_count >= 2").select("ha_id", "property_id", "uprn", "address", "postcode", "risk_rating", "missing_fields", "gap_count")
