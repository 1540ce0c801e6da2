"""Aggregations: counts, modes, shares, fill rates, pivots, coverage and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.functions import rules
from groundplan.functions.bands import age_band, height_band
from groundplan.operators import relational as ops
from groundplan.operators import spatial
from groundplan.plans.registry import query
from groundplan.plans.relational import ASSESSED, assessed_blocks, latest_fra, latest_fraew
from groundplan.plans.silver import AS_OF, Silver

col = F.col
_AGE = "CASE WHEN build_year IS NULL THEN NULL WHEN build_year < 1919 THEN 'Pre-1919' WHEN build_year < 1945 THEN '1919-1944' WHEN build_year < 1965 THEN '1945-1964' WHEN build_year < 1981 THEN '1965-1980' WHEN build_year < 1991 THEN '1981-1990' WHEN build_year < 2001 THEN '1991-2000' WHEN build_year < 2011 THEN '2001-2010' ELSE 'Post-2010' END"


FORM_SQL = f"coalesce({rules.keywords_sql('property_type', rules.DWELLING_FORMS, 'other')}, {rules.keywords_sql('built_form', rules.DWELLING_FORMS, 'other')})"


def money(c: Column | str) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0)), 2).cast("double")


def _money(c: str) -> str:
    return f"CAST(round(coalesce(sum({c}), 0), 2) AS DOUBLE)"


def n_if(p: Column | str) -> Column:
    return F.count_if(F.expr(p) if isinstance(p, str) else p)


def _n(p: str) -> str:
    return f"CAST(count(CASE WHEN {p} THEN 1 END) AS BIGINT)"


@query("agg_01", f"SELECT portfolio_id, count(*) AS n, {_money('sum_insured')} AS total, CAST(min(sum_insured) AS DOUBLE) AS least, CAST(max(sum_insured) AS DOUBLE) AS most, round(CAST(avg(sum_insured) AS DOUBLE), 2) AS mean FROM properties GROUP BY 1")
def basic(s: Silver) -> DataFrame:
    return s.properties.groupBy("portfolio_id").agg(F.count("*").alias("n"), money("sum_insured").alias("total"), F.min("sum_insured").cast("double").alias("least"), F.max("sum_insured").cast("double").alias("most"), F.round(F.avg("sum_insured").cast("double"), 2).alias("mean"))


@query("agg_02", "SELECT ha_id, count(DISTINCT portfolio_id) AS portfolios, count(DISTINCT block_reference) AS blocks, count(DISTINCT postcode) AS postcodes FROM properties GROUP BY 1")
def distinct_counts(s: Silver) -> DataFrame:
    return s.properties.groupBy("ha_id").agg(F.countDistinct("portfolio_id").alias("portfolios"), F.countDistinct("block_reference").alias("blocks"), F.countDistinct("postcode").alias("postcodes"))


@query("agg_03", f"SELECT portfolio_id, {_n('height_max_m < 11')} AS under_11m, {_n('height_max_m >= 11 AND height_max_m < 18')} AS m11_18, {_n('height_max_m >= 18 AND height_max_m < 30')} AS m18_30, {_n('height_max_m >= 30')} AS over_30m, {_n('has_combustible_cladding')} AS combustible FROM ({ASSESSED}) a GROUP BY 1")
def distinct_filtered(s: Silver) -> DataFrame:
    """One row per block, so a filtered count of distinct blocks is a filtered count."""
    bands = {"under_11m": "height_max_m < 11", "m11_18": "height_max_m >= 11 and height_max_m < 18", "m18_30": "height_max_m >= 18 and height_max_m < 30", "over_30m": "height_max_m >= 30", "combustible": "has_combustible_cladding"}
    return assessed_blocks(s).groupBy("portfolio_id").agg(*(n_if(p).alias(n) for n, p in bands.items()))


@query("agg_04", f"SELECT portfolio_id, {_n('risk_rating = ' + chr(39) + 'A' + chr(39))} AS rated_a, CAST(round(coalesce(sum(CASE WHEN block_reference IS NULL THEN sum_insured END), 0), 2) AS DOUBLE) AS no_block_value FROM properties GROUP BY 1")
def filtered(s: Silver) -> DataFrame:
    return s.properties.groupBy("portfolio_id").agg(n_if("risk_rating = 'A'").alias("rated_a"), money(F.when(col("block_reference").isNull(), col("sum_insured"))).alias("no_block_value"))


@query("agg_05", "SELECT portfolio_id, bool_or(is_listed) AS any_listed, bool_and(height_max_m < 41) AS all_low FROM blocks GROUP BY 1")
def booleans(s: Silver) -> DataFrame:
    return s.blocks.groupBy("portfolio_id").agg(F.bool_or("is_listed").alias("any_listed"), F.bool_and(col("height_max_m") < 41).alias("all_low"))


def _mode_sql(key: str, value: str, tie: str, nulls: bool = False) -> str:
    keep = "" if nulls else f"WHERE {value} IS NOT NULL"
    return f"SELECT {key}, {value} FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {tie}) AS rn FROM properties {keep} GROUP BY {key}, {value}) x WHERE rn = 1"


@query("agg_06", _mode_sql("block_reference", "wall_construction", "wall_construction"))
def mode_smallest(s: Silver) -> DataFrame:
    return ops.mode(s.properties, ["block_reference"], "wall_construction")


@query("agg_07", _mode_sql("block_reference", "property_type", "min(property_id)", nulls=True))
def mode_first_inserted(s: Silver) -> DataFrame:
    """Null is a candidate, and a tie goes to the value of the first row."""
    counted = s.properties.groupBy("block_reference", "property_type").agg(F.count("*").alias("n"), F.min("property_id").alias("first"))
    return ops.first_per_group(counted, ["block_reference"], [col("n").desc(), col("first")]).select("block_reference", "property_type")


_FLAGS = ("uprn", "postcode", "latitude", "build_year", "wall_construction", "risk_rating")


@query("agg_08", "SELECT portfolio_id, " + ", ".join(f"round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END), 2) AS pct_has_{c}" for c in _FLAGS) + " FROM properties GROUP BY 1")
def flag_shares(s: Silver) -> DataFrame:
    return s.properties.groupBy("portfolio_id").agg(*(F.round(F.avg(col(c).isNotNull().cast("double")), 2).alias(f"pct_has_{c}") for c in _FLAGS))


_FIELDS = ("property_reference", "block_reference", "property_type", "address", "postcode", "units", "sum_insured", "wall_construction", "build_year", "epc_rating", "tenure", "responsible_party", "uprn")


def fill_rates(df: DataFrame, keys: list[str], fields: tuple[str, ...], scale: int = 3) -> DataFrame:
    """Per group the share of filled fields, and the mean share in percent."""
    rates = df.groupBy(*keys).agg(*(F.round(F.avg(col(c).isNotNull().cast("double")), scale).alias(f"f_{c}") for c in fields))
    mean = reduce(lambda a, b: a + b, (col(f"f_{c}") for c in fields)) / len(fields)
    return rates.withColumn("completeness_pct", F.round(mean * 100, 1))


def _fill_sql(table: str, key: str, fields: tuple[str, ...]) -> str:
    inner = ", ".join(f"round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END), 3) AS f_{c}" for c in fields)
    mean = " + ".join(f"f_{c}" for c in fields)
    return f"SELECT r.*, round(({mean}) / {len(fields)} * 100, 1) AS completeness_pct FROM (SELECT {key}, {inner} FROM {table} GROUP BY 1) r"


@query("agg_09", _fill_sql("properties", "portfolio_id", _FIELDS))
def field_fill(s: Silver) -> DataFrame:
    return fill_rates(s.properties, ["portfolio_id"], _FIELDS)


_BLOCK_FIELDS = ("name", "unit_count", "total_sum_insured", "max_storeys", "height_max_m", "predominant_wall", "is_listed", "fra_date", "fra_rag", "fraew_rag", "has_combustible_cladding", "bs8414_test_evidence")


@query("agg_10", _fill_sql(f"({ASSESSED}) a", "portfolio_id", _BLOCK_FIELDS))
def block_fill(s: Silver) -> DataFrame:
    return fill_rates(assessed_blocks(s), ["portfolio_id"], _BLOCK_FIELDS)


@query("agg_11", f"SELECT t.*, round(total / sum(total) OVER () * 100, 1) AS pct FROM (SELECT coalesce(property_type, 'Not recorded') AS type, count(*) AS units, {_money('sum_insured')} AS total FROM properties GROUP BY 1) t")
def share(s: Silver) -> DataFrame:
    grouped = s.properties.groupBy(F.coalesce("property_type", F.lit("Not recorded")).alias("type")).agg(F.count("*").alias("units"), money("sum_insured").alias("total"))
    return ops.share_of_total(grouped, "total", "pct")


@query("agg_12", "SELECT portfolio_id, count(*) AS blocks, CAST(count(CASE WHEN t > 500000 THEN 1 END) AS BIGINT) AS large FROM (SELECT portfolio_id, block_reference, sum(sum_insured) AS t FROM properties WHERE block_reference IS NOT NULL GROUP BY 1, 2) x GROUP BY 1")
def over_threshold(s: Silver) -> DataFrame:
    blocks = s.properties.where(col("block_reference").isNotNull()).groupBy("portfolio_id", "block_reference").agg(F.sum("sum_insured").alias("t"))
    return blocks.groupBy("portfolio_id").agg(F.count("*").alias("blocks"), n_if("t > 500000").alias("large"))


_PARTIES = ("Landlord", "Freeholder", "RTM")


@query("agg_13", "SELECT coalesce(property_type, 'Not recorded') AS type, " + ", ".join(f"{_n(f'responsible_party = {chr(39)}{p}{chr(39)}')} AS {p.lower()}" for p in _PARTIES) + f", {_n('responsible_party IS NULL')} AS unassigned, count(*) AS total FROM properties GROUP BY 1")
def party_pivot(s: Silver) -> DataFrame:
    party = {p.lower(): col("responsible_party") == p for p in _PARTIES} | {"unassigned": col("responsible_party").isNull()}
    return s.properties.groupBy(F.coalesce("property_type", F.lit("Not recorded")).alias("type")).agg(*(n_if(p).alias(n) for n, p in party.items()), F.count("*").alias("total"))


@query("agg_14", "SELECT CASE WHEN height_max_m IS NULL THEN 'Unknown' WHEN height_max_m < 11 THEN '<11m' WHEN height_max_m < 18 THEN '11-18m' WHEN height_max_m < 30 THEN '18-30m' ELSE '30m+' END AS band, count(*) AS n FROM blocks GROUP BY 1 ORDER BY min(height_max_m) NULLS LAST")
def height_buckets(s: Silver) -> DataFrame:
    return s.blocks.groupBy(height_band(col("height_max_m")).alias("band")).agg(F.count("*").alias("n"), F.min("height_max_m").alias("o")).orderBy(col("o").asc_nulls_last()).drop("o")


@query("agg_15", "SELECT block_reference, min(CASE WHEN regexp_matches(y, '^[0-9]{{4}}$') THEN CAST(y AS INT) END) AS oldest FROM (SELECT block_reference, CASE WHEN property_id % 5 = 0 THEN 'c. 1900' WHEN build_year IS NULL THEN NULL ELSE CAST(build_year AS VARCHAR) END AS y FROM properties) x GROUP BY 1")
def guarded_min(s: Silver) -> DataFrame:
    year = F.when(col("property_id") % 5 == 0, "c. 1900").otherwise(col("build_year").cast("string"))
    numeric = F.when(col("y").rlike(r"^\d{4}$"), col("y").try_cast("int"))
    return s.properties.withColumn("y", year).groupBy("block_reference").agg(F.min(numeric).alias("oldest"))


@query("agg_16", "SELECT block_reference, CAST(coalesce(sum(CASE WHEN property_id % 2 = 0 THEN NULL ELSE units END), count(*)) AS BIGINT) AS units FROM properties GROUP BY 1")
def units_or_rows(s: Silver) -> DataFrame:
    units = F.when(col("property_id") % 2 != 0, col("units"))
    return s.properties.groupBy("block_reference").agg(F.coalesce(F.sum(units), F.count("*")).alias("units"))


@query("agg_17", "SELECT block_reference, CAST(round(sum(sum_insured) * 0.25, 2) AS DOUBLE) AS lor_value, CAST(round(sum(sum_insured) * 1.25, 2) AS DOUBLE) AS tiv FROM properties GROUP BY 1")
def derived_money(s: Silver) -> DataFrame:
    total = F.sum("sum_insured")
    return s.properties.groupBy("block_reference").agg(F.round(total * F.lit(0.25).cast("decimal(3,2)"), 2).cast("double").alias("lor_value"), F.round(total * F.lit(1.25).cast("decimal(3,2)"), 2).cast("double").alias("tiv"))


def validation_pivot(df: DataFrame, key: str) -> DataFrame:
    """Units and value by a key, blank for null, with a grand total row; units of null or 0 count 1."""
    units = F.when(F.coalesce("units", F.lit(0)) == 0, 1).otherwise(col("units"))
    label = F.coalesce(key, F.lit("(blank)"))
    rolled = df.withColumn("label", label).rollup("label").agg(F.grouping("label").alias("g"), F.sum(units).alias("units"), money("sum_insured").alias("value"))
    return rolled.select(F.when(col("g") == 1, "Grand Total").otherwise(col("label")).alias("label"), "units", "value")


def _pivot_sql(key: str) -> str:
    units = "CAST(sum(CASE WHEN coalesce(units, 0) = 0 THEN 1 ELSE units END) AS BIGINT) AS units"
    return f"SELECT coalesce({key}, '(blank)') AS label, {units}, {_money('sum_insured')} AS value FROM properties GROUP BY 1 UNION ALL SELECT 'Grand Total', {units}, {_money('sum_insured')} FROM properties"


@query("agg_18_tenancy", _pivot_sql("tenure"))
def pivot_tenancy(s: Silver) -> DataFrame:
    return validation_pivot(s.properties, "tenure")


@query("agg_18_type", _pivot_sql("property_type"))
def pivot_type(s: Silver) -> DataFrame:
    return validation_pivot(s.properties, "property_type")


@query("agg_18_age", _pivot_sql(f"({_AGE})"))
def pivot_age(s: Silver) -> DataFrame:
    return validation_pivot(s.properties.withColumn("age", age_band(col("build_year"))), "age")


@query("agg_18_block", "SELECT p.*, CAST(round(CAST(value AS DECIMAL(18,2)) * 0.25, 2) AS DOUBLE) AS lor, CASE WHEN label = 'Grand Total' THEN '' WHEN value * 1.25 > 500000 THEN 'Yes' ELSE 'No' END AS large FROM (" + _pivot_sql("block_reference") + ") p")
def pivot_block(s: Silver) -> DataFrame:
    large = F.when(col("label") == "Grand Total", "").when(col("value") * 1.25 > 500000, "Yes").otherwise("No")
    return validation_pivot(s.properties, "block_reference").withColumns({"lor": F.round(col("value").cast("decimal(18,2)") * F.lit(0.25).cast("decimal(3,2)"), 2).cast("double"), "large": large})


@query("agg_19", f"SELECT coalesce(tenure, 'Unknown') AS k, count(*) AS n, {_money('sum_insured')} AS value FROM properties GROUP BY 1 ORDER BY value DESC, n DESC")
def breakdown(s: Silver) -> DataFrame:
    return s.properties.groupBy(F.coalesce("tenure", F.lit("Unknown")).alias("k")).agg(F.count("*").alias("n"), money("sum_insured").alias("value")).orderBy(col("value").desc(), col("n").desc())


@query("agg_20", "SELECT coalesce(epc_rating, 'Unknown') AS bucket, count(*) AS n FROM properties GROUP BY 1 ORDER BY CASE WHEN coalesce(epc_rating, 'Unknown') = 'Unknown' THEN 1 ELSE 0 END, bucket")
def buckets_unknown_last(s: Silver) -> DataFrame:
    return s.properties.groupBy(F.coalesce("epc_rating", F.lit("Unknown")).alias("bucket")).agg(F.count("*").alias("n")).orderBy(col("bucket") == "Unknown", "bucket")


_COVER = ("address", "postcode", "sum_insured", "block_reference", "tenure", "wall_construction", "build_year", "units", "property_type")


@query("agg_21", "SELECT x.*, CASE WHEN pct >= 90 THEN 'good' WHEN pct >= 50 THEN 'partial' ELSE 'poor' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS populated, count(*) AS total, round(100.0 * count({c}) / count(*), 1) AS pct FROM properties" for c in _COVER) + ") x")
def coverage_report(s: Silver) -> DataFrame:
    """One aggregation over all fields, then unpivoted."""
    one = s.properties.agg(*(F.count(c).alias(c) for c in _COVER), F.count("*").alias("total"))
    rows = one.unpivot("total", list(_COVER), "field", "populated")
    pct = F.round(col("populated") * 100.0 / col("total"), 1).cast("double")
    return rows.withColumn("pct", pct).select("field", "populated", "total", "pct", F.when(col("pct") >= 90, "good").when(col("pct") >= 50, "partial").otherwise("poor").alias("status"))


@query("agg_22", "SELECT portfolio_id, " + ", ".join(f"{_n(f'enrichment_status = {chr(39)}{k}{chr(39)}')} AS {k}" for k in ("enriched", "pending", "failed")) + ", count(uprn) AS with_uprn, count(DISTINCT block_reference) AS blocks FROM properties GROUP BY 1")
def enrichment_status(s: Silver) -> DataFrame:
    return s.properties.groupBy("portfolio_id").agg(*(n_if(col("enrichment_status") == k).alias(k) for k in ("enriched", "pending", "failed")), F.count("uprn").alias("with_uprn"), F.countDistinct("block_reference").alias("blocks"))


@query("agg_23", "SELECT ha_id, count(*) AS properties, count(uprn) AS with_uprn, count(epc_rating) AS with_epc, round(100.0 * count(CASE WHEN enrichment_status = 'enriched' THEN 1 END) / count(*), 1) AS enriched_pct FROM properties GROUP BY 1")
def enrichment_summary(s: Silver) -> DataFrame:
    done = F.round(n_if("enrichment_status = 'enriched'") * 100.0 / F.count("*"), 1).cast("double")
    return s.properties.groupBy("ha_id").agg(F.count("*").alias("properties"), F.count("uprn").alias("with_uprn"), F.count("epc_rating").alias("with_epc"), done.alias("enriched_pct"))


@query("agg_24", "SELECT portfolio_id, risk_rating, count(*) AS n FROM properties GROUP BY 1, 2")
def risk_distribution(s: Silver) -> DataFrame:
    return s.properties.groupBy("portfolio_id", "risk_rating").agg(F.count("*").alias("n"))


@query("agg_25", f"SELECT ha_id, {_n('uprn IS NULL')} AS missing_uprn, {_n('postcode IS NULL')} AS missing_postcode, {_n('latitude IS NULL OR longitude IS NULL')} AS missing_geo, {_n('sum_insured IS NULL')} AS missing_value FROM properties GROUP BY 1")
def gap_counts(s: Silver) -> DataFrame:
    gaps = {"missing_uprn": "uprn is null", "missing_postcode": "postcode is null", "missing_geo": "latitude is null or longitude is null", "missing_value": "sum_insured is null"}
    return s.properties.groupBy("ha_id").agg(*(n_if(p).alias(n) for n, p in gaps.items()))


@query("agg_26", "SELECT ha_id, round(100.0 * count(uprn) / count(*), 1) AS uprn_pct, round(100.0 * count(postcode) / count(*), 1) AS postcode_pct, round((round(100.0 * count(uprn) / count(*), 1) + round(100.0 * count(postcode) / count(*), 1) + round(100.0 * count(latitude) / count(*), 1) + round(100.0 * count(risk_rating) / count(*), 1)) / 4, 1) AS quality FROM properties GROUP BY 1")
def quality_score(s: Silver) -> DataFrame:
    pct = lambda c: F.round(F.count(c) * F.lit(100.0) / F.count("*"), 1)
    mean = F.round((pct("uprn") + pct("postcode") + pct("latitude") + pct("risk_rating")) / 4, 1)
    return s.properties.groupBy("ha_id").agg(pct("uprn").alias("uprn_pct"), pct("postcode").alias("postcode_pct"), mean.alias("quality"))


@query("agg_27", f"SELECT portfolio_id, block_reference, count(*) AS unit_count, {_money('sum_insured')} AS total, min(build_year) AS oldest FROM properties WHERE block_reference IS NOT NULL GROUP BY 1, 2")
def block_aggregate(s: Silver) -> DataFrame:
    return s.properties.where(col("block_reference").isNotNull()).groupBy("portfolio_id", "block_reference").agg(F.count("*").alias("unit_count"), money("sum_insured").alias("total"), F.min("build_year").alias("oldest"))


_KPI = {
    "fra_red_count": "fra_rag = 'RED'", "fra_amber_count": "fra_rag = 'AMBER'", "fra_green_count": "fra_rag = 'GREEN'", "fra_unassessed_count": "fra_rag IS NULL", "fra_assessed_count": "fra_rag IS NOT NULL",
    "fraew_assessed_count": "fraew_rag IS NOT NULL", "fraew_unassessed_count": "fraew_rag IS NULL", "fraew_red_count": "fraew_rag = 'RED'", "fraew_amber_count": "fraew_rag = 'AMBER'", "fraew_green_count": "fraew_rag = 'GREEN'",
    "combustible_cladding_blocks": "has_combustible_cladding", "eps_insulation_blocks": "eps_insulation_present", "acm_cladding_blocks": "aluminium_composite_cladding",
    "blocks_under_11m": "height_max_m < 11", "blocks_11_to_18m": "height_max_m >= 11 AND height_max_m < 18", "blocks_18_to_30m": "height_max_m >= 18 AND height_max_m < 30", "blocks_over_30m": "height_max_m >= 30",
    "listed_blocks": "is_listed", "fraew_18m_total": "height_max_m >= 18", "fraew_18m_assessed": "height_max_m >= 18 AND fraew_rag IS NOT NULL", "fraew_18m_awaiting": "height_max_m >= 18 AND fraew_rag IS NULL",
}


@query("agg_28", f"""SELECT b.portfolio_id, b.ha_id, b.total_blocks, b.total_units, b.total_insured_value, {', '.join('b.' + k for k in _KPI)}, coalesce(p.total_properties, 0) AS total_properties, coalesce(p.enriched_properties, 0) AS enriched_properties, coalesce(p.pending_properties, 0) AS pending_properties
 FROM (SELECT portfolio_id, ha_id, count(*) AS total_blocks, CAST(sum(unit_count) AS BIGINT) AS total_units, {_money('total_sum_insured')} AS total_insured_value, {', '.join(f'{_n(p)} AS {k}' for k, p in _KPI.items())} FROM ({ASSESSED}) a GROUP BY 1, 2) b
 LEFT JOIN (SELECT portfolio_id, count(*) AS total_properties, {_n("enrichment_status = 'enriched'")} AS enriched_properties, {_n("enrichment_status = 'pending'")} AS pending_properties FROM properties GROUP BY 1) p ON p.portfolio_id = b.portfolio_id""")
def portfolio_summary(s: Silver) -> DataFrame:
    """The dashboard's key figures per portfolio."""
    blocks = assessed_blocks(s).groupBy("portfolio_id", "ha_id").agg(
        F.count("*").alias("total_blocks"), F.sum("unit_count").alias("total_units"), money("total_sum_insured").alias("total_insured_value"), *(n_if(p).alias(k) for k, p in _KPI.items())
    )
    props = s.properties.groupBy("portfolio_id").agg(F.count("*").alias("total_properties"), n_if("enrichment_status = 'enriched'").alias("enriched_properties"), n_if("enrichment_status = 'pending'").alias("pending_properties"))
    counts = ("total_properties", "enriched_properties", "pending_properties")
    joined = blocks.join(props, "portfolio_id", "left")
    return joined.select(*blocks.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


@query("agg_29", f"SELECT portfolio_id, count(*) AS properties, {_money('sum_insured')} AS value, " + ", ".join(f"{_n(f'property_type = {chr(39)}{t}{chr(39)}')} AS {n}" for n, t in (("flats", "Flat"), ("bungalows", "Bungalow"), ("garages", "Garage"))) + f", {_n('build_year < 1919')} AS pre_1919, {_n('build_year >= 2011')} AS recent FROM properties GROUP BY 1")
def composition(s: Silver) -> DataFrame:
    kinds = {"flats": "property_type = 'Flat'", "bungalows": "property_type = 'Bungalow'", "garages": "property_type = 'Garage'", "pre_1919": "build_year < 1919", "recent": "build_year >= 2011"}
    return s.properties.groupBy("portfolio_id").agg(F.count("*").alias("properties"), money("sum_insured").alias("value"), *(n_if(p).alias(n) for n, p in kinds.items()))


@query("agg_30", f"SELECT portfolio_id, CAST(sum(outstanding_action_count - overdue_action_count) AS BIGINT) AS not_yet_due, CAST(sum(overdue_action_count) AS BIGINT) AS overdue FROM ({ASSESSED}) a WHERE fra_rag = 'RED' GROUP BY 1")
def red_remediation(s: Silver) -> DataFrame:
    return assessed_blocks(s).where("fra_rag = 'RED'").groupBy("portfolio_id").agg(F.sum(col("outstanding_action_count") - col("overdue_action_count")).alias("not_yet_due"), F.sum("overdue_action_count").alias("overdue"))


_FRA_COUNTS = {"blocks_with_fra": "fra_id IS NOT NULL", "in_date": f"assessment_valid_until >= DATE '{AS_OF}'", "out_of_date": f"assessment_valid_until < DATE '{AS_OF}'", "expiring_90_days": f"assessment_valid_until BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + INTERVAL 90 DAY", "red": "rag_status = 'RED'", "amber": "rag_status = 'AMBER'", "green": "rag_status = 'GREEN'", "with_overdue": "overdue_action_count > 0", "strategy_changed": "evacuation_strategy_changed", "mor_events": "mandatory_occurrence_noted"}
_FRA_SUMS = ("total_action_count", "overdue_action_count", "no_date_action_count", "outstanding_action_count", "high_action_count")
_FRA_COLUMNS = ("fra_id", "rag_status", "assessment_valid_until", "evacuation_strategy_changed", "mandatory_occurrence_noted", *_FRA_SUMS)
_FRA_SQL = "SELECT b.portfolio_id, b.block_id AS block, f.* FROM blocks b LEFT JOIN (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY block_id ORDER BY assessment_date DESC NULLS LAST, created_seq DESC, fra_id DESC) AS rn FROM fra_features f) x WHERE rn = 1) f ON f.block_id = b.block_id"


@query("agg_31", f"SELECT portfolio_id, count(*) AS total_blocks, {', '.join(f'{_n(p)} AS {k}' for k, p in _FRA_COUNTS.items())}, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in _FRA_SUMS)} FROM ({_FRA_SQL}) a GROUP BY 1")
def fra_compliance(s: Silver) -> DataFrame:
    joined = s.blocks.select("portfolio_id", "block_id").join(latest_fra(s, _FRA_COLUMNS), "block_id", "left")
    return joined.groupBy("portfolio_id").agg(F.count("*").alias("total_blocks"), *(n_if(p).alias(k) for k, p in _FRA_COUNTS.items()), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _FRA_SUMS))


_FRAEW_COUNTS = {"blocks_with_fraew": "fraew_id IS NOT NULL", "red": "rag_status = 'RED'", "amber": "rag_status = 'AMBER'", "green": "rag_status = 'GREEN'", "combustible": "has_combustible_cladding", "acm": "aluminium_composite_cladding", "eps": "eps_insulation_present", "no_bs8414": "bs8414_test_evidence = 'no' AND has_combustible_cladding"}
_FRAEW_COLUMNS = ("fraew_id", "rag_status", "has_combustible_cladding", "aluminium_composite_cladding", "eps_insulation_present", "bs8414_test_evidence")
_FRAEW_SQL = "SELECT b.portfolio_id, b.block_id AS block, f.* FROM blocks b LEFT JOIN (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY block_id ORDER BY assessment_date DESC NULLS LAST, created_seq DESC, fraew_id DESC) AS rn FROM fraew_features f) x WHERE rn = 1) f ON f.block_id = b.block_id"


@query("agg_32", f"SELECT portfolio_id, count(*) AS total_blocks, {', '.join(f'{_n(p)} AS {k}' for k, p in _FRAEW_COUNTS.items())} FROM ({_FRAEW_SQL}) a GROUP BY 1")
def fraew_compliance(s: Silver) -> DataFrame:
    joined = s.blocks.select("portfolio_id", "block_id").join(latest_fraew(s, _FRAEW_COLUMNS), "block_id", "left")
    return joined.groupBy("portfolio_id").agg(F.count("*").alias("total_blocks"), *(n_if(p).alias(k) for k, p in _FRAEW_COUNTS.items()))


@query("agg_33", f"SELECT CAST(sum(r) AS BIGINT) AS fra_red_blocks, CAST(count(CASE WHEN c > 0 THEN 1 END) AS BIGINT) AS cladding_portfolios, count(*) AS portfolios FROM (SELECT portfolio_id, {_n('fra_rag = ' + chr(39) + 'RED' + chr(39))} AS r, {_n('has_combustible_cladding')} AS c FROM ({ASSESSED}) a GROUP BY 1) x")
def attention(s: Silver) -> DataFrame:
    per = assessed_blocks(s).groupBy("portfolio_id").agg(n_if("fra_rag = 'RED'").alias("r"), n_if("has_combustible_cladding").alias("c"))
    return per.agg(F.sum("r").alias("fra_red_blocks"), n_if("c > 0").alias("cladding_portfolios"), F.count("*").alias("portfolios"))


@query("agg_34", f"SELECT k, round(avg(CAST(latitude AS DOUBLE)), 5) AS latitude, max(units) AS most_units, {_money('sum_insured')} AS value, count(*) AS n FROM (SELECT coalesce(block_reference, address, property_reference) AS k, p.* FROM properties p) x GROUP BY 1")
def block_assembly(s: Silver) -> DataFrame:
    return s.properties.groupBy(F.coalesce("block_reference", "address", "property_reference").alias("k")).agg(F.round(F.avg(col("latitude").cast("double")), 5).alias("latitude"), F.max("units").alias("most_units"), money("sum_insured").alias("value"), F.count("*").alias("n"))


@query("agg_35", "SELECT jurisdiction, " + ", ".join(f"{_n(f'band = {chr(39)}{b}{chr(39)}')} AS {b.lower()}" for b in ("RED", "AMBER", "GREEN")) + f", {_n('band IS NULL')} AS unassessed FROM (SELECT jurisdiction, CASE WHEN 'RED' IN (fra_rag, fraew_rag) THEN 'RED' WHEN 'AMBER' IN (fra_rag, fraew_rag) THEN 'AMBER' WHEN 'GREEN' IN (fra_rag, fraew_rag) THEN 'GREEN' END AS band FROM ({ASSESSED}) a) x GROUP BY 1")
def band_tallies(s: Silver) -> DataFrame:
    either = lambda c: (F.coalesce(col("fra_rag") == c, F.lit(False)) | F.coalesce(col("fraew_rag") == c, F.lit(False)))
    band = F.when(either("RED"), "RED").when(either("AMBER"), "AMBER").when(either("GREEN"), "GREEN")
    return assessed_blocks(s).withColumn("band", band).groupBy("jurisdiction").agg(*(n_if(col("band") == b).alias(b.lower()) for b in ("RED", "AMBER", "GREEN")), n_if(col("band").isNull()).alias("unassessed"))


@query("agg_36", "SELECT band, count(*) AS n, CAST(count(CASE WHEN ok THEN 1 END) AS BIGINT) AS correct, round(100.0 * count(CASE WHEN ok THEN 1 END) / count(*), 1) AS accuracy FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'Red' WHEN o_orderkey % 3 = 0 THEN 'Yellow' ELSE 'Green' END AS band, o_orderkey % 7 <> 0 AS ok FROM {orders}) x GROUP BY 1")
def accuracy_per_band(s: Silver) -> DataFrame:
    band = F.when(col("o_orderkey") % 10 == 0, "Red").when(col("o_orderkey") % 3 == 0, "Yellow").otherwise("Green")
    rows = s.orders.select(band.alias("band"), (col("o_orderkey") % 7 != 0).alias("ok"))
    return rows.groupBy("band").agg(F.count("*").alias("n"), n_if("ok").alias("correct"), F.round(n_if("ok") * F.lit(100.0) / F.count("*"), 1).alias("accuracy"))


@query("agg_37", "SELECT portfolio_id, round(count(DISTINCT block_reference) * 1.0 / nullif(count(block_reference), 0), 4) AS uniqueness FROM properties GROUP BY 1")
def uniqueness(s: Silver) -> DataFrame:
    return s.properties.groupBy("portfolio_id").agg(F.round(F.countDistinct("block_reference") / F.nullif(F.count("block_reference"), F.lit(0)), 4).alias("uniqueness"))


@query("agg_38", f"SELECT block_reference IS NULL AS standalone, coalesce(property_type, 'unknown') AS form, count(*) AS n, CAST(count(CASE WHEN block_reference IS NULL AND property_type IN ('Bungalow', 'End Terrace House') THEN 1 END) AS BIGINT) AS fra_not_required, {_money('sum_insured')} AS value FROM properties GROUP BY 1, 2")
def dwelling_split(s: Silver) -> DataFrame:
    alone = col("block_reference").isNull()
    exempt = alone & col("property_type").isin("Bungalow", "End Terrace House")
    return s.properties.groupBy(alone.alias("standalone"), F.coalesce("property_type", F.lit("unknown")).alias("form")).agg(F.count("*").alias("n"), n_if(exempt).alias("fra_not_required"), money("sum_insured").alias("value"))


@query("agg_39", f"SELECT {_n('fra_rag = ' + chr(39) + 'RED' + chr(39))} AS red, {_n('has_combustible_cladding')} AS combustible, {_n('bs8414_test_evidence = ' + chr(39) + 'yes' + chr(39))} AS bs8414, count(*) AS total FROM ({ASSESSED}) a")
def result_counts(s: Silver) -> DataFrame:
    return assessed_blocks(s).agg(n_if("fra_rag = 'RED'").alias("red"), n_if("has_combustible_cladding").alias("combustible"), n_if("bs8414_test_evidence = 'yes'").alias("bs8414"), F.count("*").alias("total"))


@query("agg_40", "SELECT ha_id, count(DISTINCT portfolio_id) AS portfolios, count(*) AS properties, count(DISTINCT block_id) AS blocks, CAST(coalesce(sum(units), 0) AS BIGINT) AS units FROM properties GROUP BY 1")
def ha_profile(s: Silver) -> DataFrame:
    return s.properties.groupBy("ha_id").agg(F.countDistinct("portfolio_id").alias("portfolios"), F.count("*").alias("properties"), F.countDistinct("block_id").alias("blocks"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"))


_CORE = ("address", "postcode", "uprn", "latitude", "sum_insured", "property_type", "build_year")


@query("agg_41", f"SELECT submission_id, count(*) AS n, {_n('latitude IS NOT NULL AND longitude IS NOT NULL')} AS mappable, {_money('sum_insured')} AS value, CAST(round(avg(round((7 - ({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in _CORE)})) / 7.0 * 100))) AS BIGINT) AS readiness, CAST(round(100.0 * count(uprn) / count(*)) AS BIGINT) AS uprn_pct, count(DISTINCT block_reference) AS blocks FROM properties GROUP BY 1")
def ingestion_summary(s: Silver) -> DataFrame:
    missing = reduce(lambda a, b: a + b, (col(c).isNull().cast("int") for c in _CORE))
    score = F.round((7 - missing) / F.lit(7.0) * 100)
    return s.properties.groupBy("submission_id").agg(
        F.count("*").alias("n"), n_if("latitude is not null and longitude is not null").alias("mappable"), money("sum_insured").alias("value"), F.round(F.avg(score)).cast("long").alias("readiness"),
        F.round(F.count("uprn") * F.lit(100.0) / F.count("*")).cast("long").alias("uprn_pct"), F.countDistinct("block_reference").alias("blocks"),
    )


_GAP_ORDER = (("missing_uprn", "uprn IS NULL"), ("missing_postcode", "postcode IS NULL"), ("missing_geocode", "latitude IS NULL OR longitude IS NULL"), ("missing_height", "height_m IS NULL"), ("missing_build_year", "build_year IS NULL"), ("missing_construction", "wall_construction IS NULL"), ("missing_risk_rating", "risk_rating IS NULL"))


@query("agg_42", "SELECT * FROM (SELECT portfolio_id, ha_id, property_id, block_id, uprn, CASE " + " ".join(f"WHEN {p} THEN '{n}'" for n, p in _GAP_ORDER) + " END AS gap_type, created_on AS last_seen_at FROM properties) x WHERE gap_type IS NOT NULL")
def first_gap(s: Silver) -> DataFrame:
    gap = F.lit(None).cast("string")
    for name, p in reversed(_GAP_ORDER):
        gap = F.when(F.expr(p), name).otherwise(gap)
    return s.properties.select("portfolio_id", "ha_id", "property_id", "block_id", "uprn", gap.alias("gap_type"), col("created_on").alias("last_seen_at")).where(col("gap_type").isNotNull())


@query("density_summary", "SELECT n, count(*) AS points FROM (SELECT a.uprn, count(*) AS n FROM uprn_points a JOIN uprn_points b ON sqrt((a.easting - b.easting) * (a.easting - b.easting) + (a.northing - b.northing) * (a.northing - b.northing)) <= 30 GROUP BY 1) x GROUP BY 1")
def density_summary(s: Silver) -> DataFrame:
    counts = spatial.sums_within(s.uprn_points, 30, {"n": F.lit(1)})
    return counts.groupBy("n").agg(F.count("*").alias("points"))

