"""Gold views and endpoint queries, composed of the relational, aggregate and scoring operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.functions import rules
from groundplan.operators import relational as ops
from groundplan.operators.lineage_cut import shared_folder
from groundplan.plans.aggregates import FORM_SQL, money, n_if
from groundplan.plans.registry import query
from groundplan.plans.relational import ASSESSED, assessed_blocks, latest_fra, latest_fraew, severity
from groundplan.plans.silver import AS_OF, Silver
from groundplan.sources import exports

col = F.col
_SEVERITY = "CASE fra_rag WHEN 'RED' THEN 1 WHEN 'AMBER' THEN 2 WHEN 'GREEN' THEN 3 ELSE 4 END"


@query("gold_portfolio_summary_v1", "SELECT p.portfolio_id, p.ha_id, coalesce(x.properties, 0) AS properties, coalesce(b.blocks, 0) AS blocks, coalesce(b.units, 0) AS units FROM portfolios p LEFT JOIN (SELECT portfolio_id, count(*) AS properties FROM properties GROUP BY 1) x ON x.portfolio_id = p.portfolio_id LEFT JOIN (SELECT portfolio_id, count(*) AS blocks, CAST(sum(unit_count) AS BIGINT) AS units FROM blocks GROUP BY 1) b ON b.portfolio_id = p.portfolio_id")
def portfolio_summary(s: Silver) -> DataFrame:
    props = s.properties.groupBy("portfolio_id").agg(F.count("*").alias("properties"))
    blocks = s.blocks.groupBy("portfolio_id").agg(F.count("*").alias("blocks"), F.sum("unit_count").alias("units"))
    joined = s.portfolios.select("portfolio_id", "ha_id").join(props, "portfolio_id", "left").join(blocks, "portfolio_id", "left")
    return joined.select("portfolio_id", "ha_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("properties", "blocks", "units")))


@query("gold_ha_recent_activity_v1", "SELECT ha_id, 'upload' AS activity_type, upload_id, status, uploaded_at FROM uploads WHERE uploaded_at >= (SELECT max(ts) FROM {events}) - INTERVAL 30 DAY")
def recent_activity(s: Silver) -> DataFrame:
    last = s.events.agg(F.max("ts").alias("as_of"))
    recent = s.uploads.join(F.broadcast(last), col("uploaded_at") >= col("as_of") - F.expr("INTERVAL 30 DAY"))
    return recent.select("ha_id", F.lit("upload").alias("activity_type"), "upload_id", "status", "uploaded_at")


@query("gold_high_rise_indicators_v1", "SELECT b.block_id, b.height_max_m, b.max_storeys FROM blocks b WHERE b.height_max_m >= 18 OR b.max_storeys >= 7")
def high_rise_indicators(s: Silver) -> DataFrame:
    return s.blocks.where("height_max_m >= 18 or max_storeys >= 7").select("block_id", "height_max_m", "max_storeys")


def mentions(s: Silver, flag: str) -> DataFrame:
    """The sibling views over one mentioned feature each."""
    return s.fra_features.where(col(flag)).select("fra_id", "block_id")


@query("gold_evacuation_strategy_v1", "SELECT fra_id, block_id FROM fra_features WHERE evacuation_strategy_changed")
def evacuation_mentions(s: Silver) -> DataFrame:
    return mentions(s, "evacuation_strategy_changed")


@query("gold_mandatory_occurrence_v1", "SELECT fra_id, block_id FROM fra_features WHERE mandatory_occurrence_noted")
def occurrence_mentions(s: Silver) -> DataFrame:
    return mentions(s, "mandatory_occurrence_noted")


@query("gold_bsr_interactions_v1", "SELECT fra_id, block_id FROM fra_features WHERE bsa_2022_applicable")
def bsr_mentions(s: Silver) -> DataFrame:
    return mentions(s, "bsa_2022_applicable")


@query("gold_portfolio_map_v1", f"SELECT p.property_id, p.latitude, p.longitude, lower(coalesce(a.fra_rag, 'grey')) AS colour FROM properties p LEFT JOIN ({ASSESSED}) a ON a.name = p.block_reference WHERE p.latitude IS NOT NULL AND p.longitude IS NOT NULL")
def portfolio_map(s: Silver) -> DataFrame:
    rag = assessed_blocks(s).select(col("name").alias("block_reference"), "fra_rag")
    placed = s.properties.where(col("latitude").isNotNull() & col("longitude").isNotNull()).join(rag, "block_reference", "left")
    return placed.select("property_id", "latitude", "longitude", F.lower(F.coalesce("fra_rag", F.lit("grey"))).alias("colour"))


@query("gold_fra_block_detail_v1", f"SELECT block_id, name, fra_rag, fra_date, assessment_valid_until >= DATE '{AS_OF}' AS in_date, coalesce(total_action_count, 0) AS actions, coalesce(overdue_action_count, 0) AS overdue, height_max_m FROM ({ASSESSED}) a")
def fra_block_detail(s: Silver) -> DataFrame:
    current = (col("assessment_valid_until") >= F.lit(AS_OF).cast("date")).alias("in_date")
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return assessed_blocks(s).select("block_id", "name", "fra_rag", "fra_date", current, zero("total_action_count", "actions"), zero("overdue_action_count", "overdue"), "height_max_m")


@query("gold_fraew_block_detail_v1", f"SELECT block_id, name, fraew_rag, coalesce(has_combustible_cladding, FALSE) AS combustible, bs8414_test_evidence, CASE WHEN height_max_m < 11 THEN 'under_11m' WHEN height_max_m < 18 THEN '11_to_18m' WHEN height_max_m >= 18 THEN '18m_plus' END AS height_category FROM ({ASSESSED}) a WHERE fraew_rag IS NOT NULL")
def fraew_block_detail(s: Silver) -> DataFrame:
    height = F.when(col("height_max_m") < 11, "under_11m").when(col("height_max_m") < 18, "11_to_18m").when(col("height_max_m") >= 18, "18m_plus")
    return assessed_blocks(s).where(col("fraew_rag").isNotNull()).select("block_id", "name", "fraew_rag", F.coalesce("has_combustible_cladding", F.lit(False)).alias("combustible"), "bs8414_test_evidence", height.alias("height_category"))


@query("gold_fra_status_by_block_v1", f"SELECT portfolio_id, coalesce(fra_rag, 'UNASSESSED') AS status, count(*) AS blocks, CAST(round(sum(total_sum_insured), 2) AS DOUBLE) AS value FROM ({ASSESSED}) a GROUP BY 1, 2")
def fra_status(s: Silver) -> DataFrame:
    return assessed_blocks(s).groupBy("portfolio_id", F.coalesce("fra_rag", F.lit("UNASSESSED")).alias("status")).agg(F.count("*").alias("blocks"), money("total_sum_insured").alias("value"))


@query("gold_standalone_dwellings_v1", f"SELECT property_id, form FROM (SELECT property_id, block_reference, {FORM_SQL} AS form FROM properties) x WHERE block_reference IS NULL AND coalesce(form, '') NOT IN ('garage', 'infrastructure')")
def standalone_dwellings(s: Silver) -> DataFrame:
    form = rules.dwelling_form(col("property_type"), col("built_form"))
    return s.properties.where(col("block_reference").isNull()).select("property_id", form.alias("form")).where(~F.coalesce("form", F.lit("")).isin("garage", "infrastructure"))


@query("gold_doc_a_enriched", 'SELECT property_reference AS "Property Reference", block_reference AS "Block Reference", address AS "Address 1", postcode AS "Postcode", units AS "Number of Units", property_type AS "Property Type", uprn AS "UPRN", epc_rating AS "EPC Rating", enrichment_status AS "Enrichment Status" FROM properties')
def doc_a(s: Silver) -> DataFrame:
    """The columns of the first schedule that these tables hold; ``exports.schedule`` gives all 46."""
    held = tuple((h, c) for h, c in exports.SCHEDULE_A if c in ("property_reference", "block_reference", "address", "postcode", "units", "property_type", "uprn", "epc_rating", "enrichment_status"))
    return exports.schedule(s.properties, held)


def _mode(value: str) -> str:
    return f"SELECT blk, {value} FROM (SELECT blk, {value}, row_number() OVER (PARTITION BY blk ORDER BY count(*) DESC, {value} ASC NULLS LAST) AS rn FROM (SELECT coalesce(block_reference, address) AS blk, p.* FROM properties p) q GROUP BY blk, {value}) x WHERE rn = 1"


_DOC_B_SQL = f"""SELECT a.blk AS block_reference, a.units, a.sum_insured, a.lor_value, a.oldest, m.wall_construction, pc.postcode, pt.property_type
 FROM (SELECT coalesce(block_reference, address) AS blk, CAST(coalesce(sum(units), count(*)) AS BIGINT) AS units, CAST(round(coalesce(sum(sum_insured), 0), 2) AS DOUBLE) AS sum_insured, CAST(round(coalesce(sum(sum_insured), 0) * 0.25, 2) AS DOUBLE) AS lor_value, min(build_year) AS oldest FROM properties GROUP BY 1) a
 LEFT JOIN (SELECT * FROM (SELECT blk, wall_construction, row_number() OVER (PARTITION BY blk ORDER BY count(*) DESC, wall_construction) AS rn FROM (SELECT coalesce(block_reference, address) AS blk, p.* FROM properties p) q WHERE wall_construction IS NOT NULL GROUP BY blk, wall_construction) x WHERE rn = 1) m ON m.blk = a.blk
 LEFT JOIN ({_mode('postcode')}) pc ON pc.blk = a.blk LEFT JOIN ({_mode('property_type')}) pt ON pt.blk = a.blk WHERE a.blk IS NOT NULL"""


@query("gold_doc_b_enriched", _DOC_B_SQL)
def doc_b(s: Silver) -> DataFrame:
    """One row per block: sums, the commonest wall, postcode and type; each commonest value ranks counts, not rows."""
    rows = s.properties.withColumn("blk", F.coalesce("block_reference", "address")).where(col("blk").isNotNull())
    total = F.coalesce(F.sum("sum_insured"), F.lit(0).cast("decimal(15,2)"))
    sums = rows.groupBy("blk").agg(F.coalesce(F.sum("units"), F.count("*")).alias("units"), F.round(total, 2).cast("double").alias("sum_insured"), F.round(total * F.lit(0.25).cast("decimal(3,2)"), 2).cast("double").alias("lor_value"), F.min("build_year").alias("oldest"))
    wall = ops.mode(rows, ["blk"], "wall_construction")
    last = lambda c: ops.mode(rows, ["blk"], c, [col(c).asc_nulls_last()], nulls=True)
    joined = sums.join(wall, "blk", "left").join(last("postcode"), "blk", "left").join(last("property_type"), "blk", "left")
    return joined.select(col("blk").alias("block_reference"), "units", "sum_insured", "lor_value", "oldest", "wall_construction", "postcode", "property_type")


_B_HELD = {
    "asset_type": "CASE WHEN a.name IS NULL THEN 'Standalone' ELSE 'Block' END", "block_reference": "d.block_reference", "postcode": "d.postcode", "sum_insured": "CAST(d.sum_insured AS DECIMAL(25,2))", "lor_value": "CAST(d.lor_value AS DECIMAL(25,2))",
    "total_insured_value": "CAST(d.sum_insured + d.lor_value AS DECIMAL(25,2))", "storeys": "a.max_storeys", "height_max_m": "a.height_max_m", "property_type": "d.property_type", "units": "d.units", "build_year": "d.oldest", "is_listed": "CASE WHEN a.is_listed THEN 'Yes' WHEN NOT a.is_listed THEN 'No' END",
    "wall_construction": "d.wall_construction", "fra_date": "a.fra_date", "combustible_materials": "CASE WHEN a.has_combustible_cladding THEN 'Yes' WHEN NOT a.has_combustible_cladding THEN 'No' END", "cladding_present": "CASE WHEN a.aluminium_composite_cladding THEN 'Yes' WHEN NOT a.aluminium_composite_cladding THEN 'No' END",
    "insulation_type": "CASE WHEN a.eps_insulation_present THEN 'EPS' END",
}


@query("snk_08", "SELECT " + ", ".join(f'CAST({_B_HELD.get(c, "NULL")} AS VARCHAR(4000)) AS "{h}"' for h, c in exports.SCHEDULE_B) + f" FROM ({_DOC_B_SQL}) d LEFT JOIN ({ASSESSED}) a ON a.name = d.block_reference")
def second_schedule(s: Silver) -> DataFrame:
    """All 65 columns, written with their headings and read again, cell by cell."""
    blocks = assessed_blocks(s).select("name", *(c for c in ("max_storeys", "height_max_m", "is_listed", "fra_date", "has_combustible_cladding", "aluminium_composite_cladding", "eps_insulation_present")))
    rows = doc_b(s).alias("d").join(blocks.alias("a"), col("a.name") == col("d.block_reference"), "left").select(*(F.expr(e).alias(c) for c, e in _B_HELD.items()))
    path = f"{shared_folder(s.spark)}/schedule-{uuid.uuid4().hex}"
    exports.write_schedule(exports.schedule(rows, exports.SCHEDULE_B), path)
    return s.spark.read.csv(path, header=True, nullValue="", emptyValue="", escape='"')


@query("gold_document_features_overview_v1", f"SELECT b.block_id, f.fra_id, w.fraew_id FROM blocks b LEFT JOIN (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY block_id ORDER BY assessment_date DESC NULLS LAST, created_seq DESC, fra_id DESC) AS rn FROM fra_features f) x WHERE rn = 1) f ON f.block_id = b.block_id LEFT JOIN (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY block_id ORDER BY assessment_date DESC NULLS LAST, created_seq DESC, fraew_id DESC) AS rn FROM fraew_features f) x WHERE rn = 1) w ON w.block_id = b.block_id WHERE f.fra_id IS NOT NULL OR w.fraew_id IS NOT NULL")
def documents_overview(s: Silver) -> DataFrame:
    joined = s.blocks.select("block_id").join(latest_fra(s, ("fra_id",)), "block_id", "left").join(latest_fraew(s, ("fraew_id",)), "block_id", "left")
    return joined.where("fra_id is not null or fraew_id is not null")


@query("endpoint_fra_blocks", f"SELECT block_id, name, fra_rag, overdue_action_count FROM ({ASSESSED}) a WHERE fra_rag = 'AMBER' ORDER BY {_SEVERITY}, overdue_action_count DESC NULLS LAST, name")
def fra_blocks(s: Silver) -> DataFrame:
    return ops.rag_filter(assessed_blocks(s), "AMBER", "fra_rag").orderBy(severity("fra_rag"), col("overdue_action_count").desc_nulls_last(), "name").select("block_id", "name", "fra_rag", "overdue_action_count")


@query("endpoint_risk_summary", f"SELECT portfolio_id, CAST(count(CASE WHEN fra_rag = 'RED' OR fraew_rag = 'RED' OR overdue_action_count > 0 THEN 1 END) AS BIGINT) AS urgent, CAST(count(CASE WHEN fra_rag IS NULL THEN 1 END) AS BIGINT) AS unassessed, CAST(coalesce(sum(overdue_action_count), 0) AS BIGINT) AS overdue FROM ({ASSESSED}) a GROUP BY 1")
def risk_summary(s: Silver) -> DataFrame:
    urgent = n_if("fra_rag = 'RED' or fraew_rag = 'RED' or overdue_action_count > 0")
    return assessed_blocks(s).groupBy("portfolio_id").agg(urgent.alias("urgent"), n_if("fra_rag is null").alias("unassessed"), F.coalesce(F.sum("overdue_action_count"), F.lit(0)).alias("overdue"))


@query("endpoint_red_blocks", f"SELECT block_id, name, fra_rag, fraew_rag FROM ({ASSESSED}) a WHERE fra_rag = 'RED' OR fraew_rag = 'RED' ORDER BY total_sum_insured DESC, block_id")
def red_blocks(s: Silver) -> DataFrame:
    return assessed_blocks(s).where("fra_rag = 'RED' or fraew_rag = 'RED'").orderBy(col("total_sum_insured").desc(), "block_id").select("block_id", "name", "fra_rag", "fraew_rag")


@query("endpoint_fire_documents", "SELECT fra_id AS document_id, 'FRA' AS kind, block_id, rag_status FROM fra_features UNION ALL SELECT fraew_id, 'FRAEW', block_id, rag_status FROM fraew_features")
def fire_documents(s: Silver) -> DataFrame:
    part = lambda df, key, kind: df.select(col(key).alias("document_id"), F.lit(kind).alias("kind"), "block_id", "rag_status")
    return part(s.fra_features, "fra_id", "FRA").unionByName(part(s.fraew_features, "fraew_id", "FRAEW"))


@query("endpoint_home", f"SELECT p.portfolio_id, p.renewal_year, h.name AS ha_name, g.status AS access_status, count(a.block_id) AS blocks, CAST(coalesce(sum(a.unit_count), 0) AS BIGINT) AS units, CAST(count(CASE WHEN a.fra_rag = 'RED' THEN 1 END) AS BIGINT) AS fra_red FROM portfolios p JOIN housing_associations h ON h.ha_id = p.ha_id LEFT JOIN access_grants g ON g.ha_id = p.ha_id AND g.renewal_year = p.renewal_year AND g.underwriter_id = 'uw_1' LEFT JOIN ({ASSESSED}) a ON a.portfolio_id = p.portfolio_id GROUP BY 1, 2, 3, 4")
def home(s: Silver) -> DataFrame:
    grants = ops.optional(s.access_grants, underwriter_id="uw_1").select("ha_id", "renewal_year", col("status").alias("access_status"))
    blocks = assessed_blocks(s).groupBy("portfolio_id").agg(F.count("*").alias("blocks"), F.sum("unit_count").alias("units"), n_if("fra_rag = 'RED'").alias("fra_red"))
    named = s.portfolios.select("portfolio_id", "ha_id", "renewal_year").join(s.housing_associations.select("ha_id", col("name").alias("ha_name")), "ha_id").join(grants, ["ha_id", "renewal_year"], "left").join(blocks, "portfolio_id", "left")
    return named.select("portfolio_id", "renewal_year", "ha_name", "access_status", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("blocks", "units", "fra_red")))
