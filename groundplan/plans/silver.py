"""Silver views over the supplied tables, as SQL text that Spark and other engines read alike.

Each view is one SELECT over base tables (in braces) or other views. ``Silver`` gives
them as lazy DataFrames; ``with_views`` puts the text of those a query names in front
of it as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-09-02"

VIEWS: dict[str, str] = {
    "housing_associations": "SELECT concat('ha_', CAST(r_regionkey AS VARCHAR(20))) AS ha_id, r_name AS name FROM {region}",
    "portfolios": """SELECT concat('pf_', CAST(n_nationkey AS VARCHAR(20))) AS portfolio_id, concat('ha_', CAST(n_regionkey AS VARCHAR(20))) AS ha_id, n_name AS name,
        CAST(2020 + n_nationkey % 5 AS INT) AS renewal_year, CAST(n_nationkey AS INT) AS portfolio_no FROM {nation}""",
    "access_grants": """SELECT ha_id, renewal_year, CASE WHEN min(portfolio_no) % 2 = 0 THEN 'uw_1' ELSE 'uw_2' END AS underwriter_id,
        CASE WHEN min(portfolio_no) % 3 = 0 THEN 'new' ELSE 'active' END AS status FROM portfolios WHERE portfolio_no % 4 <> 3 GROUP BY ha_id, renewal_year""",
    "blocks": """SELECT c_custkey AS block_id, p.ha_id, p.portfolio_id, c_name AS name, CAST(c_custkey % 30 + 1 AS INT) AS unit_count,
        CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 40 + 1 END AS DECIMAL(8,2)) AS height_max_m,
        CAST(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 14 + 1 END AS INT) AS max_storeys,
        c_custkey % 13 = 0 AS is_listed, CAST(c_acctbal * 1000 + 1500000 AS DECIMAL(15,2)) AS total_sum_insured,
        CASE WHEN c_custkey % 5 = 0 THEN 'SCO' ELSE 'ENG' END AS jurisdiction, c_mktsegment AS predominant_wall
        FROM {customer} c JOIN portfolios p ON p.portfolio_no = c.c_nationkey""",
    "properties": """SELECT o_orderkey AS property_id, b.ha_id, b.portfolio_id, concat('PR', CAST(o_orderkey AS VARCHAR(20))) AS property_reference,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE b.name END AS block_reference, o_custkey AS block_id,
        CAST(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS DECIMAL(15,2)) AS sum_insured,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' WHEN '4' THEN 'D' ELSE 'E' END AS risk_rating,
        CASE o_orderkey % 9 WHEN 0 THEN 'Flat' WHEN 1 THEN 'End Terrace House' WHEN 2 THEN 'Bungalow' WHEN 3 THEN 'Maisonette' WHEN 4 THEN 'Sheltered Flat'
            WHEN 5 THEN 'Garage' WHEN 6 THEN 'Shop' WHEN 7 THEN NULL ELSE 'Drainage works' END AS property_type,
        CASE o_orderkey % 4 WHEN 0 THEN 'Mid-Terrace' WHEN 1 THEN 'Enclosed flat' WHEN 2 THEN NULL ELSE 'Detached' END AS built_form,
        CAST(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 1 + o_orderkey % 3 END AS INT) AS units,
        CAST(CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 1850 + o_orderkey % 175 END AS INT) AS build_year,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('AB', CAST(o_orderkey % 20 + 1 AS VARCHAR(20)), ' ', CAST(o_orderkey % 9 AS VARCHAR(20)), 'CD') END AS postcode,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat(CAST(o_orderkey % 90 + 1 AS VARCHAR(20)), ' High Street, Town') END AS address,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(100000000000 + o_orderkey AS VARCHAR(20)) END AS uprn,
        CAST(CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE 51.0 + o_orderkey % 400 / 100.0 END AS DECIMAL(10,4)) AS latitude,
        CAST(CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE -3.0 + o_orderkey % 300 / 100.0 END AS DECIMAL(10,4)) AS longitude,
        CASE o_orderstatus WHEN 'F' THEN 'enriched' WHEN 'O' THEN 'pending' ELSE 'failed' END AS enrichment_status,
        CASE o_orderkey % 3 WHEN 0 THEN 'Social rent' WHEN 1 THEN 'Leasehold' ELSE NULL END AS tenure,
        CASE o_orderkey % 5 WHEN 0 THEN 'Landlord' WHEN 1 THEN 'Freeholder' WHEN 2 THEN 'RTM' ELSE NULL END AS responsible_party,
        CASE o_orderkey % 6 WHEN 0 THEN 'Cavity' WHEN 1 THEN 'Solid brick' WHEN 2 THEN NULL ELSE 'Timber frame' END AS wall_construction,
        CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE chr(CAST(65 + o_orderkey % 7 AS INT)) END AS epc_rating,
        CAST(o_orderdate AS DATE) AS created_on, CASE WHEN o_orderkey % 2 = 0 THEN 's1' ELSE 's2' END AS submission_id,
        CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 45 + 1 END AS DECIMAL(8,2)) AS height_m, CASE o_orderkey % 5 WHEN 0 THEN 'Slate' WHEN 1 THEN 'Tile' WHEN 2 THEN NULL ELSE 'Flat felt' END AS roof_construction,
        CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 12 + 1 END AS INT) AS storeys, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 23 = 0 END AS property_listed
        FROM {orders} o JOIN blocks b ON b.block_id = o.o_custkey""",
    "fra_features": """SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS fra_id,
        o_custkey AS block_id,
        CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'RED' WHEN l_returnflag = 'A' THEN 'AMBER' ELSE 'GREEN' END AS rag_status,
        CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS assessment_date,
        CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + INTERVAL 1 YEAR END AS assessment_valid_until,
        CASE l_linenumber % 3 WHEN 0 THEN 'Type 1' WHEN 1 THEN 'Type 3' ELSE NULL END AS fra_assessment_type,
        CAST(l_quantity AS INT) AS total_action_count, CAST(CAST(l_quantity AS INT) % 5 AS INT) AS overdue_action_count, CAST(CAST(l_quantity AS INT) % 8 AS INT) AS outstanding_action_count,
        CAST(CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS INT) % 3 END AS INT) AS no_date_action_count, CAST(CAST(l_quantity AS INT) % 4 AS INT) AS high_action_count,
        CASE l_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS has_smoke_detection, CASE l_partkey % 4 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS has_fire_doors,
        CASE l_suppkey % 3 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS has_compartmentation, CASE l_suppkey % 4 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS has_emergency_lighting,
        l_suppkey % 10 = 0 AS mandatory_occurrence_noted, l_suppkey % 7 = 0 AS evacuation_strategy_changed, l_partkey % 6 = 0 AS bsa_2022_applicable,
        CASE l_partkey % 12 WHEN 0 THEN NULL WHEN 6 THEN FALSE ELSE TRUE END AS accountable_person_noted, l_orderkey * 10 + l_linenumber AS created_seq,
        CASE l_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS has_sprinkler_system, CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS has_fire_alarm_system,
        CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN CAST(l_shipdate AS DATE) - INTERVAL 30 DAY ELSE CAST(l_shipdate AS DATE) + INTERVAL 200 DAY END AS next_review_date,
        CAST(CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN 1500 ELSE 1850 + l_partkey % 170 END AS INT) AS build_year,
        CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + INTERVAL 16 YEAR END AS far_due_date
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey WHERE l_linestatus = 'F'""",
    "fraew_features": """SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS fraew_id,
        o_custkey AS block_id, CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'RED' WHEN l_partkey % 5 = 1 THEN 'AMBER' ELSE 'GREEN' END AS rag_status,
        CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS assessment_date,
        CASE l_partkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS has_combustible_cladding, l_partkey % 9 = 0 AS eps_insulation_present, l_partkey % 13 = 0 AS aluminium_composite_cladding,
        CASE l_suppkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULL END AS bs8414_test_evidence, l_suppkey % 4 = 0 AS interim_measures_required, l_suppkey % 5 = 0 AS has_remedial_actions,
        l_orderkey * 10 + l_linenumber AS created_seq,
        CAST(CASE WHEN l_partkey % 12 = 0 THEN NULL WHEN l_partkey % 47 = 0 THEN 200 ELSE l_partkey % 60 + 2 END AS DECIMAL(8,2)) AS building_height_m, CASE l_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS pas_9980_compliant,
        l_partkey % 21 = 0 AS asbestos_suspected, CASE WHEN l_partkey % 43 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN CAST(l_shipdate AS DATE) - INTERVAL 10 DAY ELSE CAST(l_shipdate AS DATE) + INTERVAL 20 DAY END AS report_date,
        CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN CAST(l_shipdate AS DATE) - INTERVAL 5 DAY ELSE CAST(l_shipdate AS DATE) + INTERVAL 5 YEAR END AS assessment_valid_until,
        CAST(CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN 2999 ELSE 1900 + l_partkey % 120 END AS INT) AS build_year, CAST(CASE WHEN l_partkey % 4 = 0 THEN 1905 + l_partkey % 120 END AS INT) AS retrofit_year,
        CAST(CASE WHEN l_partkey % 53 = 0 THEN 90 ELSE l_partkey % 30 END AS INT) AS num_storeys, CAST(l_quantity * 3 AS INT) AS wall_coverage
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey WHERE l_linestatus = 'O'""",
    "uploads": """SELECT event_id AS upload_id, concat('ha_', CAST(user_id % 5 AS VARCHAR(20))) AS ha_id, event_type AS status, ts AS uploaded_at, value AS row_count, CAST(user_id AS BIGINT) AS user_id FROM {events}""",
    "lineage": "SELECT event_id AS target_id, CAST(floor(event_id / 3.0) AS BIGINT) AS source_id, event_type AS step FROM {events} WHERE event_id > 0",
    "uprn_points": "SELECT c_custkey AS uprn, CAST((c_custkey * 7919) % 601 AS DOUBLE) AS easting, CAST((c_custkey * 104729) % 607 AS DOUBLE) AS northing FROM {customer}",
    "centroids": "SELECT s_suppkey AS postcode, CAST((s_suppkey * 7907) % 601 AS DOUBLE) AS easting, CAST((s_suppkey * 104711) % 607 AS DOUBLE) AS northing FROM {supplier}",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark", "conversations", "embeddings")


def _needed(text: str) -> list[str]:
    """Views that the text names, each after those it needs itself."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            found += [n for n in [*_needed(VIEWS[name]), name] if n not in found]
    return found


def with_views(sql: str) -> str:
    """``sql`` for an engine in which the base tables are views."""
    plain = {name: name for name in BASE}
    head = ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in _needed(sql))
    body = sql.format(**plain)
    if not head:
        return body
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


class Silver:
    """The views, and the base tables, of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        names = [n for n in _needed(text)]
        full = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
        text = f"WITH {full}\n{text}" if full else text
        used = [b for b in BASE if "{" + b + "}" in text]
        return self.spark.sql(text, **{b: self.table(b) for b in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in BASE:
            return self.table(name)
        raise AttributeError(name)
