"""Look-ups, assignment, plans and safety cases against plain loops over small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from groundplan.functions import values
from groundplan.operators import documents, ingest, json_schema, lookup, matching, numbering, safety_case, similar, spatial
from groundplan.sources import workbook


def test_references_against_a_loop(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(1, 5)))
    known = [(word(), k) for k in range(40)] + [("", 1), (None, 2)]
    asked = [(k, word() + rng.choice(["", " - x", "-b", "c"])) for k in range(80)] + [(80, None), (81, ""), (82, "zzz")]
    first: dict = {}
    for key, order in known:
        if key:
            first[key] = min(order, first.get(key, order))
    want = {}
    for k, key in asked:
        if not key:
            continue
        bare = re.split(r"\s*[-–]\s*", key)[0].strip()
        prefixed = [(o, n) for n, o in first.items() if key.startswith(n) or (bare and n.startswith(bare))]
        if key in first:
            want[k] = (key, 1)
        elif bare in first:
            want[k] = (bare, 2)
        elif prefixed:
            want[k] = (min(prefixed)[1], 3)
    found = lookup.by_reference(spark.createDataFrame(asked, "id int, key string"), spark.createDataFrame(known, "key string, order int"))
    assert {r.id: (r.matched, r.rule) for r in found.collect()} == want


def test_best_in_batch_against_a_loop(spark):
    rng = random.Random(5)
    words = "high street town flat west north one two".split()
    rows = [(k, rng.choice(["p", "q", "r"]), rng.sample(words, rng.randint(0, 5))) for k in range(60)]
    rows += [(60, "two", ["a"]), (61, "two", ["b"]), (62, "alone", ["a"]), (63, None, ["a"]), (64, "p", None), (65, "pair", None), (66, "pair", ["x"])]
    want = {}
    for k, batch, tokens in rows:
        others = [(o, set(t or ())) for o, b, t in rows if b == batch and o != k and batch is not None]
        if len(others) == 1:
            want[k] = others[0][0]
            continue
        own = set(tokens or ())
        scored = [(-len(own & t) / max(len(own), len(t)), o) for o, t in others if own and t]
        if scored and -min(scored)[0] > lookup.OVERLAP:
            want[k] = min(scored)[1]
    found = lookup.best_in_batch(spark.createDataFrame(rows, "id int, batch string, tokens array<string>"), "id", "batch", "tokens")
    assert {r.id: r.match for r in found.collect()} == want


def test_containment_against_a_loop(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    needles = [(rng.choice("xy"), text(rng.randint(1, 7))) for _ in range(60)] + [("x", ""), ("y", None)]
    texts = [(rng.choice("xy"), text(rng.randint(0, 12))) for _ in range(60)] + [("x", None)]
    found = lookup.containing(spark.createDataFrame(needles, "s string, needle string"), spark.createDataFrame(texts, "s string, text string"), "s")
    assert {tuple(r) for r in found.collect()} == {(s, n, t) for s, n in needles for r, t in texts if s == r and n and t and n in t}


def test_greedy_pairs_against_a_loop(spark):
    rng = random.Random(9)
    near = [(p, s, float(rng.randint(1, 9))) for p in range(40) for s in rng.sample(range(25), rng.randint(0, 4))]
    used, want = set(), set()
    for p in range(40):
        left = [(d, s) for q, s, d in near if q == p and s not in used]
        if left:
            used.add(min(left)[1])
            want.add((p, min(left)[1]))
    found = spatial.greedy_pairs(spark.createDataFrame(near, "point int, shape int, distance double"))
    assert {tuple(r) for r in found.collect()} == want
    assert spatial.greedy_pairs(spark.createDataFrame([], "point int, shape int, distance double")).count() == 0


def test_blocks_of_documents(spark):
    blocks = spark.createDataFrame([(1, "h", "02BR Holmlea"), (2, "h", "Mill"), (3, "h", "Cat"), (4, "g", "02BR Holmlea"), (5, "h", "Tower House")], "block_id int, ha_id string, name string")
    properties = spark.createDataFrame([("h", "mill", "12 Quarry Road, Leeds", "LS1 4AB"), ("h", "Tower House", "9 Quarry Lane, York", None), ("h", None, "12 Quarry Road", "LS1 4AB")], "ha_id string, block_reference string, address string, postcode string")
    docs = [
        (1, "h", "mill", None, None), (2, "h", "02br", None, None), (3, "h", "The Mill Block", None, None), (4, "h", " ", "TOWER HOUSE", None), (5, "h", None, "fra for tower house 2", None), (6, "h", None, "the Cat inn", None),
        (7, "h", None, None, "Quarry, York"), (8, "h", None, "x", "Road Quarry Leeds"), (9, "h", None, None, "LS1 office"), (10, "h", None, None, "Quarry"), (11, "g", "mill", None, None), (12, "h", None, None, None), (13, "h", None, None, "arry Leed"),
    ]
    found = lookup.blocks_of_documents(spark.createDataFrame(docs, "doc int, ha_id string, block_reference string, building_name string, address string"), blocks, properties)
    assert {r.doc: (r.block_id, r.strategy) for r in found.collect()} == {1: (2, 0), 2: (1, 1), 3: (2, 1), 4: (5, 2), 5: (5, 3), 7: (5, 4), 8: (2, 4), 9: (2, 4), 13: (2, 4)}


def test_plans():
    columns, parts = ingest.column_map(["Reference", "Block ref", "Parent property ref", "Sum Insured 24/25", "Sum insured type", "Declared value 2026", "Type", "Construction date", "add_1", "add_2", "Tenant address", None])
    assert columns == {"property_reference": 0, "block_reference": 1, "sum_insured": 5, "sum_insured_type": 4, "property_type": 4, "year_of_build": 7} and parts == [8, 9]
    stock, sums = ingest.SheetPlan("Stock", 1, {"property_reference": 0, "address": 1}, rows=9), ingest.SheetPlan("Sums", 0, {"property_reference": 2, "sum_insured": 3, "storeys": 4}, rows=9)
    assert [ingest.role(p) for p in (stock, sums, ingest.SheetPlan("x", 0, {"postcode": 1}), ingest.SheetPlan("y", 0, {"property_reference": 0}, rows=21))] == ["primary", "secondary", "ignore", "primary"]
    plan = ingest.join_plan([stock, sums])
    assert plan == ingest.JoinPlan(0, "Sums", 2, False, ["sum_insured", "storeys"])
    assert ingest.join_plan([stock]) is None and ingest.join_plan([stock, ingest.SheetPlan("Sums", 0, sums.columns, rows=2)]) is None
    assert ingest.validated_join({"primary_key": 1, "sheet": "Sums"}, {"Sums"}) is None and ingest.validated_join(None, {"Sums"}) is None
    assert ingest.validated_join({"primary_key": None, "sheet": "Sums", "key": "2", "strip_suffix": 1, "fields": [{"name": "units"}, "storeys", "odd"]}, {"Sums"}) == ingest.JoinPlan(0, "Sums", 2, True, ["units", "storeys"])
    clean = ingest.validated([{"sheet": "Sums ", "header_row": None, "columns": {"units": 2.0, "postcode": -1, "odd": 1, "storeys": True}, "address": [1, -2, 3.0]}, {"sheet": "none"}, {}], {"Sums"})
    assert clean == [ingest.SheetPlan("Sums", 0, {"units": 2}, [1, 3])]


def test_headings_by_column_and_by_value(spark):
    heads = ["Sum Insured 24/25", "2023-24", "Reinstatement 2026 and 2019", "Postcode", "1/2", "SI 24/2025"]
    rows = spark.createDataFrame([(h,) for h in heads], "h string").select(values.insured_year_of(F.col("h")).alias("y")).collect()
    assert [r.y for r in rows] == [values.insured_year(h) for h in heads]


CASE = """Building Safety Case Report for Example
Building name: MillCourt House
Address: 12 Mill Road, Leeds LS1 4AB.
HRB12345678 UPRN: 100000000001 and 100000000002
Building ref: B77
Height: 17.5 metres, 6 storeys
completed in 1999. A higher-risk residential building with 24 flats
Version: 3.2
Document date: 05/06/2023
Principal Accountable Person: Jo Bloggs
Building Safety Manager: Kim Lee
Managing agent: Example Homes Group
Type: 4
FRA date: 01-02-2022
Assessor: Ada Byron
AIFireE, MIFireE
Peer reviewer: Max Moe
Evacuation strategy: Stay put unless told. Fire alarm: L2. Smoke detection: l3
Firefighter lift, dry riser, sprinklers, AOV, emergency lighting, compartmentation, premises information box.
Structure type: steel frame
Cladding type: timber
Remediation is planned. Completion certificate. Structural defect. Gas monitor. Lightning protection.
Building Safety Act 2022, mandatory occurrence reports, resident engagement.
Emergency line: Help@Example.org"""


def test_safety_case_fields(spark):
    found = safety_case.fields(F.col("t"))
    rows = spark.createDataFrame([(CASE,), ("",), (None,)], "t string").select(*(c.alias(n) for n, c in found.items())).collect()
    r = rows[0].asDict(recursive=True)
    assert len(r) == 46
    assert r == {
        "building_name": "Mill Court House", "building_address": "12 Mill Road, Leeds LS1 4AB", "bsr_registration_number": "HRB12345678", "building_reference": "B77", "uprn_labeled": "100000000001", "uprns": ["100000000001", "100000000002"],
        "building_height_metres": 17.5, "number_of_storeys": 6, "height_category": "MEDIUM_RISE", "construction_year": 1999, "building_type": "HRRB", "total_units": 24, "safety_case_version": "3.2", "safety_case_date": "2023-06-05",
        "principal_accountable_person": "Jo Bloggs", "building_safety_manager": "Kim Lee", "accountable_person_entity": "Example Homes Group", "fra_type": "Type 4", "fra_date": "2022-02-01", "fra_assessor": "Ada Byron", "fra_assessor_credentials": "AIFireE MIFireE",
        "fra_peer_reviewer": "Max Moe", "evacuation_strategy": "STAY_PUT", "evacuation_strategy_description": "Stay put unless told.", "personal_evacuation_plans_required": False, "fire_alarm_system_type": "BS 5839 pt1: L2", "smoke_detection_type": "L3",
        "firefighters_lift_present": True, "dry_riser_present": True, "wet_riser_present": False, "sprinklers_present": True, "aov_present": True, "emergency_lighting_present": True, "fire_compartmentation_status": "present", "premises_information_box_present": True,
        "construction_type": "Steel Frame", "cladding_type": "TIMBER", "cladding_status": "remediation_required", "building_control_certificate": True, "structural_issues_identified": True, "gas_detectors_present": True, "lightning_protection_present": True,
        "bsa_2022_applicable": True, "mandatory_occurrence_reporting_in_place": True, "resident_engagement_strategy_present": True, "key_contacts": [{"type": "building_safety", "email": "help@example.org"}, {"type": "emergency", "email": "help@example.org"}],
    }
    assert {v for v in rows[1] if not isinstance(v, list)} == {None, False} and rows[2].building_name is None


@pytest.mark.parametrize("page, start, size, want", [
    ("one. two three. four", 5, 3, "two three."), ("x" * 400, 200, 5, "x" * 320), ("y" * 600, 200, 6, "y" * 317 + "..."), ("a | b c | d", 4, 1, "b c"), ("• first. second", 2, 3, "first."), ("no span", -1, 3, None), (None, 1, 1, None),
])
def test_sentences(spark, page, start, size, want):
    found = spark.createDataFrame([(page, start, size)], "p string, a int, n int").select(documents.sentence(F.col("p"), F.col("a"), F.col("n")).alias("s")).first().s
    assert found == want


def test_workbooks_come_back(spark):
    rows = [("b", "One & <two>", 0, 0, ["a", None, "x < y"]), ("b", "One & <two>", 0, 4, ["", "b"]), ("b", "Last", 1, 2, ["c"]), ("b", "Last", 1, 3, ["", None]), ("c", "S", 0, 0, ["z"])]
    df = spark.createDataFrame(rows, workbook.SCHEMA)
    found = sorted((r.path, r.sheet, r.sheet_idx, r.row_idx, [c or None for c in r.cells]) for r in workbook.rows_of(workbook.made(df)).collect())
    assert found == sorted((p, s, i, n, [c or None for c in cells]) for p, s, i, n, cells in rows if any(cells))
    assert workbook.rows_of(workbook.made(df), first_sheet_only=True).count() == 3


def test_sheets_of_one_name_in_two_workbooks(spark):
    rows = [("a", "Stock", 0, 0, ["Property ref", "Address", "Postcode"]), ("a", "Stock", 0, 1, ["A1", "1 High Street", "AB1 2CD"]), ("b", "Stock", 0, 0, ["Postcode", "Property ref", "Address", "No. of beds"]), ("b", "Stock", 0, 1, ["AB9 9ZZ", "A1", "2 Low Road", "3"]), ("b", "Stock", 0, 2, ["AB9 9ZZ", "", "4 Low Road", ""])]
    df = spark.createDataFrame(rows, "path string, sheet string, sheet_idx int, row_idx int, cells array<string>")
    found = {(r.path, r.property_reference): (r.address, r.postcode, r.bedrooms) for r in ingest.properties(df).collect()}
    assert found == {("a", "A1"): ("1 High Street", "AB1 2CD", None), ("b", "A1"): ("2 Low Road", "AB9 9ZZ", 3), ("b", "AUTO_Stock_00001"): ("4 Low Road", "AB9 9ZZ", None)}
    assert [(p.path, p.columns["property_reference"], p.rows) for p in ingest.plan(df)] == [("a", 0, 2), ("b", 1, 3)]


def test_numbers_and_previous_values_over_ranges(spark):
    from groundplan.operators import numbering

    rows = [("one" if k % 10 else None, (k * 7919) % 1009) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v long")
    for ranges in (1, 7, 64):
        found = sorted((r.g is None, r.v, r.n) for r in numbering.numbered(df, ["g"], "v", "n", ranges).collect())
        want = [(none, v, n) for none in (False, True) for n, v in enumerate(sorted(x for g, x in rows if (g is None) == none), 1)]
        assert found == want
        before = {(r.g, r.v): r.p for r in numbering.previous(df, ["g"], "v", "p", ranges).collect()}
        for group in ("one", None):
            order = sorted(x for g, x in rows if g == group)
            assert [before[(group, v)] for v in order] == [None, *order[:-1]]
    assert numbering.numbered(df.limit(0), ["g"], "v", "n").collect() == []


def test_addresses_in_both_directions(spark):
    rows = [(1, "h", None, "12 HIGH STREET"), (2, "h", "B1", "12 HIGH STREET TOWN"), (3, "h", None, "FLAT 1 9 LOW ROAD"), (4, "h", "B3", "9 LOW ROAD"), (5, "h", "B2", "9 LOW ROAD"), (6, "h", None, "7 MILL LANE"), (7, "x", None, "12 HIGH STREET")]
    found = lookup.attached(spark.createDataFrame(rows, "property_id int, ha_id string, block_reference string, a string"))
    assert {tuple(r) for r in found.collect()} == {(1, "B1"), (3, "B2")}


@pytest.fixture
def plain_joins(spark):
    """No plan is changed while it runs, and nothing is broadcast that does not ask for it."""
    set_to = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def most_in_a_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


@pytest.mark.parametrize("most", [10, 0])
def test_rows_of_one_sheet_are_dealt_to_many_tasks(spark, plain_joins, most):
    """with few plans, and with so many that they are shuffled."""
    rows = spark.range(400, numPartitions=4).select(F.lit("b").alias("path"), F.lit(0).alias("sheet_idx"), F.col("id").cast("int").alias("row_idx"))
    wanted = spark.createDataFrame([("b", 0, 1), ("c", 0, 2)], "path string, sheet_idx int, header_row int")
    found = ingest.with_plans(rows, wanted, most)
    assert most_in_a_task(found) < 250 and found.columns == ["path", "sheet_idx", "row_idx", "header_row"]
    assert sorted(r.row_idx for r in found.where("header_row = 1").collect()) == list(range(400))


def test_without_rows_nothing_is_numbered(spark):
    """where every row has a reference, no window over them is planned."""
    none = spark.range(9).select(F.lit("b").alias("path"), F.col("id").cast("int").alias("row_idx")).where("row_idx > 20")
    found = numbering.numbered(none, ["path"], "row_idx", "n")
    assert found.collect() == [] and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_keys_that_no_key_equals_are_cut(spark, monkeypatch):
    """prefixes are made of the other keys alone, in the lengths that the other side has."""
    made = []
    monkeypatch.setattr(lookup, "cut", lambda df: made.append(df) or df)
    asked, known = spark.createDataFrame([(f"K{k}",) for k in range(50)] + [("Q1/7",)], "key string"), spark.createDataFrame([(f"K{k}", k) for k in range(50)] + [("Q1", 99), ("Q1/70", 98)], "key string, order int")
    found = lookup.references(asked, known)
    assert {tuple(r) for r in found.collect()} == {(f"K{k}", f"K{k}", 1) for k in range(50)} | {("Q1/7", "Q1/70", 3)}
    assert len(made) == 1 and made[0].where("matched is null").count() == 1


def test_rows_of_one_text_are_dealt_to_many_tasks(spark, plain_joins, monkeypatch):
    """F15, F16: a text of all rows is no task of its own; beyond the bound the result is the same."""
    df = spark.range(400, numPartitions=4).select("id", F.lit("1 High Street").alias("a"), F.when(F.col("id") > 1, "1 High St").alias("b"))
    found = similar.with_ratio(df, F.col("a"), F.col("b"), "r")
    assert most_in_a_task(found) == most_in_a_task(similar.with_segment_share(df, F.col("a"), F.col("b"), "s")) == 100
    rows = df.select(F.col("id").alias("property_id"), F.lit("h").alias("ha_id"), F.when(F.col("id") < 4, F.lit("B")).alias("block_reference"), "a")
    attached = lookup.attached(rows)
    assert attached.count() == 396 and most_in_a_task(attached) == 100
    lights = matching.traffic_lights(df.select("id", F.col("a").alias("given"), F.col("b").alias("matched"), F.lit(0.9).alias("os_match"), F.lit(None).cast("string").alias("parent_uprn"), F.lit(None).cast("string").alias("parent_address")))
    assert lights.count() == 400 and most_in_a_task(lights) == 100
    monkeypatch.setattr(similar, "BROADCAST_TEXTS", 1)
    assert sorted(similar.with_ratio(df, F.col("a"), F.col("b"), "r").collect()) == sorted(found.collect())


def test_workbooks_are_written_and_read_row_by_row():
    """neither a sheet's rows nor its tree are held."""
    import tracemalloc

    rows = lambda n: ((k, [f"name {k}", str(k)]) for k in range(n))
    tracemalloc.start()
    data = workbook.book([("Blocks", rows(60_000)), ("Totals", rows(1))])
    assert sum(1 for _ in workbook.sheets(data)) == 60_001 and sum(1 for _ in workbook.sheets(data, first_only=True)) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000


def test_names_of_a_schema_that_a_record_lacks_cost_nothing(spark):
    """violations come in the schema's order, and equal schemas are one rule."""
    schema = {"properties": {f"k{n}": {"type": "string"} for n in range(40)} | {"z": {"type": "integer"}, "a": {"type": "string"}}}
    df = spark.createDataFrame([('{"a": 1, "z": "x", "k7": null, "k30": 2, "k2": "ok", "o": 1}',), ("[1]",), ("{}",)], "t string")
    violations = json_schema.violations_of_text(schema, F.col("t"))
    assert [r.v for r in df.select(violations.alias("v")).collect()] == [["$.k7: type", "$.k30: type", "$.z: type", "$.a: type"], [], []]
    assert df.select(violations.alias("v"))._jdf.queryExecution().analyzed().toString().count("schema_of_variant") < 5


def test_addresses_are_made_once(spark):
    """F16: the last join reads written addresses; it does not make those of all rows again to see which it can drop."""
    rows = spark.createDataFrame([(1, "h", None, "1 High St"), (2, "h", "B", "flat 2 1 high st"), (3, "h", None, "9 low st")], "property_id int, ha_id string, block_reference string, raw string")
    found = lookup.attached(rows.select("property_id", "ha_id", "block_reference", F.upper("raw").alias("a")))
    assert "upper(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "B")]
