"""Relational, spatial, graph and ingest operators on small tables."""

import io
import os
import zipfile
from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundplan.functions import address, bands, geo, rules, scoring, values
from groundplan.operators import detect, documents, graph, ingest, json_schema, relational, similar, spatial, validate
from groundplan.sources import exports, readers, snapshots, workbook
from groundplan.streaming import arrivals


def one(spark, column, **cells):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items())) if cells else spark.range(1)
    return row.select(column.alias("v")).first().v


def each(spark, f, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("text", "band"),
    [("Tolerable but must reduce", "AMBER"), ("No significant findings", "GREEN"), ("VERY HIGH", "RED"), ("non-high", "RED"), ("grade b", "GREEN"), ("5/5", "RED"), ("3", "AMBER"), ("9", "AMBER"), ("priority 3", "GREEN"), ("N/A", None), ("  ", None), (None, None), ("mauve", "AMBER"), ("–", None)],
)
def test_fra_ratings(spark, text, band):
    assert each(spark, rules.fra_rating, [text]) == [band]


def test_fraew_ratings(spark):
    texts = ["not acceptable", "Broadly acceptable", "no further action", "further assessment", "tolerable with concerns", "tolerable", "tbc", "odd"]
    assert each(spark, rules.fraew_rating, texts) == ["RED", "GREEN", "GREEN", "AMBER", "AMBER", "GREEN", None, "AMBER"]


def test_dwellings(spark):
    forms = each(spark, lambda t: rules.dwelling_form(t, F.lit("Detached")), ["Bungalow flat", "Semi", "Bedsit", "", None, "Castle", "Shop"])
    assert forms == ["bungalow", "house", "flat", "house", "house", "other", "commercial"]
    requirement = lambda f, s: rules.fra_requirement(F.lit(f), F.lit(s))
    assert [one(spark, requirement(*x)) for x in (("house", True), ("house", False), ("garage", None), (None, True), ("flat", False))] == ["not_required", "required", "not_required", "unknown", "required"]


def test_values(spark):
    assert each(spark, values.money, ["£1,234.50", "0", "n/a", None, " 7 "]) == [1234.5, None, None, None, 7.0]
    assert each(spark, values.year, ["1987", "1987.0", "built P2002H", "19TO44T", "1650", "c", None]) == [1987, 1987, 2002, 1931, None, None, None]
    assert each(spark, values.storeys, ["3", "4 + basement", "1 basement", "x"]) == [3, 3, 1, None]
    assert each(spark, values.date, ["2024-03-05T10:00", "5th March 2024", "05/03/2024", "5 Mar 2024", "March 5, 2024", "March 2024", "soon", None]) == [date(2024, 3, 5)] * 5 + [date(2024, 3, 1), None, None]
    assert each(spark, values.boolean, ["Yes", "fitted", "none", "maybe", None]) == [True, True, False, None, None]
    assert each(spark, values.schedule_boolean, ["Y", "maybe", None]) == [True, False, None]
    assert [values.insured_year(h) for h in ("Sum Insured 24/25", "RCA 2025", "x", "2024-25")] == [2025, 2025, 0, 2025]
    assert each(spark, values.whole_number, ["2.5", "3.5", "£12"]) == [2, 4, 12]


def test_addresses(spark):
    assert each(spark, address.standard, ["40 Balmore Road 0/1, Glasgow", "45 High Street, Flat 3, Oxford", "Flat 1/1, 2 Road", "1 Road", None]) == ["0/1, 40 Balmore Road, Glasgow", "Flat 3, 45 High Street, Oxford", "Flat 1/1, 2 Road", "1 Road", None]
    assert each(spark, address.normal_postcode, ["g42 9lf", "G429LF", "AB1"]) == ["G42 9LF", "G42 9LF", "AB1"]
    assert each(spark, address.postcode, ["x ox29 6sp y", "none"]) == ["OX29 6SP", None]
    assert each(spark, address.distinct_segments, ["A, b, a, C"]) == ["A, b, C"]
    assert each(spark, address.building_number, ["Flat 3, 1 Grange Road", "328 Holmlea Road G42 9LF"]) == ["1", "328"]
    assert each(spark, address.flat_number, ["Flat 0/2, 1 Road", "60/3 Road", "1 Road"]) == ["2", "3", None]
    row = similar.with_comparison(spark.createDataFrame([("1 High St, Town", "Town, 1 High St")], "a string, b string"), F.col("a"), F.col("b")).first()
    assert (row.score, row.level) == (1.0, "HIGH")


def test_similarities_of_distinct_pairs(spark):
    """Equal to the sliding matcher and to a loop over segments, for repeated, empty and null texts."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc ,") for _ in range(n))
    rows = [(k, word(rng.randrange(40)), word(rng.randrange(40))) for k in range(60)] + [(60, None, "a"), (61, "", ""), (62, "a, b", None), (63, "ab" * 150, "ab" * 140 + "c")]
    rows += [(k + 100, a, b) for k, a, b in rows[:20]]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    found = {r.k: (r.ratio, r["share"]) for r in similar.with_segment_share(similar.with_ratio(df, F.col("a"), F.col("b"), "ratio"), F.col("a"), F.col("b"), "share").collect()}
    split = lambda x: [p for p in (q.strip() for q in (x or "").split(",")) if p]
    for k, a, b in rows:
        close = sum(max((SequenceMatcher(None, i, j).ratio() for j in split(b)), default=0) >= 0.85 for i in split(a))
        assert found[k] == (SequenceMatcher(None, a or "", b or "").ratio(), close / len(split(a)) if split(a) else 0.0)


def test_quotes_are_found_where_the_sliding_matcher_finds_them(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    pairs = []
    for _ in range(80):
        page = "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(5, 300)))
        size = rng.randrange(8, 60)
        at = rng.randrange(0, max(1, len(page) - size))
        quote = "".join(rng.choice("xyz") if rng.random() < rng.choice([0.02, 0.1, 0.2]) else c for c in page[at : at + size])
        pairs.append((quote, page))

    def slid(quote, page):
        best, place = 0.0, None
        for s in range(0, max(1, len(page) - len(quote) + 1), max(1, len(quote) // 4)):
            ratio = SequenceMatcher(None, page[s : s + len(quote)], quote, autojunk=False).ratio()
            if ratio >= 0.85 and ratio > best:
                best, place = ratio, s
        return place if len(quote) >= 12 else None

    found = {(r.q, r.p): r.place for r in similar.quote_places(spark.createDataFrame(pairs * 2, "q string, p string")).collect()}
    assert found == {(q, p): slid(q, p) for q, p in pairs if slid(q, p) is not None} and len(found) > 20


def test_grid_reference(spark):
    """A published example: the grid point 651409.903, 313177.270 on the older datum."""
    point = geo.grid_to_degrees(F.lit(651409.903), F.lit(313177.270))
    lat, lon = one(spark, point)
    assert abs(lat - 52.657977) < 2e-5 and abs(lon - 1.716038) < 2e-5


def test_bands(spark):
    years = spark.createDataFrame([(None,), (1918,), (1919,), (2011,)], "y int").select(bands.age_band(F.col("y")).alias("b")).collect()
    assert [r.b for r in years] == [None, "Pre-1919", "1919-1944", "Post-2010"]


def test_latest_and_mode(spark):
    rows = spark.createDataFrame([(1, date(2020, 1, 1), 1, "a"), (1, None, 9, "b"), (1, date(2020, 1, 1), 2, "b"), (2, None, 1, None)], "k int, d date, tie int, v string")
    assert {(r.k, r.tie) for r in relational.latest(rows, "k", "d", "tie").collect()} == {(1, 2), (2, 1)}
    assert {(r.k, r.v) for r in relational.mode(rows, ["k"], "v").collect()} == {(1, "b")}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in relational.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, None), (3, "c")}
    kept = relational.upsert(old, new, ["k"], {"v": F.coalesce("new.v", "old.v")})
    assert {tuple(r) for r in kept.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert relational.insert_absent(old, new, ["k"]).count() == 3


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(-90, 90), st.integers(-90, 90)), min_size=1, max_size=25))
def test_grid_join_is_exact(spark, points):
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "a int, easting double, northing double")
    found = {(r.a, r.b) for r in spatial.within(df, df.withColumnRenamed("a", "b"), 30).collect()}
    want = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 900}
    assert found == want


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (8, 9)], "source_id long, target_id long")
    assert {(r.source_id, r.target_id) for r in graph.closure(edges, 1, 2).collect()} == {(1, 2), (2, 3), (3, 1), (3, 4)}
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "child long, parent long")
    assert {(r.child, r.root) for r in graph.roots(parents).collect()} >= {(1, 1), (2, 1), (3, 1)}


def test_scores_keep_unknown_flags(spark):
    schema = "rag_status string, assessment_valid_until date, fra_assessment_type string, overdue_action_count int, outstanding_action_count int, no_date_action_count int, has_smoke_detection boolean, has_fire_doors boolean, has_compartmentation boolean, has_emergency_lighting boolean, bsa_2022_applicable boolean, accountable_person_noted boolean, mandatory_occurrence_noted boolean, evacuation_strategy_changed boolean"
    rows = [("GREEN", None, None, 0, 0, None, None, None, None, None, None, None, None, None), ("RED", date(2000, 1, 1), "Type 1", 9, 20, 9, False, False, False, False, True, None, True, True), (None, date(2024, 2, 1), None, None, 3, 0, True, True, True, True, False, None, False, False)]
    scored = spark.createDataFrame(rows, schema).select(scoring.fra_score(F.lit("2024-01-01").cast("date")).alias("s")).collect()
    assert [(r.s.score, r.s.band, r.s.floor_applied) for r in scored] == [(10.0, "GREEN", False), (0.5, "RED", True), (7.5, "GREEN", False)]
    assert scored[0].s.notes == [] and "floor of 0.5 applied" in scored[1].s.notes


def test_detection(spark):
    rows = [("100000000001", "2024-01-05", "yes", "55.8", "G42 9LF"), ("100000000002", "2024-02-05", "no", "51.5", "OX29 6SP"), (None, None, None, None, None)]
    found = {r.column: r.detected_type for r in detect.types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string")).collect()}
    assert found == {"a": "uprn", "b": "date", "c": "boolean", "d": "latitude", "e": "postcode"}


def test_validation_and_json(spark):
    df = spark.createDataFrame([("1", 5, "Z"), (None, 50, "A")], "u string, n int, e string")
    checks = [validate.Check("u", required=True, pattern=r"^\d{2}$"), validate.Check("n", least=1, most=10), validate.Check("e", allowed=("A",))]
    assert [r.e for r in df.select(validate.errors(checks).alias("e")).collect()] == [["u: pattern", "e: enum"], ["u: required", "n: range"]]
    assert each(spark, validate.repaired_json, ['```{"a": True, "b": [None, 1,],}```', "none"]) == ['{"a": true, "b": [null, 1]}', None]


def test_citations(spark):
    text = "[Page 1] The doors are old. They were   checked by hand. [Page 2] Second. [Page 3] The alarm was tested in may. Fine."
    pages = documents.pages(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert pages.count() == 3
    rows = [(1, "a", 1, "they were checked by hand", "H"), (1, "b", 2, "The alarm wes tested in may", "M"), (1, "c", 1, "The alarm was tested", None), (1, "d", 1, "nothing like it at all", "H")]
    found = {r.field: r for r in documents.verified(spark.createDataFrame(rows, "doc_id int, field string, page int, quote string, confidence string"), pages).collect()}
    assert [(found[k].found_page, found[k].score) for k in "abcd"] == [(1, 1.0), (3, 0.75), (3, 0.65), (None, 0.3)]
    assert found["a"].snippet == "they were checked by hand."


def xlsx(rows):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Stock" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Address</t></si></sst>')
        cell = lambda k, r, v: f'<c r="{chr(65 + k)}{r}" t="s"><v>0</v></c>' if v == "Address" else f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        body = "".join(f'<row r="{r}">' + "".join(cell(k, r, v) for k, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows, 1))
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return data.getvalue()


def test_workbook_ingest(spark, tmp_path):
    rows = [["Title"], ["Property Ref", "Address", "Postcode", "Sum Insured 23/24", "Sum Insured 24/25", "Storeys", "Year Built"], ["A1", "Flat 2, 1 Road", "G42 9LF", "1", "£2,000", "3", "P1982T"], ["A1", "2 Road", "", "1", "5", "2", ""], ["", "3 Road, OX29 6SP", "", "", "", "", ""], ["Total", "", "", "", "9", "", ""], ["Filter: all"]]
    (tmp_path / "book.xlsx").write_bytes(xlsx(rows))
    cells = workbook.workbooks(spark, str(tmp_path))
    found = {r.property_reference: r for r in ingest.properties(cells).collect()}
    assert set(found) == {"A1", "AUTO_Stock_00001"}
    a = found["A1"]
    assert (a.address, a.postcode, a.sum_insured, a.storeys, a.year_of_build, a.age_banding) == ("Flat 2, 1 Road", "G42 9LF", 2000.0, 3, 1982, "1981-1990")
    assert found["AUTO_Stock_00001"].postcode == "OX29 6SP"


def test_readers(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text('Property-Ref,ZIP code,zip_code\n1,"a ""b"", c",\n')
    assert tuple(readers.delimited(spark, str(path)).first()) == ("1", 'a "b", c', None)
    assert readers.delimited(spark, str(path)).columns == ["property_reference", "postcode", "postcode_2"]
    with pytest.raises(ValueError, match="not a .csv"):
        readers.delimited(spark, str(tmp_path / "u.xlsx"))
    assert readers.standard_names(["Post Code", "zip", "A-b c!"]) == {"Post Code": "postcode", "zip": "postcode_2", "A-b c!": "a_b_c"}
    schedule = exports.schedule(spark.createDataFrame([("r",)], "property_reference string"))
    assert len(schedule.columns) == 46 and schedule.first()["Property Reference"] == "r"


def test_stream_upsert_and_windows(spark, tmp_path):
    source, target = str(tmp_path / "in" / "events.parquet"), str(tmp_path / "out")
    table = pa.table({"event_id": range(30), "user_id": [k % 3 for k in range(30)], "event_type": ["x"] * 30, "value": [1.0] * 30, "ts": pa.array([datetime(2024, 1, 1) + timedelta(minutes=10 * k) for k in range(30)], pa.timestamp("us"))})
    os.makedirs(os.path.dirname(source))
    pq.write_table(table, source)
    stream = arrivals.events(spark, str(tmp_path / "in"), "events.parquet")
    for _ in range(2):  # the second run has nothing new
        upserts = snapshots.SnapshotTable(spark, target, "user_id long, event_id long")
        arrivals.into_table(stream.select("user_id", "event_id"), upserts, "w", str(tmp_path / "c1")).awaitTermination()
        assert {tuple(r) for r in upserts.current(["user_id"], F.col("event_id")).collect()} == {(0, 27), (1, 28), (2, 29)}
        assert upserts.last()["rows"] == 30
    closed = arrivals.drained(arrivals.tumbling(stream), "t_windows", str(tmp_path / "c2")).collect()
    assert {r.n for r in closed} == {6} and len(closed) >= 3
    assert arrivals.drained(arrivals.once_per_key(stream, ["user_id"]), "t_once", str(tmp_path / "c3")).count() == 3


def test_drained_rows_stay_in_files(spark, tmp_path):
    """No row of a stream goes through the driver; a second run adds what has come since."""
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    found = arrivals.drained(stream, "t_files", str(tmp_path / "c"))
    assert found.inputFiles() and sorted(r.id for r in found.collect()) == list(range(5))
    spark.range(5, 8).write.mode("append").parquet(source)
    assert sorted(r.id for r in arrivals.drained(stream, "t_files", str(tmp_path / "c")).collect()) == list(range(8))
    assert arrivals.drained(stream.where("id < 0"), "t_none", str(tmp_path / "d")).count() == 0


def test_crowded_cells_are_split(spark, monkeypatch):
    """Nearly all points in one cell, many of them at one place: equal pairs, and no leaf above the bound."""
    import random

    rng = random.Random(6)
    points = [(k, rng.random() * 10, rng.random() * 10) if k % 3 else (k, 5.0, 5.0) for k in range(600)] + [(600 + k, 1000.0 + k, 7.0 * k) for k in range(20)]
    asked = [(k, rng.random() * 30 - 10, rng.random() * 30 - 10) for k in range(40)]
    a, b = spark.createDataFrame(asked, "q int, easting double, northing double"), spark.createDataFrame(points, "p int, easting double, northing double")
    want = sorted((q, p) for q, x, y in asked for p, u, v in points if (x - u) ** 2 + (y - v) ** 2 <= 144)
    for bound in (20_000, 25):
        monkeypatch.setattr(spatial, "CELL_POINTS", bound)
        found = spatial.within(a, b, 12.0)
        assert sorted((r.q, r.p) for r in found.collect()) == want and found.columns == ["q", "easting", "northing", "p", "distance"]
    cells = b.withColumns({"rx": F.floor(F.col("easting") / 12), "ry": F.floor(F.col("northing") / 12)}).groupBy("rx", "ry").count().where("count > 25")
    leaves = spatial._leaves(b, 12.0, spatial.XY, cells).collect()
    assert max(r.level for r in leaves) > 1 and max(r.parts for r in leaves) > 1


def test_greedy_pairs_by_region_and_in_rounds(spark, monkeypatch):
    import random

    rng = random.Random(8)
    rows = [(p, s, rng.randrange(20) / 2) for p in range(40) for s in range(p, p + 3)] + [(p, 100 + p % 7, rng.random()) for p in range(50, 90)]
    taken, want = set(), {}
    for p in sorted({r[0] for r in rows}):
        free = sorted((d, s) for q, s, d in rows if q == p and s not in taken)
        if free:
            taken.add(free[0][1])
            want[p] = free[0][1]
    df = spark.createDataFrame(rows, "point long, shape long, distance double")
    for most in (100_000, 50, 0):
        monkeypatch.setattr(spatial, "REGION_ROWS", most)
        assert {r.point: r["shape"] for r in spatial.greedy_pairs(df).collect()} == want
    assert spatial.greedy_pairs(df.limit(0)).collect() == []


def test_repairs_and_retention(spark):
    from groundplan.operators import retention

    texts = ["12.7", "101", "x", None, " EPS ", "yes", "0", "2024-02-30", "01.02.2024"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    v = F.col("t")
    columns = {"n": validate.repaired_number(v, 0, 100, whole=True), "c": validate.repaired_choice(v, ("eps", "pir"), "unknown"), "f": validate.repaired_flag(v), "d": validate.repaired_date(v)}
    found = {r.k: {n: tuple(r[n]) for n in columns} for r in df.select("k", *(c.alias(n) for n, c in columns.items())).collect()}
    assert [found[k]["n"] for k in range(4)] == [(12, None), (None, "outside 0-100, nulled"), (None, "not a number, nulled"), (None, None)]
    assert found[4]["c"] == ("eps", None) and found[2]["c"] == ("unknown", "not a valid value, set to unknown") and found[3]["c"] == (None, None)
    assert found[5]["f"] == (True, None) and found[6]["f"] == (False, None) and found[2]["f"] == (None, "not a yes or no, nulled")
    assert found[7]["d"] == (None, "not a date, nulled") and found[8]["d"] == (date(2024, 2, 1), None)
    rows = spark.createDataFrame([(1, "a", date(2020, 1, 1)), (2, "a", date(2024, 1, 1)), (3, "b", date(2000, 1, 1)), (4, "c", date(2000, 1, 1))], "id int, data_type string, created_on date")
    policies = spark.createDataFrame([("a", 365, True), ("b", 1, False)], "data_type string, retention_days int, auto_delete boolean")
    kept, audit = retention.enforce(rows, policies, "id", F.lit(date(2024, 6, 1)))
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4] and [(r.id, r.deleted_on) for r in audit.collect()] == [(1, date(2024, 6, 1))]


def test_json_schemas(spark):
    from groundplan.plans import record_schemas

    schema = {
        "definitions": {"small": {"type": "integer", "exclusiveMaximum": 5}},
        "type": "object", "required": ["a", "b c"],
        "properties": {"a": {"$ref": "#/definitions/small"}, "b c": {"type": ["string", "null"], "minLength": 2, "maxLength": 3}, "d": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"anyOf": [{"const": "x"}, {"type": "number", "multipleOf": 0.5}]}}, "e": False, "f": {"not": {"enum": [None, True, 2]}}},
        "patternProperties": {"^n_": {"type": "object", "additionalProperties": {"oneOf": [{"type": "integer"}, {"minimum": 3}]}}},
        "additionalProperties": False,
    }
    cases = {
        '{"a": 1, "b c": null}': [], '{"a": 4.0, "b c": "😀z"}': [], '{"a": 5, "b c": "long"}': ["$.a: exclusiveMaximum", "$.b c: maxLength"],
        '{"a": "1"}': ["$.b c: required", "$.a: type"], '{"a": 1, "b c": "xy", "d": [], "e": 0}': ["$.d: minItems", "$.e: false"],
        '{"a": 1, "b c": "xy", "d": ["x", 0.25, 1.5]}': ["$.d: maxItems", "$.d[1]: anyOf"], '{"a": 1, "b c": "xy", "f": 2.0}': ["$.f: not"], '{"a": 1, "b c": "xy", "f": "2"}': [],
        '{"a": 1, "b c": "xy", "n_1": {"k": 3}, "n_2": {"k": 2, "l": "s"}, "n_3": [], "o": {}}': ["$.n_1.k: oneOf", "$.n_3: type", "$.o: additionalProperties"],
        "[]": ["$: type"], "null": ["$: type"], "{": ["$: json"], "": ["$: json"],
    }
    texts = [*cases, None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", json_schema.violations_of_text(schema, F.col("t")).alias("v"))
    assert {texts[r.k]: r.v for r in df.collect()} == cases | {None: ["$: json"]}
    for wrong in ({"contains": {}}, {"$ref": "other.json"}, {"enum": [[1]]}, {"definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}, "$ref": "#/definitions/a"}):
        with pytest.raises(ValueError):
            json_schema.violations(wrong, F.lit(None))
    scores = {"detected_type": "year", "confidence": 0.9, "all_scores": {"year": 1, "date": 0.2}, "format": "%Y", "unique_count": 3}
    import json

    found = spark.createDataFrame([(json.dumps({"built": scores, "x": {**scores, "format": "%Y%m%d", "confidence": 1.5, "all_scores": {"colour": 1}}}), json.dumps({"id": True, "uprn": 1.5, "new": []}))], "d string, s string")
    row = found.select(json_schema.violations_of_text(record_schemas.DETECTION, F.col("d")).alias("d"), json_schema.violations_of_text(record_schemas.STANDARDIZED, F.col("s")).alias("s")).first()
    assert sorted(row.d) == ["$.built.format: enum", "$.x.all_scores.colour: additionalProperties", "$.x.confidence: maximum"] and sorted(row.s) == ["$.id: type", "$.uprn: type"]
