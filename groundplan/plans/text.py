"""Text, array and document operators: names, labels, legacy ratings, extraction, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.functions import address, bands, geo, rules, scoring, values
from groundplan.operators import detect, documents, extract, lookup, retention, safety_case, similar, spatial, validate
from groundplan.plans.registry import RATIO_SQL, query
from groundplan.plans.relational import assessed_blocks
from groundplan.plans.scores import _RATINGS_SQL, ratings
from groundplan.plans.silver import AS_OF, Silver
from groundplan.sources import readers

col = F.col
_NONE = r"^(n/a|not assessed|unknown|tbc|tbd|none)$"
#: The older Python ratings, kept by name beside the canonical ones.
FRA_LEGACY = (
    (_NONE, None), (r"intolerable|substantial|very high|critical|serious|extreme|unacceptable|not acceptable|priority 1|grade e|grade d|4/5|5/5|^high$", "RED"),
    (r"moderate|medium|significant|tolerable but|tolerable with|further action|further assessment|priority 2|grade c|3/5", "AMBER"),
    (r"trivial|low|acceptable|no further action|negligible|priority 3|grade a|grade b|1/5|2/5|^tolerable$", "GREEN"),
)
FRAEW_LEGACY = (
    (_NONE, None), (r"not acceptable|unacceptable|high|intolerable|extreme|critical|category b2|category c", "RED"), (r"no further action|broadly acceptable|low|negligible|category a|^tolerable$", "GREEN"),
    (r"tolerable but|tolerable with|further action|further assessment|medium|moderate|significant|category b1", "AMBER"),
)
STATUSES = ((r"complet|done|resolved|closed|actioned|fixed", "completed"), (r"overdue|past due|late|missed", "overdue"))
HAZARDS = ((r"housekeep|storage|waste|rubbish|clutter", "Housekeeping"), (r"escape|exit|egress|corridor|stair", "Means of Escape"), (r"spread|compartment|cladding|stopping|intumescent", "Fire Spread"), (r"detect|alarm|smoke|heat|aov", "Detection"), (r"sign|notice|label|marking", "Signage"))
WALLS = {"sandstone/brick": "Sandstone/Brick", "brick": "Brick", "sandstone": "Sandstone", "brick or block or stone": "Brick/Block/Stone", "other non-standard or system build": "Other / Non-standard", "timber or wood": "Timber"}


@query("sco_02", f"SELECT event_id, {rules.cascade_sql('rating', FRA_LEGACY, 'AMBER')} AS band FROM ({_RATINGS_SQL}) r")
def fra_legacy(s: Silver) -> DataFrame:
    return ratings(s).select("event_id", rules.cascade(col("rating"), FRA_LEGACY, "AMBER").alias("band"))


@query("sco_04", f"SELECT event_id, {rules.cascade_sql('rating', FRAEW_LEGACY, 'AMBER')} AS band FROM ({_RATINGS_SQL}) r")
def fraew_legacy(s: Silver) -> DataFrame:
    return ratings(s).select("event_id", rules.cascade(col("rating"), FRAEW_LEGACY, "AMBER").alias("band"))


#: Field, confidence where its column was named, and where it was guessed.
_CONFIDENCE = (("address", 0.95, 0.80), ("postcode", 0.90, 0.75), ("sum_insured", 0.90, 0.60), ("block_reference", 0.90, 0.75), ("wall_construction", 0.85, 0.70))


@query("sco_17", "SELECT property_id, CAST(CASE WHEN property_id % 10 = 0 THEN 0.5 WHEN property_id % 3 = 0 THEN 0.85 ELSE 1.0 END AS DOUBLE) AS property_reference, " + ", ".join(f"CAST(CASE WHEN {c} IS NULL THEN 0.0 WHEN property_id % 3 = 0 THEN {h} ELSE {n} END AS DOUBLE) AS {c}" for c, n, h in _CONFIDENCE) + " FROM properties")
def field_confidence(s: Silver) -> DataFrame:
    """Generated references get 0.5; fields whose columns were found by heuristics (a third of the rows here) lose 0.15, sums insured twice that."""
    reference = F.when(col("property_id") % 10 == 0, F.concat(F.lit("AUTO_"), "property_reference")).otherwise(col("property_reference"))
    rows = s.properties.withColumns({"reference": reference, "guessed": col("property_id") % 3 == 0})
    kept = scoring.ingest_confidence("reference", [(c, n) for c, n, _ in _CONFIDENCE], col("guessed"))
    return rows.select("property_id", kept["reference"].alias("property_reference"), *(kept[c].alias(c) for c, _, _ in _CONFIDENCE))


@query("sco_20", "SELECT item_id AS doc_id, i AS item, CASE WHEN i < 3 THEN i <> 2 END AS source_verified, CAST(CASE i WHEN 0 THEN 1 WHEN 1 THEN 2 END AS INT) AS source_page FROM {benchmark}, (SELECT unnest([0, 1, 2, 3]) AS i) t")
def item_sources(s: Silver) -> DataFrame:
    """Of each document: an item of its own page, one that the next page holds, one that nobody wrote, and one too short to tell."""
    marked = s.benchmark.select(col("item_id").alias("doc_id"), F.concat(F.lit("[Page 1] "), "text", F.lit(" [Page 2] replace the damaged fire door of the north stair at once. End.")).alias("text"))
    item = lambda k, page, text: F.struct(F.lit(k).alias("item"), F.lit(page).alias("page"), text.alias("text"))
    items = F.array(item(0, 1, col("text")), item(1, 1, F.lit("Replace the damaged fire door of the north stair, soon")), item(2, 1, F.lit("install a helicopter landing pad on every single roof")), item(3, 2, F.lit("fix it")))
    rows = s.benchmark.select(col("item_id").alias("doc_id"), F.explode(items).alias("i")).select("doc_id", "i.*")
    return documents.item_sources(rows, documents.pages(marked)).select("doc_id", "item", "source_verified", "source_page")


_RAW = "CASE event_id % 6 WHEN 0 THEN CAST(event_id % 130 AS VARCHAR(20)) WHEN 1 THEN 'about 40' WHEN 2 THEN 'PIR' WHEN 3 THEN 'Yes' WHEN 4 THEN '2024-02-30' ELSE '17/03/2023' END"
_DATE_OK = "CASE WHEN raw = '17/03/2023' THEN DATE '2023-03-17' END"
_NUMBER = "TRY_CAST(raw AS DOUBLE)"


@query("sco_22", f"""SELECT event_id, CASE WHEN {_NUMBER} BETWEEN 0 AND 100 THEN {_NUMBER} END AS coverage, CASE WHEN {_NUMBER} IS NULL THEN 'not a number, nulled' WHEN NOT {_NUMBER} BETWEEN 0 AND 100 THEN 'outside 0-100, nulled' END AS coverage_warning,
 CASE WHEN raw = 'PIR' THEN 'pir' ELSE 'unknown' END AS insulation, CASE WHEN raw <> 'PIR' THEN 'not a valid value, set to unknown' END AS insulation_warning,
 CASE WHEN raw IN ('Yes', '1') THEN TRUE WHEN raw = '0' THEN FALSE END AS flag, CASE WHEN raw NOT IN ('Yes', '1', '0') THEN 'not a yes or no, nulled' END AS flag_warning, {_DATE_OK} AS day, CASE WHEN ({_DATE_OK}) IS NULL THEN 'not a date, nulled' END AS day_warning FROM (SELECT event_id, {_RAW} AS raw FROM {{events}}) x""")
def validators(s: Silver) -> DataFrame:
    """Numbers, choices, flags and dates repaired, each with a warning where the given value was not one."""
    raw = s.events.select("event_id", F.expr(_RAW).alias("raw"))
    v = col("raw")
    found = {"coverage": validate.repaired_number(v, 0, 100), "insulation": validate.repaired_choice(v, ("eps", "mineral_wool", "pir", "phenolic"), "unknown"), "flag": validate.repaired_flag(v), "day": validate.repaired_date(v)}
    return raw.select("event_id", *(c for n, r in found.items() for c in (r["value"].alias(n), r["warning"].alias(f"{n}_warning"))))


@query("sco_25_status", f"SELECT event_id, {rules.cascade_sql('event_type', STATUSES, 'outstanding')} AS status FROM {{events}}")
def statuses(s: Silver) -> DataFrame:
    return s.events.select("event_id", rules.cascade(col("event_type"), STATUSES, "outstanding").alias("status"))


@query("sco_25_hazard", f"SELECT doc_id, {rules.cascade_sql('text', HAZARDS, 'Other')} AS hazard FROM {{documents}}")
def hazards(s: Silver) -> DataFrame:
    return s.documents.select("doc_id", rules.cascade(col("text"), HAZARDS, "Other").alias("hazard"))




@query("sco_26", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS job_reference, concat('acme ', CAST(s_suppkey AS VARCHAR), ' limited') AS client_name, '2022' AS pas_9980_version, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'low' END AS building_risk_rating, CAST(s_suppkey % 30 + 1 AS VARCHAR) AS num_storeys FROM {supplier}")
def extraction(s: Silver) -> DataFrame:
    key = col("s_suppkey").cast("string")
    text = F.concat(F.lit("Job No: "), key, F.lit("\nClient: Acme "), key, F.lit(" Limited\nPAS 9980: 2022. The building risk rating is therefore considered as "), F.when(col("s_suppkey") % 2 == 0, "HIGH").otherwise("LOW"), F.lit(". It is "), (col("s_suppkey") % 30 + 1).cast("string"), F.lit(" storeys."))
    found = extract.fields(text, extract.FRAEW)
    return s.supplier.select("s_suppkey", *(found[k].alias(k) for k in ("job_reference", "client_name", "pas_9980_version", "building_risk_rating", "num_storeys")))


_CASES = """SELECT s_suppkey AS k, concat('Building Safety Case Report\nBuilding name: Aura', 'Court ', CAST(s_suppkey AS VARCHAR(20)), '\nAddress: ', CAST(s_suppkey AS VARCHAR(20)), ' Mill Road, Leeds LS1 4AB. UPRN: ',
 CASE WHEN s_suppkey % 2 = 0 THEN '100000000001' ELSE 'BR7' END, '\n', CASE s_suppkey % 3 WHEN 0 THEN 'Height: 21.5 m' WHEN 1 THEN '5 storeys' ELSE 'no size' END, '\nBuilt: 1984. ', CAST(s_suppkey % 70 + 1 AS VARCHAR(20)), ' flats\nVersion: 2.1\nIssue date: 03/04/2023\nPrincipal Accountable Person: Jo Bloggs\nManaging agent: Example Homes Limited\nFRA date: 01-02-2022\nAssessor: Kim Lee MIFSM, CMIOSH\n',
 CASE s_suppkey % 4 WHEN 0 THEN 'Evacuation strategy: stay put for all flats.' WHEN 1 THEN 'A phased evacuation is used.' WHEN 2 THEN 'PEEPs exist.' ELSE '' END, '\nCladding type: brick slip\nno ACM. Dry riser. Fire safety team: Fire@Example.org') AS t FROM {supplier}"""


@query("sco_26_scr", r"""SELECT s_suppkey AS k, concat('Aura Court ', CAST(s_suppkey AS VARCHAR)) AS building_name, concat(CAST(s_suppkey AS VARCHAR), ' Mill Road, Leeds LS1 4AB') AS building_address, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'BR7' END AS building_reference,
 CASE WHEN s_suppkey % 2 = 0 THEN '100000000001' ELSE '' END AS uprns, CASE s_suppkey % 3 WHEN 0 THEN 'HIGH_RISE' WHEN 1 THEN 'MEDIUM_RISE' END AS height_category, 1984 AS construction_year, CAST(s_suppkey % 70 + 1 AS INT) AS total_units, '2.1' AS safety_case_version, '2023-04-03' AS safety_case_date,
 'Jo Bloggs' AS principal_accountable_person, 'Example Homes Limited' AS accountable_person_entity, '2022-02-01' AS fra_date, 'Kim Lee' AS fra_assessor, 'MIFSM CMIOSH' AS fra_assessor_credentials, CASE s_suppkey % 4 WHEN 0 THEN 'STAY_PUT' WHEN 1 THEN 'PHASED' END AS evacuation_strategy,
 CASE s_suppkey % 4 WHEN 0 THEN 'stay put for all flats.' END AS evacuation_strategy_description, s_suppkey % 4 = 2 AS personal_evacuation_plans_required, TRUE AS dry_riser_present, FALSE AS wet_riser_present, 'BRICK SLIP' AS cladding_type, 'safe' AS cladding_status, 'fire@example.org' AS contact, CAST(46 AS INT) AS fields FROM {supplier}""")
def safety_cases(s: Silver) -> DataFrame:
    """Safety case reports made of the suppliers; all fields are computed, those that vary are returned."""
    found = safety_case.fields(col("t"))
    rows = s.sql(_CASES).select("k", *(c.alias(n) for n, c in found.items()))
    names = ("building_name", "building_address", "building_reference", "height_category", "construction_year", "total_units", "safety_case_version", "safety_case_date", "principal_accountable_person", "accountable_person_entity", "fra_date", "fra_assessor", "fra_assessor_credentials", "evacuation_strategy", "evacuation_strategy_description", "personal_evacuation_plans_required", "dry_riser_present", "wet_riser_present", "cladding_type", "cladding_status")
    return rows.select("k", *names, F.array_join("uprns", ",").alias("uprns"), col("key_contacts")[0]["email"].alias("contact"), F.lit(len(found)).alias("fields"))


@query("sco_27", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'word box inverted' ELSE 'word outside page' END AS errors FROM {supplier}")
def layout(s: Silver) -> DataFrame:
    n = lambda v: F.lit(float(v))
    k = col("s_suppkey") % 3
    word = F.struct(F.when(k == 1, n(50)).otherwise(n(1)).alias("x0"), F.when(k == 2, n(500)).otherwise(n(20)).alias("x1"), n(1).alias("top"), n(2).alias("bottom"))
    pages = F.array(F.struct(n(100).alias("width"), n(100).alias("height"), F.array(word).alias("words")))
    return s.supplier.select("s_suppkey", F.array_join(extract.layout_errors(pages), "|").alias("errors"))


_KEPT_DAYS = (("s1", 1100, "TRUE"), ("s2", 900, "FALSE"))
_POLICIES = " UNION ALL ".join(f"SELECT '{t}' AS data_type, {d} AS retention_days, {a} AS auto_delete" for t, d, a in _KEPT_DAYS)
_OVER = f"(auto_delete AND CAST(created_on AS DATE) + retention_days < DATE '{AS_OF}')"


@query("sco_34", f"SELECT p.property_id, CASE WHEN {_OVER} THEN 'deleted' ELSE 'kept' END AS state, CASE WHEN {_OVER} THEN DATE '{AS_OF}' END AS deleted_on FROM properties p JOIN ({_POLICIES}) q ON q.data_type = p.submission_id")
def retention_enforced(s: Silver) -> DataFrame:
    """Records over the time of their kind go, with an audit row each; a policy without deletion lets none go."""
    policies = s.spark.createDataFrame([(t, d, a == "TRUE") for t, d, a in _KEPT_DAYS], "data_type string, retention_days int, auto_delete boolean")
    rows = s.properties.select("property_id", col("submission_id").alias("data_type"), "created_on")
    kept, audit = retention.enforce(rows, policies, "property_id", F.lit(AS_OF).cast("date"))
    state = lambda df, name, day: df.select("property_id", F.lit(name).alias("state"), day.alias("deleted_on"))
    return state(kept, "kept", F.lit(None).cast("date")).unionByName(state(audit, "deleted", col("deleted_on")))


@query("sco_34_export", "SELECT user_id, CAST(count(*) AS BIGINT) AS records, min(event_id) AS first_id, max(event_id) AS last_id FROM {events} WHERE event_id % 4 <> 0 GROUP BY 1")
def subject_export(s: Silver) -> DataFrame:
    """A document per subject of the records that there is a consent for; its ends are read back from it."""
    rows = s.events.select("user_id", "event_id", "event_type", (col("event_id") % 4 != 0).alias("consent"))
    made = retention.exported(rows, "user_id", "consent")
    ids = F.transform(F.from_json("document", "array<struct<event_id:long,event_type:string>>"), lambda r: r["event_id"])
    return made.select("user_id", "records", F.array_min(ids).alias("first_id"), F.array_max(ids).alias("last_id"))


# --- strings ---------------------------------------------------------------


@query("str_01", "SELECT n_nationkey, lower(replace(trim(n_name), ' ', '_')) AS name FROM {nation}")
def normal_names(s: Silver) -> DataFrame:
    """Names are normalised on the driver where they are columns; here the same rule runs over values."""
    rule = F.regexp_replace(F.regexp_replace(F.lower(F.trim("n_name")), r"[\s-]+", "_"), r"[^\w]", "")
    return s.nation.select("n_nationkey", rule.alias("name"))


@query("str_02", "SELECT CAST(property_id AS BIGINT) AS property_id, postcode, latitude FROM properties")
def standard_columns(s: Silver) -> DataFrame:
    df = s.properties.select(col("property_id").alias("Property ID"), col("postcode").alias("zip_code"), col("latitude").alias("Lat"))
    return df.withColumnsRenamed(readers.standard_names(df.columns))


@query("str_07", "SELECT property_id, address FROM properties WHERE address IS NOT NULL")
def assembled(s: Silver) -> DataFrame:
    parts = F.array(F.split_part("address", F.lit(","), F.lit(1)), F.lit(" "), F.coalesce("postcode", F.lit("")), F.split_part("address", F.lit(","), F.lit(2)))
    return s.properties.where(col("address").isNotNull()).select("property_id", address.assembled(parts).alias("address"))


@query("str_10", "SELECT property_id, address AS building FROM properties WHERE address IS NOT NULL")
def building_only(s: Silver) -> DataFrame:
    given = F.when(col("property_id") % 2 == 0, F.concat(F.lit("0/1, "), "address")).otherwise(F.concat(F.lit("Flat 3, "), "address"))
    found = F.coalesce(F.nullif(F.regexp_extract(given, r"^\d+/\d+\s*,\s*(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(given, rf"(?i)^{address.FLAT_WORDS}\s+\S+\s*,\s*(.+)$", 2), F.lit("")))
    return s.properties.where(col("address").isNotNull()).select("property_id", F.trim(found).alias("building"))


@query("str_11", "SELECT property_id, property_id % 4 <> 3 AS has_flat FROM properties WHERE address IS NOT NULL")
def flat_tokens(s: Silver) -> DataFrame:
    k = col("property_id") % 4
    given = F.when(k == 0, F.concat(F.lit("Flat 3, "), "address")).when(k == 1, F.concat(F.lit("0/2 "), "address")).when(k == 2, F.concat(F.lit("2F1, "), "address")).otherwise(col("address"))
    return s.properties.where(col("address").isNotNull()).select("property_id", address.has_flat_token(given).alias("has_flat"))


@query("str_13", "SELECT property_id, 'high street town' AS tokens FROM properties WHERE address IS NOT NULL")
def street_tokens(s: Silver) -> DataFrame:
    return s.properties.where(col("address").isNotNull()).select("property_id", F.array_join(address.street_tokens(F.concat(F.lit("Flat 2, "), "address")), " ").alias("tokens"))


@query("str_15", f"WITH RECURSIVE rows_ AS (SELECT s_suppkey, s_name AS a, concat('Supplier#', CAST(s_suppkey * 7 AS VARCHAR), ' Ltd') AS b FROM {{supplier}}), pairs AS (SELECT a, b FROM rows_), {RATIO_SQL} SELECT s_suppkey, round(ratio, 6) AS ratio FROM rows_ JOIN ratio USING (a, b)")
def sequence_ratio(s: Silver) -> DataFrame:
    rows = s.supplier.select("s_suppkey", "s_name", F.concat(F.lit("Supplier#"), (col("s_suppkey") * 7).cast("string"), F.lit(" Ltd")).alias("other"))
    return similar.with_ratio(rows, col("s_name"), col("other"), "ratio").select("s_suppkey", F.round("ratio", 6).alias("ratio"))


@query("str_17", "SELECT property_id, substr(property_reference, 1, 100) AS property_reference FROM properties")
def clamped(s: Silver) -> DataFrame:
    return s.properties.select("property_id", values.clamped(col("property_reference"), "property_reference").alias("property_reference"))


@query("str_20", "SELECT s_suppkey, concat('Aura Court ', CAST(s_suppkey AS VARCHAR)) AS name FROM {supplier}")
def camel_case(s: Silver) -> DataFrame:
    return s.supplier.select("s_suppkey", F.regexp_replace(F.concat(F.lit("AuraCourt "), col("s_suppkey").cast("string")), "([a-z])([A-Z])", "$1 $2").alias("name"))


@query("str_21", "SELECT c_custkey, concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) AS label FROM {customer}")
def title_case(s: Silver) -> DataFrame:
    return s.customer.select("c_custkey", F.initcap(F.replace("c_mktsegment", F.lit("_"), F.lit(" "))).alias("label"))


@query("str_22", "SELECT property_id, address AS shown FROM properties WHERE address IS NOT NULL")
def display_address(s: Silver) -> DataFrame:
    return s.properties.where(col("address").isNotNull()).select("property_id", F.trim(F.regexp_replace(F.concat(F.lit("Flat 3, "), "address"), r"(?i)^(flat|apartment|unit|apt)[^,]*,\s*", "")).alias("shown"))


@query("str_23", "SELECT property_id, CASE lower(wall_construction) WHEN 'timber or wood' THEN 'Timber' ELSE wall_construction END AS wall FROM properties")
def wall_names(s: Silver) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in WALLS.items() for x in pair))
    return s.properties.select("property_id", F.coalesce(F.try_element_at(names, F.lower("wall_construction")), "wall_construction").alias("wall"))


@query("str_29", "SELECT doc_id, length(text) <= 4000 AS whole FROM {documents}")
def truncated(s: Silver) -> DataFrame:
    cut = extract.sections(col("text"), {"actions": "the", "findings": "and"}, 4000)
    return s.documents.select("doc_id", (cut == col("text")).alias("whole"))


@query("str_30", "SELECT block_id, string_agg(property_reference, ' ' ORDER BY property_id) AS search FROM properties GROUP BY 1")
def search_text(s: Silver) -> DataFrame:
    refs = F.array_sort(F.collect_list(F.struct("property_id", "property_reference")))
    return s.properties.groupBy("block_id").agg(refs.alias("r")).select("block_id", F.array_join(F.transform("r", lambda x: x["property_reference"]), " ").alias("search"))


@query("ded_04", "SELECT property_id, 'High Street, Town' AS segments FROM properties WHERE address IS NOT NULL")
def segments(s: Silver) -> DataFrame:
    return s.properties.where(col("address").isNotNull()).select("property_id", address.distinct_segments(F.lit("High Street, Town, HIGH STREET,, town")).alias("segments"))


# --- dates, numbers, arrays ------------------------------------------------


@query("dat_02", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM {orders}")
def text_dates(s: Silver) -> DataFrame:
    text = F.concat(F.date_format("o_orderdate", "d"), F.lit("th "), F.date_format("o_orderdate", "MMMM yyyy"))
    return s.orders.select("o_orderkey", F.date_format(values.date(text), "yyyy-MM-dd").alias("iso"))


@query("dat_03", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM {orders}")
def normal_dates(s: Silver) -> DataFrame:
    text = F.when(col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    return s.orders.select("o_orderkey", values.date(text).alias("d"))


@query("dat_04", "SELECT 'date' AS detected_type, CAST(1.0 AS DOUBLE) AS confidence")
def date_detector(s: Silver) -> DataFrame:
    df = s.orders.select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("d"))
    return detect.scores(df).select(F.lit("date").alias("detected_type"), F.col("date").alias("confidence"))


@query("num_03", "SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 4 WHEN event_id % 4 = 2 THEN 3 ELSE 0 END AS INT) AS n FROM {events}")
def half_even(s: Silver) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("2.5", "3.5", "£3.2", "0.4"))), (col("event_id") % 4 + 1).cast("int"))
    return s.events.select("event_id", values.whole_number(text).alias("n"))


_YEARS = ("1987", "P2002H", "19TO44T", "c. 1850 rebuilt", "1650", "unknown")


@query("num_04", "SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN 1987 WHEN 1 THEN 2002 WHEN 2 THEN 1931 WHEN 3 THEN 1850 END AS INT) AS year FROM {events}")
def years(s: Silver) -> DataFrame:
    return s.events.select("event_id", values.year(F.element_at(F.array(*map(F.lit, _YEARS)), (col("event_id") % 6 + 1).cast("int"))).alias("year"))


@query("num_07", "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 END AS INT) AS storeys FROM {events}")
def storeys(s: Silver) -> DataFrame:
    return s.events.select("event_id", values.storeys(F.element_at(F.array(*map(F.lit, ("3 storeys", "5 incl. basement", "many"))), (col("event_id") % 3 + 1).cast("int"))).alias("storeys"))


@query("num_09", "SELECT block_id, CASE WHEN height_max_m < 11 THEN 'under_11m' WHEN height_max_m < 18 THEN '11_to_18m' WHEN height_max_m <= 30 THEN '18_to_30m' WHEN height_max_m > 30 THEN 'over_30m' END AS category FROM blocks")
def height_category(s: Silver) -> DataFrame:
    """30 m itself belongs to the third category, 18 m to it too."""
    h = col("height_max_m")
    return s.blocks.select("block_id", F.when(h <= 30, bands.banded(h, [(11, "under_11m"), (18, "11_to_18m"), (None, "18_to_30m")])).when(h > 30, "over_30m").alias("category"))


@query("arr_03", "SELECT block_id, CASE WHEN block_id % 4 = 0 THEN NULL ELSE block_id % 4 = 1 END AS combustible, CASE WHEN block_id % 4 = 0 THEN NULL ELSE TRUE END AS eps FROM blocks")
def wall_flags(s: Silver) -> DataFrame:
    """Flags over an array of wall types; an empty array leaves them unknown."""
    wall = lambda kind, burns: F.struct(F.lit(kind).alias("insulation"), burns.alias("combustible"))
    k = col("block_id") % 4
    walls = F.when(k == 0, F.array().cast("array<struct<insulation:string,combustible:boolean>>")).otherwise(F.array(wall("eps", F.when(k == 1, True).when(k == 2, False)), wall("pir", F.lit(None).cast("boolean"))))
    known = F.size("walls") > 0
    burns = F.exists("walls", lambda w: F.coalesce(w["combustible"], F.lit(False)))
    return s.blocks.select("block_id", walls.alias("walls")).select("block_id", F.when(known, burns).alias("combustible"), F.when(known, F.exists("walls", lambda w: w["insulation"] == "eps")).alias("eps"))


@query("arr_04", "SELECT s_suppkey, CAST(s_suppkey + 1 AS DOUBLE) AS x, CAST(2.0 AS DOUBLE) AS y FROM {supplier}")
def centroids(s: Silver) -> DataFrame:
    point = lambda x, y: F.struct((col("s_suppkey") + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    x, y = geo.centroid(F.array(point(0, 1), point(2, 1), point(2, 3), point(0, 3)))
    return s.supplier.select("s_suppkey", x.alias("x"), y.alias("y"))


@query("arr_05", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'high' WHEN event_id % 3 = 1 THEN 'low' ELSE 'low' END AS priority FROM {events}")
def sanitised(s: Silver) -> DataFrame:
    raw = F.array(F.struct(F.element_at(F.array(*map(F.lit, ("HIGH", "low", "whenever"))), (col("event_id") % 3 + 1).cast("int")).alias("p")))
    clean = F.transform(raw, lambda a: F.when(F.lower(a["p"]).isin("advisory", "low", "medium", "high"), F.lower(a["p"])).otherwise("low"))
    return s.events.select("event_id", F.get(clean, F.lit(0)).alias("priority"))


@query("map_01", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM {events}")
def dotted_path(s: Silver) -> DataFrame:
    nested = F.parse_json(F.concat(F.lit('{"a": {"b": '), "props", F.lit("}}")))
    return s.events.select("event_id", F.try_variant_get(nested, "$.a.b.k", "string").alias("v"))


@query("jsn_02", "SELECT block_id, name FROM blocks")
def json_objects(s: Silver) -> DataFrame:
    return s.blocks.select(F.to_json(F.struct("block_id", "name")).alias("j")).select(F.get_json_object("j", "$.block_id").cast("long").alias("block_id"), F.get_json_object("j", "$.name").alias("name"))


# --- joins by text and by greedy assignment --------------------------------


@query("join_16", r"""WITH q AS (SELECT property_id, ha_id, block_reference, trim(regexp_replace(regexp_replace(upper(CASE WHEN property_id % 4 = 0 THEN replace(address, ', Town', '') WHEN property_id % 4 = 1 THEN concat('Flat 1, ', address) ELSE address END), '[^A-Z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS a FROM properties WHERE address IS NOT NULL)
 SELECT p.property_id, min(b.block_reference) AS attached FROM (SELECT * FROM q WHERE block_reference IS NULL) p JOIN (SELECT DISTINCT ha_id, block_reference, a FROM q WHERE block_reference IS NOT NULL) b ON b.ha_id = p.ha_id AND (contains(b.a, p.a) OR contains(p.a, b.a)) GROUP BY 1""")
def substring_attach(s: Silver) -> DataFrame:
    """Standalone rows whose address lies in a block member's or holds one, the first block wins; a quarter of the addresses is shorter, a quarter longer.

    Both directions meet by the contained address's rarest piece, and containment is then checked.
    """
    nth = col("property_id") % 4
    given = F.when(nth == 0, F.replace(col("address"), F.lit(", Town"), F.lit(""))).when(nth == 1, F.concat(F.lit("Flat 1, "), "address")).otherwise(col("address"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(given), r"[^A-Z0-9_\s]", " "), r"\s+", " "))
    rows = s.properties.where(col("address").isNotNull()).select("property_id", "ha_id", "block_reference", plain.alias("a"))
    return lookup.attached(rows)


@query("join_24")
def greedy_assignment(s: Silver) -> DataFrame:
    """Points to shapes one to one, the first point first; rows only, as SQL has no such pass. Candidates meet by grid cell."""
    shapes = s.centroids.select(col("postcode").alias("shape"), "easting", "northing")
    return spatial.greedy_within(s.uprn_points.select(col("uprn").alias("point"), "easting", "northing"), shapes, 45)


@query("agg_overdue_by_block", "SELECT block_id, coalesce(overdue_action_count, 0) AS overdue FROM (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY block_id ORDER BY assessment_date DESC NULLS LAST, created_seq DESC, fra_id DESC) AS rn FROM fra_features f) x WHERE rn = 1) y")
def overdue(s: Silver) -> DataFrame:
    return assessed_blocks(s).where(col("overdue_action_count").isNotNull()).select("block_id", F.coalesce("overdue_action_count", F.lit(0)).alias("overdue"))


