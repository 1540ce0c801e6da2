"""Scans, samples, single detectors, quote search, arrivals: the inventory's smaller entries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.functions import values
from groundplan.operators import detect, documents, graph, ingest, similar
from groundplan.plans import gold  # noqa: F401  (registers what an alias below names)
from groundplan.plans.io import schedule_rows, scratch
from groundplan.plans.registry import ORACLES, QUERIES, RATIO_SQL, query
from groundplan.plans.silver import Silver
from groundplan.sources import readers, workbook
from groundplan.sources.snapshots import SnapshotTable
from groundplan.streaming import arrivals, enrichment

col = F.col


@query("src_03", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 100")
def sample_scan(s: Silver) -> DataFrame:
    return s.orders.orderBy("o_orderkey").limit(100).select("o_orderkey")


@query("src_04", "SELECT CAST(n_nationkey AS VARCHAR) AS k, concat('say \"', n_name, '\", twice') AS v FROM {nation}")
def quoted_cells(s: Silver) -> DataFrame:
    path = f"{scratch(s, 'quotes')}.csv"
    s.nation.select(col("n_nationkey").alias("k"), F.concat(F.lit('say "'), "n_name", F.lit('", twice')).alias("v")).write.csv(path, header=True, quote='"', escape='"')
    return readers.delimited(s.spark, path).select("k", "v")


@query("src_08", r"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''), 1) AS k FROM {conversations} WHERE turn < 10)
 SELECT conv_id AS doc_id, count(DISTINCT turn) AS pages, count(*) AS words, CAST(max(x1) AS DOUBLE) AS widest, string_agg(w, ' ' ORDER BY turn, k) AS text FROM (SELECT w.*, sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS x1 FROM w) y GROUP BY 1""")
def layout_schema(s: Silver) -> DataFrame:
    """Pages of at most ten turns, of words with boxes: a character is a unit wide, a page one line."""
    pages = s.conversations.where("turn < 10").select(col("conv_id").alias("doc_id"), col("turn").alias("page_no"), "text")
    words = documents.layout(pages).select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_no", F.explode("p.words").alias("w"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", col("w.x0").alias("x"), col("w.text").alias("t")))), lambda r: r["t"]), " ")
    return words.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"), F.count("*").alias("words"), F.max("w.x1").alias("widest"), text.alias("text"))


@query("src_06", "SELECT conv_id AS doc_id, string_agg(concat('[Page ', CAST(turn + 1 AS VARCHAR), ']', chr(10), text, chr(10), role, ' | ', CAST(length(text) AS VARCHAR)), chr(10) || chr(10) ORDER BY turn) AS text FROM {conversations} GROUP BY 1")
def page_marked_text(s: Silver) -> DataFrame:
    """A document's pages with their marks; the tables on a page as rows of cells behind its text."""
    table = F.array(F.array(col("role"), F.length("text").cast("string")))
    pages = s.conversations.select(col("conv_id").alias("doc_id"), (col("turn") + 1).alias("page_no"), "text", table.alias("table"))
    return documents.marked_text(pages)


@query("src_02", "SELECT portfolio_id AS path, 'Blocks' AS sheet, block_id + 1 AS row, name, CAST(unit_count AS VARCHAR) AS second FROM blocks UNION ALL SELECT portfolio_id, 'Totals', 1, 'units', CAST(sum(unit_count) AS VARCHAR) FROM blocks GROUP BY 1")
def workbook_sheets(s: Silver) -> DataFrame:
    """A workbook of two sheets per portfolio, made and read again in tasks; blank rows and those of other cells do not come back."""
    rows = workbook.rows_of(workbooks_of_blocks(s))
    return rows.select("path", "sheet", (col("row_idx") + 1).cast("long").alias("row"), F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).alias("second"))


@query("src_05", "SELECT portfolio_id AS path, count(*) AS rows, CAST(sum(unit_count) AS BIGINT) AS units FROM blocks GROUP BY 1")
def first_sheet(s: Silver) -> DataFrame:
    rows = workbook.rows_of(workbooks_of_blocks(s), first_sheet_only=True)
    return rows.groupBy("path").agg(F.count("*").alias("rows"), F.sum(F.get("cells", F.lit(1)).cast("long")).alias("units"))


def workbooks_of_blocks(s: Silver) -> DataFrame:
    cell = lambda *c: F.array(*(x.cast("string") for x in c))
    blocks = s.blocks.select(col("portfolio_id").alias("path"), F.lit("Blocks").alias("sheet"), F.lit(0).alias("sheet_idx"), col("block_id").cast("int").alias("row_idx"), cell(col("name"), col("unit_count")).alias("cells"))
    totals = s.blocks.groupBy(col("portfolio_id").alias("path")).agg(F.sum("unit_count").alias("n")).select("path", F.lit("Totals").alias("sheet"), F.lit(1).alias("sheet_idx"), F.lit(0).alias("row_idx"), cell(F.lit("units"), col("n")).alias("cells"))
    blank = totals.withColumn("row_idx", F.lit(1)).withColumn("cells", F.array(F.lit(""), F.lit(None).cast("string")))
    return workbook.made(blocks.unionByName(totals).unionByName(blank))


@query("src_13", "SELECT p_partkey, p_brand FROM {part} WHERE p_size > 25")
def table_scan(s: Silver) -> DataFrame:
    """Columns and predicate reach the Parquet scan."""
    return s.part.where("p_size > 25").select("p_partkey", "p_brand")


#: Views and endpoints whose rows are those of a query that has another name above.
SAME_AS = {
    "gold_risk_distribution_v1": "agg_24", "gold_extraction_comparison_v1": "flt_17", "gold_portfolio_composition_v1": "agg_29", "gold_underwriter_summary_v1": "agg_28",
    "gold_fra_compliance_v1": "agg_31", "gold_fraew_compliance_v1": "agg_32", "gold_missing_information_v1": "agg_42", "endpoint_map": "gold_portfolio_map_v1", "endpoint_ha_profile": "agg_40",
}


def name_views() -> None:
    """Registers the names of SAME_AS, once all plans are loaded."""
    for name, other in SAME_AS.items():
        QUERIES[name], ORACLES[name] = QUERIES[other], ORACLES[other]


@query("snk_09", "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'extraction.json' ELSE 'features.json' END AS filename, CAST(event_id % 2 AS BIGINT) AS version FROM {events}")
def json_artefacts(s: Silver) -> DataFrame:
    """Artefacts written in two rounds; each round appends the objects that it wrote to the manifest, whose rows name what there is."""
    path = scratch(s, "artefacts")
    manifest = SnapshotTable(s.spark, f"{path}/manifest", "event_id long, role string, filename string, place string, version long")
    for n, role in enumerate(("extraction", "features")):
        rows = s.events.where(col("event_id") % 2 == n)
        rows.select("event_id", F.struct("event_type").alias("meta")).write.json(f"{path}/{role}")
        manifest.append(rows.select("event_id", F.lit(role).alias("role"), F.lit(f"{role}.json").alias("filename"), F.lit(f"{path}/{role}").alias("place"), F.lit(n).alias("version")), "worker", [n])
    places = [r.place for r in manifest.read().select("place").distinct().collect()]
    found = s.spark.read.schema("event_id long, meta struct<event_type:string>").json(places)
    return manifest.read().join(found, "event_id").select("event_id", "meta.event_type", "filename", "version")


@query("join_22", "WITH RECURSIVE sides AS (SELECT source_id AS a, target_id AS z FROM lineage UNION SELECT target_id, source_id FROM lineage), reach(node, depth) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT sides.z, r.depth + 1 FROM reach r JOIN sides ON sides.a = r.node WHERE r.depth < 2), near AS (SELECT DISTINCT node FROM reach) SELECT DISTINCT source_id, target_id FROM lineage WHERE source_id IN (SELECT node FROM near) OR target_id IN (SELECT node FROM near)")
def near_lineage(s: Silver) -> DataFrame:
    return graph.closure(s.lineage.select("source_id", "target_id"), 7, 3).select("source_id", "target_id")


@query("str_03", "SELECT CAST(property_id AS BIGINT) AS property_reference, epc_rating, build_year FROM properties")
def header_aliases(s: Silver) -> DataFrame:
    df = s.properties.select(col("property_id").alias("property-ref"), col("epc_rating").alias("EPC"), col("build_year").alias("Year Built"))
    return df.withColumnsRenamed(readers.standard_names(df.columns))


_OTHER = "CASE property_id % 3 WHEN 0 THEN concat(upper(address), ', AB1 2CD') WHEN 1 THEN replace(address, 'High Street', 'Hgh Stret') ELSE concat('Town, ', CAST(property_id % 7 AS VARCHAR(20)), ' Low Road') END"
_SEGMENTS = r"list_filter(list_transform(string_split(lower({0}), ','), lambda p: trim(regexp_replace(p, '[^a-z0-9_\s]', ' ', 'g'))), lambda p: p <> '')"


@query("str_16", f"""WITH RECURSIVE rows_ AS (SELECT property_id, address AS x, {_OTHER} AS y FROM properties WHERE address IS NOT NULL), both_ AS (SELECT DISTINCT x, y FROM rows_),
 e AS (SELECT x, y, len(l) AS n, i, l[i] AS a, unnest(r) AS b FROM (SELECT x, y, l, r, unnest(range(1, len(l) + 1)) AS i FROM (SELECT x, y, {_SEGMENTS.format('x')} AS l, {_SEGMENTS.format('y')} AS r FROM both_) s) t),
 pairs AS (SELECT a, b FROM e), {RATIO_SQL}, m AS (SELECT x, y, n, i, max(ratio) AS best FROM e JOIN ratio USING (a, b) GROUP BY 1, 2, 3, 4), z AS (SELECT x, y, count(CASE WHEN best >= 0.85 THEN 1 END) * 1.0 / max(n) AS share FROM m GROUP BY 1, 2)
 SELECT property_id, share FROM rows_ JOIN z USING (x, y)""")
def segment_share(s: Silver) -> DataFrame:
    """Addresses in other letters, with mistakes, or of another street."""
    rows = s.properties.where(col("address").isNotNull()).select("property_id", "address", F.expr(_OTHER).alias("other"))
    return similar.with_segment_share(rows, col("address"), col("other"), "share").select("property_id", "share")


_QUOTE = "CASE WHEN item_id % 2 = 0 THEN substr(text, 20, 40) ELSE concat(substr(text, 20, 9), '#', substr(text, 30, 14), '#', substr(text, 45, 15)) END"
_NORMAL = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


@query("str_26", f"""WITH RECURSIVE n AS (SELECT item_id, {_NORMAL.format('text')} AS p, {_NORMAL.format(_QUOTE)} AS q FROM {{benchmark}}), f AS (SELECT * FROM n WHERE strpos(p, q) = 0 AND length(q) >= 12),
 w AS (SELECT item_id, q AS b, s, substr(p, CAST(s AS INT) + 1, length(q)) AS a FROM (SELECT f.*, unnest(range(0, greatest(1, length(p) - length(q) + 1), greatest(1, length(q) // 4))) AS s FROM f) x),
 pairs AS (SELECT a, b FROM w), {RATIO_SQL}, best AS (SELECT item_id, s FROM (SELECT item_id, s, row_number() OVER (PARTITION BY item_id ORDER BY ratio DESC, s) AS rn FROM w JOIN ratio USING (a, b) WHERE ratio >= 0.85) y WHERE rn = 1)
 SELECT n.item_id, CAST(CASE WHEN strpos(p, q) > 0 THEN strpos(p, q) - 1 ELSE coalesce(s, -1) END AS INT) AS place FROM n LEFT JOIN best ON best.item_id = n.item_id""")
def quote_places(s: Silver) -> DataFrame:
    """The exact place of a quote, else that of the most similar window; half of the quotes have mistakes."""
    rows = s.benchmark.select("item_id", documents.normal(col("text")).alias("p"), documents.normal(F.expr(_QUOTE)).alias("q"))
    exact = F.instr(col("p"), col("q")) - 1
    found = similar.quote_places(rows.where(exact < 0))
    return rows.join(found, ["q", "p"], "left").select("item_id", F.when(exact >= 0, exact).otherwise(F.coalesce("place", F.lit(-1))).alias("place"))


@query("str_27", r"""WITH n AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM {benchmark}),
 h AS (SELECT item_id, p, substr(p, 1, 25) AS b, substr(p, 36) AS a FROM n),
 e AS (SELECT item_id, p, greatest(CASE WHEN strpos(reverse(b), ' .') > 0 THEN length(b) - strpos(reverse(b), ' .') + 1 END, CASE WHEN strpos(reverse(b), ' |') > 0 THEN length(b) - strpos(reverse(b), ' |') + 1 END, CASE WHEN strpos(reverse(b), ' •') > 0 THEN length(b) - strpos(reverse(b), ' •') + 1 END) AS l,
  least(CASE WHEN strpos(a, '. ') > 0 THEN 35 + strpos(a, '. ') END, CASE WHEN strpos(a, ' |') > 0 THEN 35 + strpos(a, ' |') END) AS r FROM h),
 s AS (SELECT item_id, trim(substr(p, coalesce(l + 1, 1), coalesce(r, 235) - coalesce(l, 0))) AS x FROM e)
 SELECT item_id, CASE WHEN length(x) <= 320 THEN x ELSE concat(substr(x, 1, 317), '...') END AS sentence FROM s""")
def sentences(s: Silver) -> DataFrame:
    return s.benchmark.select("item_id", documents.sentence(documents.normal(col("text")), F.lit(25), F.lit(10)).alias("sentence"))


@query("num_05", r"""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 2000 + event_id % 30 + 1 WHEN 1 THEN 2000 + event_id % 30 WHEN 2 THEN 2000 + event_id % 30 + 1 WHEN 3 THEN 0 ELSE 2010 + event_id % 10 END AS INT) AS year FROM {events}""")
def insured_years(s: Silver) -> DataFrame:
    """Years of headings: ranges take the later year, headings without a year 0."""
    y = (col("event_id") % 30).cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    heads = (F.concat(F.lit("Sum Insured "), two(y), F.lit("/"), two(y + 1)), F.concat(F.lit("Reinstatement "), (y + 2000).cast("string")), F.concat((y + 2000).cast("string"), F.lit("-"), two(y + 1), F.lit(" declared value")), F.lit("Postcode"), F.concat(F.lit("SI 201"), (col("event_id") % 10).cast("string")))
    return s.events.select("event_id", values.insured_year_of(F.get(F.array(*heads), (col("event_id") % 5).cast("int"))).alias("year"))


@query("arr_06", "SELECT fra_id, concat_ws('|', CASE WHEN rag_status = 'RED' THEN 'red' END, CASE WHEN overdue_action_count > 0 THEN concat(CAST(overdue_action_count AS VARCHAR), ' overdue') END) AS notes FROM fra_features")
def conditional_notes(s: Silver) -> DataFrame:
    notes = F.array_compact(F.array(F.when(col("rag_status") == "RED", "red"), F.when(col("overdue_action_count") > 0, F.concat(col("overdue_action_count").cast("string"), F.lit(" overdue")))))
    return s.fra_features.select("fra_id", F.array_join(notes, "|").alias("notes"))


@query("jsn_04", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM {events}")
def serialised(s: Silver) -> DataFrame:
    """Dates and nested values become JSON by ``to_json`` alone."""
    return s.events.select("event_id", F.to_json(F.struct(F.struct(col("ts").cast("date").alias("day")).alias("a"))).alias("j")).select("event_id", F.get_json_object("j", "$.a.day").alias("day"))


# --- single detectors: (ID, detector, column as text, SQL share) -----------

_DETECTORS = (
    ("typ_01", "postcode", "postcode", "regexp_matches(upper(v), '^[A-Z]{{1,2}}[0-9][A-Z0-9]?\\s*[0-9][A-Z]{{2}}$')"),
    ("typ_03", "date", "cast(created_on as string)", "TRUE"),
    ("typ_04", "address", "address", "regexp_matches(lower(v), '\\b(street|road)\\b') AND regexp_matches(v, '[0-9]')"),
    ("typ_05", "numeric_id", "cast(property_id as string)", "TRY_CAST(v AS DOUBLE) IS NOT NULL"),
    ("typ_07", "boolean", "case property_id % 3 when 0 then 'Yes' when 1 then 'n' else 'maybe' end", "lower(v) IN ('yes', 'no', 'true', 'false', '1', '0', 'y', 'n', 't', 'f')"),
    ("typ_08", "year", "cast(build_year as string)", "TRY_CAST(v AS DOUBLE) BETWEEN 1900 AND 2100"),
    ("typ_09", "latitude", "cast(latitude as string)", "TRY_CAST(v AS DOUBLE) BETWEEN 49 AND 61"),
    ("typ_10", "region", "case property_id % 2 when 0 then 'Scotland' else 'Mars' end", "lower(v) = 'scotland'"),
    ("typ_11", "house_type", "case property_id % 4 when 0 then 'Villa' else 'bungalow' end", "lower(v) IN ('villa', 'bungalow')"),
    ("typ_12", "epc_rating", "epc_rating", "lower(v) IN ('a', 'b', 'c', 'd', 'e', 'f', 'g')"),
)


def _detector(kind: str, text: str):
    def build(s: Silver) -> DataFrame:
        return detect.scores(s.properties.select(F.expr(text).alias("v")), thresholds=False).select(F.round(kind, 6).alias("share"))

    return build


for _id, _kind, _text, _match in _DETECTORS:
    _sql = _text.replace("as string", "AS VARCHAR")
    query(_id, f"SELECT round(count(CASE WHEN {_match} THEN 1 END) * 1.0 / count(v), 6) AS share FROM (SELECT {_sql} AS v FROM properties) x")(_detector(_kind, _text))


@query("typ_06", "SELECT round(1 - count(DISTINCT property_type) * 1.0 / count(property_type), 6) AS share FROM properties")
def categorical(s: Silver) -> DataFrame:
    return detect.scores(s.properties.select("property_type"), thresholds=False).select(F.round("categorical", 6).alias("share"))


def two_sheets(s: Silver) -> DataFrame:
    """A stock list without insured sums, and the sums in another sheet, of every third property under a longer key."""
    head = [("b", "Stock", 0, 0, ["Stock list"]), ("b", "Stock", 0, 2, ["Property Ref", "Address 1", "Post code"]), ("b", "Values ", 1, 0, ["Asset reference", "Sum Insured 24/25", "Declared value 25/26", "Storeys"])]
    head = s.spark.createDataFrame(head, "path string, sheet string, sheet_idx int, row_idx int, cells array<string>")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    place = (col("property_id") + 10).cast("int").alias("row_idx")
    stock = s.properties.select(F.lit("b").alias("path"), F.lit("Stock").alias("sheet"), F.lit(0).alias("sheet_idx"), place, F.array(F.concat("property_reference", F.lit("#")), text(col("address")), text(col("postcode"))).alias("cells"))
    key = F.concat("property_reference", F.when(col("property_id") % 3 == 0, "#/1").otherwise("#"))
    sums = s.properties.select(F.lit("b").alias("path"), F.lit("Values ").alias("sheet"), F.lit(1).alias("sheet_idx"), place, F.array(key, F.lit("1"), F.concat(F.lit("£"), text(col("sum_insured"))), F.lit("4")).alias("cells"))
    return head.unionByName(stock).unionByName(sums)


@query("typ_18", "SELECT concat(property_reference, '#') AS property_reference, CAST(sum_insured AS DOUBLE) AS sum_insured, CAST(4 AS INT) AS storeys, 'primary,secondary' AS roles FROM properties")
def sheet_roles(s: Silver) -> DataFrame:
    """Roles and the join plan follow from the headers; the plan is carried out over all rows."""
    rows = two_sheets(s)
    plans = ingest.plan(rows)
    joined = ingest.joined(rows, plans[0], ingest.join_plan(plans), plans[1])
    return joined.select("property_reference", "sum_insured", "storeys", F.lit(",".join(map(ingest.role, plans))).alias("roles"))


@query("typ_19", "SELECT concat(property_reference, '#') AS property_reference, postcode, CAST(sum_insured AS DOUBLE) AS sum_insured, CAST(NULL AS INT) AS storeys FROM properties")
def plan_validation(s: Silver) -> DataFrame:
    """Plans from outside with unknown sheets, unknown fields and impossible columns, cleaned and carried out."""
    rows = two_sheets(s)
    raw = [{"sheet": " Stock ", "header_row": 2.0, "columns": {"property_reference": 0, "postcode": 2, "address": -1, "nonsense": 3}}, {"sheet": "Values", "columns": {"property_reference": 0, "sum_insured": 2}}, {"sheet": "unknown", "columns": {}}]
    plans = ingest.validated(raw, {"Stock", "Values "})
    join = ingest.validated_join({"primary_key": 0, "sheet": "Values ", "key": 0, "fields": [{"name": "sum_insured"}, "nonsense"]}, {"Stock", "Values "})
    return ingest.joined(rows, plans[0], join, plans[1]).select("property_reference", "postcode", "sum_insured", "storeys")


# --- arrivals --------------------------------------------------------------


@query("stm_01", "SELECT 'fra' AS dataset, CAST(2 AS BIGINT) AS files UNION ALL SELECT 'sov', CAST(1 AS BIGINT)")
def routed_arrivals(s: Silver) -> DataFrame:
    """Objects under tenant keys arrive as a stream, counted by data set."""
    base = scratch(s, "landing")
    for ha, dataset, submission in (("h1", "fra", "s1"), ("h2", "fra", "s2"), ("h1", "sov", "s3")):
        s.region.select("r_name").coalesce(1).write.text(f"{base}/ha_id={ha}/bronze/dataset={dataset}/ingest_date=2024-01-01/submission_id={submission}")
    found = arrivals.drained(arrivals.arrivals(s.spark, base), f"arrivals_{uuid.uuid4().hex}", scratch(s, "stream"))
    return found.groupBy("dataset").agg(F.count("*").alias("files"))


@query("stm_04", r"""WITH k AS (SELECT upper(replace(postcode, ' ', '')) AS pc, trim(regexp_replace(lower(address), '[,\s]+', ' ', 'g')) AS ad, min(uprn) AS uprn FROM properties WHERE uprn IS NOT NULL AND property_id % 3 <> 0 GROUP BY 1, 2)
 SELECT p.property_id, k.uprn, CASE WHEN k.uprn IS NULL THEN 'failed' ELSE 'enriched' END AS enrichment_status FROM properties p LEFT JOIN k ON k.pc = upper(replace(p.postcode, ' ', '')) AND k.ad = trim(regexp_replace(lower(p.address), '[,\s]+', ' ', 'g'))""")
def background_enrichment(s: Silver) -> DataFrame:
    """Properties that arrive as a stream get the reference number of their address, in commits of bounded size."""
    landed = scratch(s, "landed")
    s.properties.select("property_id", "postcode", "address").write.parquet(landed)
    stream = s.spark.readStream.schema("property_id long, postcode string, address string").option("maxFilesPerTrigger", 4).parquet(landed)
    table = SnapshotTable(s.spark, scratch(s, "enriched"), "property_id long, postcode string, address string, " + enrichment.ADDED)
    known = enrichment.references(s.properties.where("property_id % 3 <> 0"))
    enrichment.enrich(stream, known, table, "property_id", scratch(s, "stream"), 20_000).awaitTermination()
    return table.read().select("property_id", "uprn", "enrichment_status")


@query("stm_05", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM {events} GROUP BY 1")
def kept_by_deltas(s: Silver) -> DataFrame:
    """Instead of a row trigger, each batch adds its own counts and maxima by key."""
    table = SnapshotTable(s.spark, scratch(s, "deltas"), "user_id long, n long, last long")
    stream = arrivals.events(s.spark, s.sf_dir, "events.parquet").select("user_id", "event_id")
    arrivals.maintained(stream, ["user_id"], {"n": F.lit(1)}, {"last": col("event_id")}, table, "stm_05", scratch(s, "stream")).awaitTermination()
    return arrivals.totals(table.read(), ["user_id"], ["n"], ["last"])
