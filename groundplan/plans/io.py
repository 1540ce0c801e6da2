"""Queries over sources, sinks, ingestion, documents and streams, fed from the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.operators import documents, ingest
from groundplan.operators import relational as ops
from groundplan.operators.lineage_cut import shared_folder
from groundplan.plans.registry import query
from groundplan.plans.silver import Silver
from groundplan.sources import exports, readers
from groundplan.sources.snapshots import SnapshotTable
from groundplan.streaming import arrivals, retries

col = F.col
#: Columns of the first schedule that the tables hold.
_HELD = ("property_reference", "block_reference", "address", "postcode", "units", "sum_insured", "property_type", "uprn", "epc_rating", "enrichment_status", "wall_construction", "roof_construction", "storeys")


def scratch(s: Silver, label: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{shared_folder(s.spark)}/{label}-{uuid.uuid4().hex}"


# --- sources ---------------------------------------------------------------


@query("src_01", "SELECT CAST(o_orderkey AS VARCHAR) AS property_reference, o_orderpriority AS postcode FROM {orders}")
def csv_upload(s: Silver) -> DataFrame:
    """Written as CSV with other headers and read back by the upload reader."""
    path = f"{scratch(s, 'upload')}.csv"
    s.orders.select(col("o_orderkey").alias("Property-Ref"), col("o_orderpriority").alias("ZIP code")).write.csv(path, header=True)
    return readers.delimited(s.spark, path).select("property_reference", "postcode")


@query("src_07", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS sample FROM {conversations} WHERE turn < 3 GROUP BY 1")
def text_sample(s: Silver) -> DataFrame:
    """The first pages of each document joined; turns stand for pages."""
    first = s.conversations.where("turn < 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return first.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("sample"))


@query("src_09", "SELECT doc_id, length(trim(text)) < 30 AS scanned FROM {documents}")
def scanned(s: Silver) -> DataFrame:
    return s.documents.select("doc_id", documents.scanned(col("text")).alias("scanned"))


@query("src_10", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events}")
def json_features(s: Silver) -> DataFrame:
    return s.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("src_11", "SELECT event_id, CAST(user_id AS VARCHAR) AS ha_id, event_type AS dataset FROM {events}")
def object_keys(s: Silver) -> DataFrame:
    key = F.format_string("s3://b/ha_id=%s/bronze/dataset=%s/ingest_date=2024-01-01/submission_id=%s/file.pdf", col("user_id").cast("string"), "event_type", col("event_id").cast("string"))
    parts = readers.key_parts(key)
    return s.events.select("event_id", parts["ha_id"].alias("ha_id"), parts["dataset"].alias("dataset"))


@query("src_12", "SELECT concat('AB', CAST(s_suppkey AS VARCHAR)) AS postcode, CASE WHEN s_suppkey % 4 = 0 THEN 'High' WHEN s_suppkey % 3 = 0 THEN 'Medium' WHEN s_suppkey % 2 = 0 THEN 'Low' ELSE 'Very Low' END AS band FROM {supplier}")
def flood_dimension(s: Silver) -> DataFrame:
    path = scratch(s, "flood")
    count = lambda m: (col("s_suppkey") % m == 0).cast("int")
    s.supplier.select(F.concat(F.lit("ab "), col("s_suppkey").cast("string")).alias("Postcode"), count(4).alias("HIGH_CNT"), count(3).alias("MED_CNT"), count(2).alias("LOW_CNT")).write.csv(path, header=True)
    return readers.flood_dimension(s.spark, path)


@query("src_14", "SELECT p.property_id, s.s_acctbal AS reading FROM properties p LEFT JOIN {supplier} s ON s.s_suppkey = p.property_id % 1000")
def lookup(s: Silver) -> DataFrame:
    """A fetched lookup is a table; each lookup is a left join on distinct keys."""
    readings = s.supplier.select(col("s_suppkey").alias("k"), col("s_acctbal").alias("reading"))
    return s.properties.select("property_id").join(readings, col("property_id") % 1000 == col("k"), "left").select("property_id", "reading")


@query("src_15", "SELECT portfolio_id, CAST(i AS BIGINT) AS id, CASE WHEN (i + portfolio_no) % 3 = 0 THEN 'RED' ELSE 'GREEN' END AS status, CAST(i % 30 + 1 AS INT) AS units FROM portfolios, range(1, 145) t(i)")
def seeded(s: Silver) -> DataFrame:
    """A numbered series of rows for each portfolio, with columns that follow from both numbers."""
    rows = s.portfolios.select("portfolio_id", "portfolio_no", F.explode(F.sequence(F.lit(1), F.lit(144))).alias("id"))
    made = readers.seeded(rows.withColumn("id", col("id").cast("long")), {"status": F.when((col("id") + col("portfolio_no")) % 3 == 0, "RED").otherwise("GREEN"), "units": (col("id") % 30 + 1).cast("int")})
    return made.select("portfolio_id", "id", "status", "units")


@query("src_16", """SELECT id, CASE WHEN d(id, 1, 2) = 0 THEN 'flat' ELSE 'house' END AS type, d(id, 2, 10001) / 100.0 AS score, lpad(CAST(id AS VARCHAR), 12, '0') AS uprn FROM (SELECT o_orderkey AS id FROM {orders}) x""".replace("d(id, 1, 2)", readers.DRAW_SQL.format("id", 1, 2)).replace("d(id, 2, 10001)", readers.DRAW_SQL.format("id", 2, 10001)))
def synthetic(s: Silver) -> DataFrame:
    """Generated columns over given ids: draws follow from the id and a seed, so that every task and engine makes the same row."""
    columns = {"type": readers.choice(("flat", "house"), 1), "score": readers.draw(2, 10001) / 100, "uprn": F.format_string("%012d", col("id"))}
    return readers.seeded(s.orders.select(col("o_orderkey").alias("id")), columns)


# --- sinks -----------------------------------------------------------------


@query("snk_03", "SELECT block_id, CASE WHEN block_id % 3 = 0 THEN 99 ELSE unit_count END AS unit_count FROM blocks")
def upsert_blocks(s: Silver) -> DataFrame:
    old = s.blocks.select("block_id", "unit_count")
    return ops.upsert(old, old.where("block_id % 3 = 0").withColumn("unit_count", F.lit(99)), ["block_id"])


@query("snk_04", "SELECT property_id, CASE WHEN property_id % 2 = 0 THEN coalesce(CASE WHEN property_id % 4 = 0 THEN 'new' END, uprn) ELSE uprn END AS uprn FROM properties")
def upsert_lineage(s: Silver) -> DataFrame:
    """The new value where there is one, else the old one stays."""
    old = s.properties.select("property_id", "uprn")
    new = old.where("property_id % 2 = 0").withColumn("uprn", F.when(col("property_id") % 4 == 0, "new"))
    return ops.upsert(old, new, ["property_id"], {"uprn": F.coalesce("new.uprn", "old.uprn")})


@query("snk_06", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE concat('done by ', CAST(user_id AS VARCHAR)) END AS status, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS added, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 3 END AS INT) AS entries FROM (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS value FROM {events}) e")
def metadata_patch(s: Silver) -> DataFrame:
    """Two of three rows get a patch that replaces one entry and adds another."""
    old = F.create_map(F.lit("status"), F.lit("new"), F.lit("kind"), "event_type")
    patch = F.create_map(F.lit("status"), F.concat(F.lit("done by "), col("user_id").cast("string")), F.lit("added"), F.floor("value").cast("string"))
    patched = F.when(col("event_id") % 3 == 0, old).otherwise(exports.patched(old, patch))
    return s.events.select("event_id", patched.alias("m")).select("event_id", *(col("m")[k].alias(k) for k in ("status", "kind", "added")), F.size("m").alias("entries"))


@query("snk_07", "SELECT " + ", ".join(f'CAST({c} AS VARCHAR) AS "{h}"' if c in _HELD else f'CAST(NULL AS VARCHAR) AS "{h}"' for h, c in exports.SCHEDULE_A) + " FROM properties")
def schedule_export(s: Silver) -> DataFrame:
    """Written with all headings and read again, cell by cell."""
    path = scratch(s, "schedule")
    exports.write_schedule(exports.schedule(s.properties), path, [col("Property Reference")])
    return s.spark.read.csv(path, header=True, nullValue="", emptyValue="", escape='"')


@query("snk_10", "SELECT property_id, CAST(longitude AS DOUBLE) AS lon, CAST(latitude AS DOUBLE) AS lat FROM properties WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def geojson(s: Silver) -> DataFrame:
    made = exports.features(s.properties, "latitude", "longitude", ["property_id"])
    part = lambda p, t: F.get_json_object("feature", p).cast(t)
    return made.select(part("$.properties.property_id", "long").alias("property_id"), part("$.geometry.coordinates[0]", "double").alias("lon"), part("$.geometry.coordinates[1]", "double").alias("lat"))


# --- ingestion and documents -----------------------------------------------


@query("flt_13", "SELECT event_id FROM {events} WHERE event_id % 5 NOT IN (1, 2, 3)")
def row_filters(s: Silver) -> DataFrame:
    kinds = F.array(F.array(F.lit("ref"), F.lit("addr")), F.array(F.lit(" "), F.lit(None)), F.array(F.lit("Grand Total"), F.lit("9")), F.array(F.lit("Filter: all"), F.lit("x")), F.array(F.lit("total floor area of the whole of the building"), F.lit("y")))
    return s.events.where(ingest.keep_row(F.get(kinds, (col("event_id") % 5).cast("int")))).select("event_id")


_HEADERS = ("Property Ref", "Address 1", "Post code", "Sum Insured 24/25", "Sum Insured 25/26", "Year Built", "Storeys")
#: Further headers of the second workbook, whose columns stand in another order under an equal sheet name.
_MORE = ("Roof type", "No. of beds", "Basement", "Listed", "Sprinkler", "Fire alarm", "Flood cover", "Excess", "SI type", "Basis of ded", "Tenure", "Storm")


def schedule_rows(s: Silver, books: int = 1) -> DataFrame:
    """Workbook rows made of the properties: a title, a header, then a row each; with two ``books`` those of even ids in one, of odd ids in the other."""
    place = "path string, sheet string, sheet_idx int, row_idx int, cells array<string>"
    heads = [("b", "Stock list", 0, 0, ["Schedule of values"]), ("b", "Stock list", 0, 1, list(_HEADERS)), ("c", "Stock list", 0, 0, [*_MORE, *reversed(_HEADERS)])]
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cells = [col("property_reference"), text(col("address")), text(col("postcode")), F.lit("1"), F.concat(F.lit("£"), text(col("sum_insured"))), text(col("build_year")), F.lit("3 + basement")]
    more = [text(col("roof_construction")), text(col("storeys")), F.lit("Yes"), F.when(col("property_listed"), "Y").otherwise("N"), F.lit("wet"), F.lit("L1"), F.lit("no"), F.lit("£250"), F.lit("Day one"), F.lit("each"), text(col("tenure")), F.lit("Y")]
    body = lambda rows, path, row: rows.select(F.lit(path).alias("path"), F.lit("Stock list").alias("sheet"), F.lit(0).alias("sheet_idx"), (col("property_id") + 10).cast("int").alias("row_idx"), F.array(*row).alias("cells"))
    if books == 1:
        return s.spark.createDataFrame(heads[:2], place).unionByName(body(s.properties, "b", cells))
    even = col("property_id") % 2 == 0
    return s.spark.createDataFrame(heads, place).unionByName(body(s.properties.where(even), "b", cells)).unionByName(body(s.properties.where(~even), "c", [*more, *reversed(cells)]))


@query("typ_17", """SELECT property_reference, CAST(sum_insured AS DOUBLE) AS sum_insured, CAST(2 AS INT) AS storeys, build_year AS year_of_build, roof, bedrooms, basement, listed, fire_protection, alarms, flood, deductible, basis, si_type, tenure, storm FROM (SELECT p.*, CASE WHEN odd THEN roof_construction END AS roof, CASE WHEN odd THEN p.storeys END AS bedrooms, CASE WHEN odd THEN TRUE END AS basement, CASE WHEN odd THEN coalesce(property_listed, FALSE) END AS listed,
  CASE WHEN odd THEN 'wet' END AS fire_protection, CASE WHEN odd THEN 'L1' END AS alarms, CASE WHEN odd THEN FALSE END AS flood, CASE WHEN odd THEN CAST(250 AS DOUBLE) END AS deductible, CASE WHEN odd THEN 'each' END AS basis, CASE WHEN odd THEN 'Day one' END AS si_type, CASE WHEN odd THEN p.tenure END AS occupancy, CASE WHEN odd THEN TRUE END AS storm
  FROM (SELECT q.*, property_id % 2 = 1 AS odd FROM properties q) p) r""".replace("si_type, tenure, storm FROM", "si_type, occupancy, storm FROM"))
def schedule_ingest(s: Silver) -> DataFrame:
    """Two workbooks with a sheet of one name and other columns: headers found, columns mapped, the later insured sum taken, rows typed."""
    found = ingest.properties(schedule_rows(s, 2))
    return found.select(
        "property_reference", "sum_insured", "storeys", "year_of_build", col("roof_construction").alias("roof"), "bedrooms", col("has_basement").alias("basement"), col("is_listed").alias("listed"), "fire_protection", "alarms",
        col("flood_insured").alias("flood"), "deductible", col("basis_of_deductible").alias("basis"), col("sum_insured_type").alias("si_type"), col("occupancy_type").alias("occupancy"), col("storm_insured").alias("storm"),
    )


@query("typ_15", "SELECT 'b' AS path, 'Stock list' AS sheet, CAST(0 AS INT) AS sheet_idx, count(*) + 2 AS rows, round(log2(count(*) + 3) + 5 + 3 * least(sum(CASE WHEN sum_insured > 1000 THEN 1.0 ELSE 0.0 END + CASE WHEN build_year > 1000 THEN 1.0 ELSE 0.0 END) / (count(*) + 2), 2.0), 4) AS score FROM properties")
def sheet_scores(s: Silver) -> DataFrame:
    return ingest.sheet_scores(schedule_rows(s))


@query("typ_16", "SELECT portfolio_id AS sheet, CAST(portfolio_no % 4 AS INT) AS header_row FROM portfolios")
def header_row(s: Silver) -> DataFrame:
    """A sheet per portfolio, its header behind up to three title rows, before its blocks' rows."""
    sheet = [col("portfolio_id").alias("path"), col("portfolio_id").alias("sheet"), F.lit(0).alias("sheet_idx")]
    at = col("portfolio_no") % 4
    text = lambda *cells: F.array(*(c.cast("string") for c in cells))
    title = s.portfolios.select(*sheet, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row_idx"), text(col("name"), F.lit("schedule")).alias("cells"), at.alias("at")).where("row_idx < at").drop("at")
    head = s.portfolios.select(*sheet, at.cast("int").alias("row_idx"), text(F.lit("Block ref"), F.lit("Postcode"), F.lit("Sum insured")).alias("cells"))
    body = s.blocks.select(*sheet, (col("block_id") + 4).cast("int").alias("row_idx"), text(col("name"), F.lit("AB1 2CD"), col("total_sum_insured")).alias("cells"))
    return ingest.header_scores(title.unionByName(head).unionByName(body)).select("sheet", col("row_idx").alias("header_row"))


@query("str_28", "SELECT property_id, uprn AS first_uprn FROM properties")
def mined(s: Silver) -> DataFrame:
    text = F.concat_ws(" ", F.lit("UPRN"), "uprn", F.lit("at"), "postcode", "uprn")
    return s.properties.select("property_id", F.get(documents.mined(text)["uprns"], F.lit(0)).alias("first_uprn"))


def marked(s: Silver) -> DataFrame:
    text = F.concat(F.lit("cover [Page 1] first "), "text", F.lit(" [Page 2] second page. The quoted sentence stands here. End."))
    return s.benchmark.select(col("item_id").alias("doc_id"), text.alias("text"))


@query("str_25_pages", "SELECT item_id AS doc_id, p AS page_no FROM {benchmark} CROSS JOIN (SELECT 1 AS p UNION ALL SELECT 2) t")
def page_split(s: Silver) -> DataFrame:
    return documents.pages(marked(s)).select("doc_id", "page_no")


@query("sco_19", "SELECT item_id AS doc_id, 'finding' AS field, CAST(CASE WHEN item_id % 3 < 2 THEN 2 END AS INT) AS found_page, item_id % 3 < 2 AS verified, CASE WHEN item_id % 3 < 2 THEN 1.0 ELSE 0.3 END AS score FROM {benchmark}")
def citations(s: Silver) -> DataFrame:
    """Quotes that stand on the page behind the cited one, the same with mistakes, and such that nobody wrote."""
    quote = F.when(col("item_id") % 3 == 0, "The quoted sentence stands here").when(col("item_id") % 3 == 1, "The qoted sentense stand here").otherwise("never written words at all")
    rows = s.benchmark.select(col("item_id").alias("doc_id"), F.lit("finding").alias("field"), F.lit(1).alias("page"), quote.alias("quote"), F.lit("H").alias("confidence"))
    return documents.verified(rows, documents.pages(marked(s))).select("doc_id", "field", "found_page", "verified", "score")


# --- streams ---------------------------------------------------------------


def _event_stream(s: Silver) -> DataFrame:
    return arrivals.events(s.spark, s.sf_dir, "events.parquet")


@query("stm_windows", "SELECT start, event_type, n FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2) x WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM {events}) - INTERVAL 10 MINUTE")
def stream_windows(s: Silver) -> DataFrame:
    """Hourly counts of the event stream, once each window is closed by the watermark."""
    name = f"windows_{uuid.uuid4().hex}"
    found = arrivals.drained(arrivals.tumbling(_event_stream(s)), name, scratch(s, "stream"))
    return found.select(col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stm_03", "SELECT count(DISTINCT event_id) AS n FROM {events}")
def stream_once(s: Silver) -> DataFrame:
    name = f"once_{uuid.uuid4().hex}"
    return arrivals.drained(arrivals.once_per_key(_event_stream(s), ["event_id"]), name, scratch(s, "stream")).agg(F.count("*").alias("n"))


#: Attempts at an upload a user and day, with the outcome of each.
_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'needs_review' WHEN 'error' THEN 'permanent' ELSE 'retryable' END"


@query("stm_02", f"""WITH x AS (SELECT concat(CAST(user_id AS VARCHAR), '-', strftime(ts, '%Y-%m-%d')) AS upload_id, ts, event_id, {_OUTCOME} AS outcome, event_type FROM {{events}}
  WHERE ts <= (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 10 MINUTE) FROM {{events}})),
 n AS (SELECT x.*, row_number() OVER w AS n, lead(ts) OVER w AS later FROM x WINDOW w AS (PARTITION BY upload_id ORDER BY ts, event_id)),
 r AS (SELECT n.*, CASE WHEN outcome = 'retryable' AND n < 5 THEN ts + to_seconds(least(60 * CAST(pow(2, n - 1) AS BIGINT), 21600)) END AS due_at FROM n),
 d AS (SELECT r.*, due_at < later OR (later IS NULL AND due_at <= (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 10 MINUTE) FROM {{events}})) AS fell FROM r)
 SELECT upload_id, CAST(max(n) AS INT) AS attempts, arg_max(CASE outcome WHEN 'permanent' THEN 'failed' WHEN 'retryable' THEN CASE WHEN n < 5 THEN 'retrying' ELSE 'failed' END ELSE outcome END, n) AS status,
  min(ts) AS started_at, max(ts) AS attempted_at, max(CASE WHEN later IS NULL AND NOT fell THEN due_at END) AS next_attempt_at, max(CASE WHEN later IS NULL AND due_at IS NULL THEN ts END) AS completed_at,
  CAST(count(*) FILTER (WHERE fell) AS INT) AS due, max(CASE WHEN later IS NULL AND outcome IN ('retryable', 'permanent') THEN event_type END) AS last_error FROM d GROUP BY 1""")
def ingestion_attempts(s: Silver) -> DataFrame:
    """Attempts at uploads as a stream: counted, backed off, due again or ended; committed batch by batch."""
    s.spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.PROVIDER)
    upload = F.concat_ws("-", col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    tried = _event_stream(s).select(upload.alias("upload_id"), col("ts").alias("attempted_at"), col("event_id").alias("attempt_id"), F.expr(_OUTCOME).alias("outcome"), col("event_type").alias("error"))
    table = SnapshotTable(s.spark, scratch(s, "uploads"), retries.STEPS)
    arrivals.into_table(retries.attempts(tried), table, "stm_02", scratch(s, "stream")).awaitTermination()
    plain = lambda c: col(c).cast("timestamp_ntz").alias(c)
    last = table.current(["upload_id"], col("step"))
    return last.select("upload_id", "attempts", "status", plain("started_at"), plain("attempted_at"), plain("next_attempt_at"), plain("completed_at"), "due", "last_error")


@query("stm_02_upsert", "SELECT user_id, max(event_id) AS event_id FROM {events} GROUP BY 1")
def stream_upsert(s: Silver) -> DataFrame:
    """Micro-batches upserted by key: the highest event stays, whichever batch it comes with."""
    table = SnapshotTable(s.spark, scratch(s, "table"), "user_id long, event_id long")
    arrivals.into_table(_event_stream(s).select("user_id", "event_id"), table, "upserts", scratch(s, "stream")).awaitTermination()
    table.compact(["user_id"], col("event_id"))
    return table.read()
