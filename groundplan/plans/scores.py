"""Classifications, scores, value parsing, type detection, hierarchies: queries over derived text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.functions import address, bands, geo, rules, scoring, values
from groundplan.operators import detect, graph, json_schema, similar, spatial
from groundplan.operators import relational as ops
from groundplan.plans import record_schemas
from groundplan.plans.aggregates import FORM_SQL
from groundplan.plans.registry import RATIO_SQL, query
from groundplan.plans.relational import ASSESSED, assessed_blocks, latest_fra, latest_fraew
from groundplan.plans.silver import AS_OF, Silver

col = F.col
#: Sample ratings, dealt to events by number.
RATINGS = (
    "High", "Very high risk", "Tolerable", "Tolerable but must reduce", "Moderate", "n/a", "TBC", "No significant findings", "Significant risk", "Grade D", "c", "4/5", "3", "Priority 1", "priority 2", "Low risk", "very low", "Broadly satisfactory",
    "Not acceptable", "No further action", "Further assessment needed", "purple", "", "Intolerable", "Requires attention", "Broadly acceptable", "2", "unknown",
)
_RATINGS_SQL = "SELECT event_id, CASE event_id % 28 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(RATINGS)) + " END AS rating FROM {events}"


def ratings(s: Silver) -> DataFrame:
    return s.events.select("event_id", F.element_at(F.array(*map(F.lit, RATINGS)), (col("event_id") % 28 + 1).cast("int")).alias("rating"))


@query("sco_01", f"SELECT event_id, {rules.cascade_sql('rating', rules.FRA_RULES, 'AMBER')} AS band FROM ({_RATINGS_SQL}) r")
def fra_rating(s: Silver) -> DataFrame:
    return ratings(s).select("event_id", rules.fra_rating(col("rating")).alias("band"))


@query("sco_03", f"SELECT event_id, {rules.cascade_sql('rating', rules.FRAEW_RULES, 'AMBER')} AS band FROM ({_RATINGS_SQL}) r")
def fraew_rating(s: Silver) -> DataFrame:
    return ratings(s).select("event_id", rules.fraew_rating(col("rating")).alias("band"))


_N = "(CASE WHEN {0} > 0 THEN least({0} * {1}, {2}) ELSE 0 END)"
_CURRENT = f"assessment_valid_until >= DATE '{AS_OF}'"
_DEDUCT = {
    "cat1": "CASE coalesce(rag_status, 'x') WHEN 'RED' THEN 4.0 WHEN 'GREEN' THEN 0.0 ELSE 2.0 END",
    "cat2": f"(CASE WHEN assessment_valid_until < DATE '{AS_OF}' THEN 1.5 ELSE 0.0 END) + (CASE WHEN {_CURRENT} AND assessment_valid_until <= DATE '{AS_OF}' + INTERVAL 90 DAY THEN 0.5 ELSE 0.0 END) + (CASE WHEN fra_assessment_type = 'Type 1' THEN 0.5 ELSE 0.0 END)",
    "cat3": " + ".join((_N.format("overdue_action_count", "0.5", "2.0"), _N.format("(outstanding_action_count - overdue_action_count)", "0.25", "1.0"), _N.format("no_date_action_count", "0.1", "0.5"))),
    "cat4": " + ".join(f"(CASE WHEN {k} = FALSE THEN {v} ELSE 0.0 END)" for k, v in (("has_smoke_detection", 0.5), ("has_fire_doors", 0.5), ("has_compartmentation", 0.5), ("has_emergency_lighting", 0.25))),
    "cat5": "(CASE WHEN mandatory_occurrence_noted THEN 1.0 ELSE 0.0 END) + (CASE WHEN evacuation_strategy_changed THEN 0.25 ELSE 0.0 END) + (CASE WHEN bsa_2022_applicable AND NOT coalesce(accountable_person_noted, FALSE) THEN 0.25 ELSE 0.0 END)",
}
_SCORE_SQL = "SELECT fra_id, block_id, created_seq, " + ", ".join(f"CAST(-({v}) AS DOUBLE) AS {k}" for k, v in _DEDUCT.items()) + " FROM fra_features"
_SCORED_SQL = f"SELECT x.*, CAST(round(CAST(greatest(10 + cat1 + cat2 + cat3 + cat4 + cat5, 0.5) AS DECIMAL(8,4)), 1) AS DOUBLE) AS score FROM ({_SCORE_SQL}) x"
_BAND = "CASE WHEN score >= 7.5 THEN 'GREEN' WHEN score >= 4.5 THEN 'AMBER' ELSE 'RED' END"


@query("sco_05", f"SELECT fra_id, score, {_BAND} AS band, round(cat3, 2) AS cat3, round(cat4, 2) AS cat4, score = 0.5 AND 10 + cat1 + cat2 + cat3 + cat4 + cat5 < 0.49995 AS floor_applied FROM ({_SCORED_SQL}) y")
def fra_score(s: Silver) -> DataFrame:
    scored = s.fra_features.select("fra_id", scoring.fra_score(F.lit(AS_OF).cast("date")).alias("s"))
    return scored.select("fra_id", "s.score", "s.band", "s.cat3", "s.cat4", "s.floor_applied")


@query("sco_06", f"SELECT block_id, count(*) AS assessments, min(score) AS worst, round(avg(score), 4) AS mean FROM ({_SCORED_SQL}) y GROUP BY 1")
def scores_per_block(s: Silver) -> DataFrame:
    scored = s.fra_features.select("block_id", scoring.fra_score(F.lit(AS_OF).cast("date"))["score"].alias("score"))
    return scored.groupBy("block_id").agg(F.count("*").alias("assessments"), F.min("score").alias("worst"), F.round(F.avg("score"), 4).alias("mean"))


@query("sco_07", "SELECT b.block_id, f.rag_status AS fra_status FROM blocks b LEFT JOIN (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY block_id ORDER BY assessment_date DESC NULLS LAST, created_seq DESC, fra_id DESC) AS rn FROM fra_features x WHERE rag_status IS NOT NULL) y WHERE rn = 1) f ON f.block_id = b.block_id")
def status_sync(s: Silver) -> DataFrame:
    """The latest rating that is not null; the other kind of document takes the latest, null or not (join_04)."""
    rated = s.fra_features.where(col("rag_status").isNotNull())
    last = ops.first_per_group(rated, ["block_id"], [col("assessment_date").desc_nulls_last(), col("created_seq").desc(), col("fra_id").desc()])
    return s.blocks.select("block_id").join(last.select("block_id", col("rag_status").alias("fra_status")), "block_id", "left")


@query("sco_08", f"SELECT p.property_id, CASE WHEN a.fra_rag = 'RED' OR (a.fra_rag IS NULL AND p.risk_rating IN ('D', 'E')) THEN 'red' WHEN a.fra_rag = 'AMBER' OR (a.fra_rag IS NULL AND p.risk_rating = 'C') THEN 'amber' WHEN a.fra_rag = 'GREEN' OR p.risk_rating IN ('A', 'B') THEN 'green' ELSE 'grey' END AS colour FROM properties p LEFT JOIN ({ASSESSED}) a ON a.block_id = p.block_id")
def map_colour(s: Silver) -> DataFrame:
    rag = assessed_blocks(s).select("block_id", "fra_rag")
    own = F.when(col("risk_rating").isin("D", "E"), "RED").when(col("risk_rating") == "C", "AMBER").when(col("risk_rating").isin("A", "B"), "GREEN")
    return s.properties.join(rag, "block_id", "left").select("property_id", F.coalesce(F.lower(F.coalesce("fra_rag", own)), F.lit("grey")).alias("colour"))


@query("sco_09", f"SELECT block_id, CASE WHEN 'RED' IN (fra_rag, fraew_rag) THEN 'RED' WHEN 'AMBER' IN (fra_rag, fraew_rag) THEN 'AMBER' WHEN 'GREEN' IN (fra_rag, fraew_rag) THEN 'GREEN' END AS worst FROM ({ASSESSED}) a")
def worst_band(s: Silver) -> DataFrame:
    return assessed_blocks(s).select("block_id", scoring.worst([col("fra_rag"), col("fraew_rag")]).alias("worst"))


_FRA_CURRENT, _FRAEW_CURRENT = ("fra_id", "rag_status", "assessment_date", "assessment_valid_until", "overdue_action_count"), ("fraew_id", "rag_status", "assessment_valid_until", "has_combustible_cladding", "aluminium_composite_cladding", "bs8414_test_evidence", "asbestos_suspected", "building_height_m")
_DETAIL = f"""SELECT b.block_id, b.is_listed, coalesce(b.height_max_m, w.building_height_m) AS height, f.fra_id, f.rag_status AS fra_rag, f.assessment_valid_until < DATE '{AS_OF}' AS fra_old, f.overdue_action_count AS overdue,
 w.fraew_id, w.rag_status AS fraew_rag, w.assessment_valid_until < DATE '{AS_OF}' AS fraew_old, w.has_combustible_cladding AS combustible, w.aluminium_composite_cladding AS acm, w.bs8414_test_evidence AS evidence, w.asbestos_suspected AS asbestos
 FROM blocks b LEFT JOIN (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY block_id ORDER BY assessment_date DESC NULLS LAST, created_seq DESC, fra_id DESC) AS rn FROM fra_features x) y WHERE rn = 1) f ON f.block_id = b.block_id
 LEFT JOIN (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY block_id ORDER BY assessment_date DESC NULLS LAST, created_seq DESC, fraew_id DESC) AS rn FROM fraew_features x) y WHERE rn = 1) w ON w.block_id = b.block_id"""


def block_detail(s: Silver) -> DataFrame:
    """Blocks with what their latest assessments say about risk, dates and walls."""
    old = lambda c, n: (col(c) < F.lit(AS_OF).cast("date")).alias(n)
    fra = latest_fra(s, _FRA_CURRENT).select("block_id", "fra_id", col("rag_status").alias("fra_rag"), old("assessment_valid_until", "fra_old"), col("overdue_action_count").alias("overdue"))
    walls = latest_fraew(s, _FRAEW_CURRENT).select("block_id", "fraew_id", col("rag_status").alias("fraew_rag"), old("assessment_valid_until", "fraew_old"), col("has_combustible_cladding").alias("combustible"), col("aluminium_composite_cladding").alias("acm"), col("bs8414_test_evidence").alias("evidence"), col("asbestos_suspected").alias("asbestos"), "building_height_m")
    joined = s.blocks.select("block_id", "is_listed", "height_max_m").join(fra, "block_id", "left").join(walls, "block_id", "left")
    return joined.withColumn("height", F.coalesce("height_max_m", "building_height_m"))


#: Tone, condition and text of each alert, in order; a text may be an expression.
_ALERTS = (
    ("amber", "fra_id IS NULL", "'No FRA on record'"), ("info", "fraew_id IS NULL", "'No FRAEW on record'"), ("red", "fra_rag = 'RED'", "'FRA rated high'"), ("red", "fraew_rag = 'RED'", "'FRAEW rated high'"),
    ("red", "fra_old", "'FRA is out of date'"), ("amber", "fraew_old", "'FRAEW is out of date'"), ("red", "overdue > 0", "concat(overdue, ' overdue FRA action', CASE WHEN overdue > 1 THEN 's' ELSE '' END)"),
    ("red", "acm", "'ACM cladding present'"), ("red", "NOT coalesce(acm, FALSE) AND combustible", "'Combustible cladding present'"), ("red", "combustible AND height >= 18 AND coalesce(evidence, '') <> 'yes'", "'Combustible cladding over 18m without BS 8414 evidence'"),
    ("amber", "asbestos", "'Asbestos suspected behind cladding'"), ("info", "is_listed", "'Listed building'"),
)
_REASONS = (
    ("fraew_rag = 'RED'", "'external wall (FRAEW) rated high'"), ("fra_rag = 'RED'", "'fire risk (FRA) rated high'"), ("acm", "'ACM cladding present'"), ("NOT coalesce(acm, FALSE) AND combustible", "'combustible cladding present'"),
    ("overdue > 0", "concat(overdue, ' overdue action', CASE WHEN overdue > 1 THEN 's' ELSE '' END)"), ("fra_old", "'FRA out of date'"), ("fraew_old", "'FRAEW out of date'"),
)
#: Reasons that are given if there is none of those above.
_MILD = (("fraew_rag = 'AMBER'", "'external wall (FRAEW) rated medium'"), ("fra_rag = 'AMBER'", "'fire risk (FRA) rated medium'"))
_NOTHING = ("fra_id IS NULL AND fraew_id IS NULL", "'no fire-risk assessments on record'")


def _noted(pairs: list[tuple[str, str]]) -> F.Column:
    return F.array_compact(F.array(*(F.when(F.expr(p), F.expr(t)) for p, t in pairs)))


def _noted_sql(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {p} THEN {t} END" for p, t in pairs) + ")"


_TONED = [(p, f"concat('{tone}: ', {t})") for tone, p, t in _ALERTS]


@query("sco_10", f"SELECT block_id, {_noted_sql(_TONED)} AS alerts FROM ({_DETAIL}) a")
def alerts(s: Silver) -> DataFrame:
    """The twelve alerts of a block, each with its tone."""
    return block_detail(s).select("block_id", F.array_join(_noted(_TONED), "|").alias("alerts"))


@query("sco_11", f"SELECT block_id, concat_ws('|', CASE WHEN {_noted_sql(_REASONS)} <> '' THEN {_noted_sql(_REASONS)} WHEN {_noted_sql(_MILD)} <> '' THEN {_noted_sql(_MILD)} END, CASE WHEN {_NOTHING[0]} THEN {_NOTHING[1]} END) AS reasons, CASE WHEN 'RED' IN (fra_rag, fraew_rag) THEN 'RED' WHEN 'AMBER' IN (fra_rag, fraew_rag) THEN 'AMBER' WHEN 'GREEN' IN (fra_rag, fraew_rag) THEN 'GREEN' END AS band FROM ({_DETAIL}) a")
def risk_reasons(s: Silver) -> DataFrame:
    """A block's overall band and what drives it; milder reasons only where there is no grave one."""
    grave = _noted(_REASONS)
    found = F.concat(F.when(F.size(grave) > 0, grave).otherwise(_noted(_MILD)), _noted([_NOTHING]))
    return block_detail(s).select("block_id", F.array_join(found, "|").alias("reasons"), scoring.worst([col("fra_rag"), col("fraew_rag")]).alias("band"))


@query("sco_12", f"""SELECT property_id, form, alone, CASE WHEN form IN ('garage', 'infrastructure', 'commercial') OR (form IN ('house', 'bungalow') AND alone) THEN 'not_required' WHEN form IS NULL OR alone IS NULL THEN 'unknown' ELSE 'required' END AS requirement
 FROM (SELECT property_id, form, CASE WHEN trim(block_reference) <> '' THEN FALSE WHEN form IN ('house', 'bungalow') THEN TRUE END AS alone FROM (SELECT property_id, block_reference, {FORM_SQL} AS form FROM properties) x) y""")
def dwellings(s: Silver) -> DataFrame:
    form = s.properties.select("property_id", "block_reference", rules.dwelling_form(col("property_type"), col("built_form")).alias("form"))
    alone = form.withColumn("alone", rules.is_standalone(col("form"), col("block_reference")))
    return alone.select("property_id", "form", "alone", rules.fra_requirement(col("form"), col("alone")).alias("requirement"))


_NEAR60 = "SELECT c.postcode, p.uprn, sqrt((c.easting - p.easting) * (c.easting - p.easting) + (c.northing - p.northing) * (c.northing - p.northing)) AS d FROM centroids c JOIN uprn_points p ON sqrt((c.easting - p.easting) * (c.easting - p.easting) + (c.northing - p.northing) * (c.northing - p.northing)) <= 60"
_SIGNAL = "CASE WHEN d <= 15 THEN 0.3 WHEN d <= 30 THEN 0.2 WHEN d <= 60 THEN 0.1 ELSE 0.0 END"


def places_near(s: Silver) -> DataFrame:
    """(postcode, points, first, distance): the positions near each postcode, with the number of their points and the first one."""
    places = s.uprn_points.groupBy("easting", "northing").agg(F.count("*").alias("points"), F.min("uprn").alias("first"))
    return spatial.within(s.centroids, places, 60)


@query("sco_13", f"""SELECT postcode, uprn, score, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT postcode, uprn, CAST(round(greatest(0.0, least(0.2 + sig + CASE WHEN n = 1 THEN 0.2 WHEN n <= 5 THEN 0.1 ELSE 0.0 END - CASE WHEN same > 1 THEN 0.15 ELSE 0.0 END, 0.95)), 2) AS DOUBLE) AS score
 FROM (SELECT postcode, uprn, sig, count(*) OVER (PARTITION BY postcode) AS n, count(*) OVER (PARTITION BY postcode, sig) AS same FROM (SELECT postcode, uprn, {_SIGNAL} AS sig FROM ({_NEAR60}) a) b) c) e""")
def match_by_signals(s: Silver) -> DataFrame:
    """Pairs are neither shuffled nor kept: a postcode has a score for each signal, from counts by position, and its pairs pick theirs."""
    sig = scoring.spatial_signal(col("distance"))
    # the score knows of a distance only its signal; the last one begins behind the radius
    same = {f"_{k}": (v, far) for k, (v, far) in enumerate(zip(scoring.SIGNALS[:3], (15.0, 30.0, 60.0), strict=True))}
    counts = places_near(s).groupBy("postcode").agg(F.sum("points").alias("n"), *(F.sum(F.when(sig == v, col("points"))).alias(k) for k, (v, _) in same.items()))
    scored = lambda k, far: F.struct(*(c.alias(n) for c, n in zip(scoring.match_confidence_by_signals(F.lit(far), col("n"), col(k), F.lit("none"), F.lit(True)), ("score", "band"), strict=True))).alias(k)
    near = spatial.within(s.centroids.join(counts, "postcode").select("postcode", *spatial.XY, *(scored(k, far) for k, (_, far) in same.items())), spatial.gathered(s.uprn_points, "uprn"), 60)
    pick = lambda n: F.coalesce(*(F.when(sig == v, col(k)[n]) for k, (v, _) in same.items())).alias(n)
    return near.select("postcode", "points", pick("score"), pick("band")).select("postcode", F.explode("points").alias("uprn"), "score", "band")


@query("sco_14", f"""SELECT postcode, uprn, score, CASE WHEN score >= 0.65 THEN 'HIGH' WHEN score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT postcode, uprn, CAST(round(greatest(0.05, least(CASE WHEN n = 1 AND best > 30 THEN 0.55 WHEN n = 1 THEN 0.9 WHEN n = 2 THEN 0.6 WHEN n = 3 THEN 0.45 WHEN n <= 10 THEN 0.25 ELSE 0.1 END + 0.05 + CASE WHEN rn = 1 AND d <= 5 THEN 0.05 WHEN d > 20 THEN -0.1 ELSE 0.0 END, 0.95)), 2) AS DOUBLE) AS score
 FROM (SELECT a.*, count(*) OVER (PARTITION BY postcode) AS n, min(d) OVER (PARTITION BY postcode) AS best, row_number() OVER (PARTITION BY postcode ORDER BY d, uprn) AS rn FROM ({_NEAR60}) a) b) c""")
def match_by_candidates(s: Silver) -> DataFrame:
    # the score knows of a distance only whether it is above 20, and of the closest one's whether it is at most 5;
    # only distances up to that are told apart, so that no aggregate over pairs needs a sort
    close = F.when(col("distance") <= 5, col("distance")).alias("close")
    counts = places_near(s).groupBy("postcode", close).agg(F.sum("points").alias("n"), F.min("distance").alias("best"), F.min("first").alias("first"))
    counts = counts.groupBy("postcode").agg(F.sum("n").alias("n"), F.min("best").alias("best"), F.min(F.when(col("close").isNotNull(), F.struct("close", "first"))).alias("m")).select("postcode", "n", "best", "m.close", "m.first")
    kinds = {"_first": (5.0, True), "_near": (20.0, False), "_far": (60.0, False)}
    scored = lambda d, closest: F.struct(*(c.alias(n) for c, n in zip(scoring.match_confidence(F.lit(d), col("n"), col("best"), F.lit(closest), F.lit(True)), ("score", "band"), strict=True)))
    asked = s.centroids.join(counts, "postcode").select("postcode", *spatial.XY, "close", "first", *(scored(*v).alias(k) for k, v in kinds.items()))
    near = spatial.within(asked, spatial.gathered(s.uprn_points, "uprn"), 60)
    holds = col("distance") == col("close")
    pick = lambda n: F.when(col("distance") > 20, col("_far")[n]).otherwise(col("_near")[n]).alias(n)
    rows = near.select("postcode", F.when(holds, col("first")).alias("first"), F.when(holds, col("_first")).alias("_first"), pick("score"), pick("band"), F.explode("points").alias("uprn"))
    own = lambda n: F.when(col("uprn") == col("first"), col("_first")[n]).otherwise(col(n)).alias(n)
    return rows.select("postcode", "uprn", own("score"), own("band"))


_SECOND = "CASE property_id % 3 WHEN 0 THEN concat(replace(address, 'Street', 'St'), ', AB1 2CD') WHEN 1 THEN concat('Flat 9, ', upper(address)) ELSE 'The Old Mill, Riverside' END"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SET = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"


@query("sco_16", f"""WITH RECURSIVE rows_ AS (SELECT property_id, {_PLAIN.format('address')} AS a, {_PLAIN.format(_SECOND)} AS b FROM properties WHERE address IS NOT NULL), pairs AS (SELECT DISTINCT a, b FROM rows_), {RATIO_SQL},
 s AS (SELECT a, b, round(greatest(ratio, len(list_intersect({_SET.format('a')}, {_SET.format('b')})) * 1.0 / greatest(len({_SET.format('a')}), len({_SET.format('b')}))), 3) AS score FROM ratio)
 SELECT property_id, score, CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM rows_ JOIN s USING (a, b)""")
def address_comparison(s: Silver) -> DataFrame:
    """Addresses with an abbreviation, with a flat in front, and another one."""
    pairs = s.properties.where(col("address").isNotNull()).select("property_id", "address", F.expr(_SECOND).alias("other"))
    return similar.with_comparison(pairs, col("address"), col("other")).select("property_id", "score", "level")


@query("sco_15")
def cross_reference(s: Silver) -> DataFrame:
    """Traffic lights for address matches; rows only, it uses the sequence similarity."""
    from groundplan.operators.matching import traffic_lights

    rows = s.properties.where(col("address").isNotNull()).select("property_id", col("address").alias("given"), F.concat(F.upper("address"), F.lit(", AB1 2CD")).alias("matched"), (F.lit(0.6) + col("property_id") % 5 / 10).alias("os_match"), F.when(col("property_id") % 3 == 0, col("uprn")).alias("parent_uprn"), F.lit(None).cast("string").alias("parent_address"), F.lit("E").alias("country"))
    return traffic_lights(rows).select("property_id", "level", "confidence", "reason")


@query("sco_18", "SELECT block_id, CAST(round(greatest(0.0, least(1.0, least(0.9, cov) - least(0.5, 0.05 * w))), 3) AS DOUBLE) AS confidence FROM (SELECT block_id, ((CASE WHEN fra_rag IS NOT NULL THEN 1.0 ELSE 0.0 END) + (CASE WHEN fra_date IS NOT NULL THEN 1.0 ELSE 0.0 END) + (CASE WHEN fraew_rag IS NOT NULL THEN 1.0 ELSE 0.0 END) + (CASE WHEN has_combustible_cladding IS NOT NULL THEN 1.0 ELSE 0.0 END)) / 4 AS cov, block_id % 4 AS w FROM (" + ASSESSED + ") a) x")
def composite(s: Silver) -> DataFrame:
    covered = scoring.coverage([col("fra_rag"), col("fra_date"), col("fraew_rag"), col("has_combustible_cladding")])
    weights = F.array_repeat(F.lit(0.05), (col("block_id") % 4).cast("int"))
    return assessed_blocks(s).select("block_id", scoring.composite_confidence(F.lit(0.9), covered, weights).alias("confidence"))


_YEAR = int(AS_OF[:4])
#: Field and text of each warning, with its condition.
_FRA_CHECKS = (
    ("assessment_date > next_review_date", "next_review_date: before assessment_date"), ("assessment_date > assessment_valid_until", "assessment_valid_until: before assessment_date"), (f"assessment_date > DATE '{AS_OF}'", "assessment_date: in the future"),
    (f"NOT build_year BETWEEN 1600 AND {_YEAR}", "build_year: outside plausible range"), ("{far} > 15 * 365", "action_items.due_date: >15y from assessment_date"),
)
_FRAEW_CHECKS = (
    ("assessment_date > report_date", "assessment_date: site investigation after report_date"), ("assessment_valid_until < report_date", "assessment_valid_until: before report_date"), (f"NOT build_year BETWEEN 1600 AND {_YEAR}", "build_year: outside plausible range"),
    ("retrofit_year < build_year", "retrofit_year: before build_year"), ("NOT building_height_m BETWEEN 2 AND 150", "building_height_m: outside plausible range"), ("NOT num_storeys BETWEEN 1 AND 70", "num_storeys: outside plausible range"),
    ("wall_coverage > 120", "wall_types.coverage_percent: sum to >120%"),
)
_FAR_SPARK, _FAR_SQL = "abs(datediff(far_due_date, assessment_date))", "abs(CAST(far_due_date AS DATE) - assessment_date)"


def _checked(checks: tuple[tuple[str, str], ...], far: str) -> list[tuple[str, str]]:
    return [(p.replace("{far}", far), f"'{t}'") for p, t in checks]


@query("sco_21", f"SELECT fra_id AS report_id, 'FRA' AS kind, {_noted_sql(_checked(_FRA_CHECKS, _FAR_SQL))} AS warnings FROM fra_features UNION ALL SELECT fraew_id, 'FRAEW', {_noted_sql(_checked(_FRAEW_CHECKS, ''))} FROM fraew_features")
def consistency(s: Silver) -> DataFrame:
    """Warnings across fields: five of a fire risk assessment, seven of an external wall one."""
    told = lambda df, key, kind, checks: df.select(col(key).alias("report_id"), F.lit(kind).alias("kind"), F.array_join(_noted(_checked(checks, _FAR_SPARK)), "|").alias("warnings"))
    return told(s.fra_features, "fra_id", "FRA", _FRA_CHECKS).unionByName(told(s.fraew_features, "fraew_id", "FRAEW", _FRAEW_CHECKS))


@query("sco_23", f"SELECT block_id, CAST(CASE WHEN coalesce(fra_rag, '') = coalesce(fraew_rag, '') THEN 1.0 WHEN fra_rag IS NULL OR fraew_rag IS NULL THEN 0.5 ELSE 0.0 END AS DOUBLE) AS agreement FROM ({ASSESSED}) a")
def agreement(s: Silver) -> DataFrame:
    return assessed_blocks(s).select("block_id", scoring.agreement(col("fra_rag"), col("fraew_rag")).alias("agreement"))


@query("sco_24", f"SELECT block_id, coalesce(fraew_rag, fra_rag) AS merged, least(CASE WHEN fra_rag IS NULL THEN 0.4 ELSE 0.9 END, CASE WHEN fraew_rag IS NULL THEN 0.5 ELSE 0.8 END) AS confidence FROM ({ASSESSED}) a")
def merged_extractions(s: Silver) -> DataFrame:
    confidence = F.least(F.when(col("fra_rag").isNull(), 0.4).otherwise(0.9), F.when(col("fraew_rag").isNull(), 0.5).otherwise(0.8))
    return assessed_blocks(s).select("block_id", F.coalesce("fraew_rag", "fra_rag").alias("merged"), confidence.alias("confidence"))


PRIORITIES = ((r"\b(high|urgent|immediate|critical|1)\b", "high"), (r"\b(medium|moderate|2)\b", "medium"), (r"\b(low|minor|3)\b", "low"), (r"\badvisory\b", "advisory"))


@query("sco_25", f"SELECT event_id, {rules.cascade_sql('rating', PRIORITIES, None)} AS priority FROM ({_RATINGS_SQL}) r")
def priorities(s: Silver) -> DataFrame:
    return ratings(s).select("event_id", rules.cascade(col("rating"), PRIORITIES).alias("priority"))


@query("sco_28", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'High' WHEN s_suppkey % 3 = 0 THEN 'Medium' WHEN s_suppkey % 2 = 0 THEN 'Low' ELSE 'Very Low' END AS band FROM {supplier}")
def flood(s: Silver) -> DataFrame:
    count = lambda m: (col("s_suppkey") % m == 0).cast("int")
    return s.supplier.select("s_suppkey", scoring.flood_band(count(5), count(3), count(2)).alias("band"))


@query("sco_29", "SELECT property_id, CASE WHEN score >= 80 THEN 'ready' WHEN score >= 50 THEN 'partial' ELSE 'poor' END AS band FROM (SELECT property_id, 100 - 25 * ((CASE WHEN uprn IS NULL THEN 1 ELSE 0 END) + (CASE WHEN postcode IS NULL THEN 1 ELSE 0 END) + (CASE WHEN latitude IS NULL THEN 1 ELSE 0 END)) AS score FROM properties) x")
def readiness_band(s: Silver) -> DataFrame:
    missing = sum((col(c).isNull().cast("int") for c in ("uprn", "postcode", "latitude")), F.lit(0))
    score = 100 - 25 * missing
    return s.properties.select("property_id", F.when(score >= 80, "ready").when(score >= 50, "partial").otherwise("poor").alias("band"))


@query("sco_30", "SELECT event_id, CASE WHEN value >= 50 AND event_id % 4 = 0 THEN 'completed' WHEN value >= 50 THEN 'needs_review' WHEN event_id % 7 < 5 THEN 'retrying' ELSE 'failed' END AS status FROM {events}")
def transitions(s: Silver) -> DataFrame:
    return s.events.select("event_id", scoring.upload_status(col("value") >= 50, col("event_id") % 4, col("event_id") % 7).alias("status"))


@query("sco_31", "SELECT block_id, CASE min(r) WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE 'Very Low' END AS worst FROM (SELECT block_id, CASE WHEN property_id % 5 = 0 THEN 1 WHEN property_id % 3 = 0 THEN 2 WHEN property_id % 2 = 0 THEN 3 ELSE 4 END AS r FROM properties) x GROUP BY 1")
def worst_flood(s: Silver) -> DataFrame:
    count = lambda m: (col("property_id") % m == 0).cast("int")
    band = scoring.flood_band(count(5), count(3), count(2))
    ranked = s.properties.select("block_id", band.alias("band"), scoring.rank_of(band, ("High", "Medium", "Low", "Very Low")).alias("r"))
    return ranked.groupBy("block_id").agg(F.min_by("band", "r").alias("worst"))


SCOTTISH = ("AB", "DD", "DG", "EH", "FK", "G", "HS", "IV", "KA", "KW", "KY", "ML", "PA", "PH", "TD", "ZE")


@query("sco_32", "SELECT property_id, CASE WHEN regexp_extract(postcode, '^([A-Z]+)', 1) IN (" + ", ".join(f"'{a}'" for a in SCOTTISH) + ") THEN 'SCO' WHEN postcode IS NULL THEN NULL ELSE 'ENG' END AS nation FROM properties")
def nation(s: Silver) -> DataFrame:
    area = F.regexp_extract("postcode", "^([A-Z]+)", 1)
    return s.properties.select("property_id", F.when(area.isin(*SCOTTISH), "SCO").when(col("postcode").isNotNull(), "ENG").alias("nation"))


@query("sco_33", "SELECT property_id, concat_ws('|', CASE WHEN uprn IS NOT NULL AND length(uprn) <> 12 THEN 'uprn: pattern' END, CASE WHEN latitude IS NOT NULL AND (latitude < 49 OR latitude > 61) THEN 'latitude: range' END, CASE WHEN sum_insured IS NULL THEN 'sum_insured: required' WHEN sum_insured < 1000 THEN 'sum_insured: range' END, CASE WHEN epc_rating IS NOT NULL AND epc_rating NOT IN ('A','B','C','D','E','F','G') THEN 'epc_rating: enum' END) AS errors FROM properties")
def record_checks(s: Silver) -> DataFrame:
    from groundplan.operators.validate import Check, errors

    checks = [Check("uprn", pattern=r"^\d{12}$"), Check("latitude", least=49, most=61), Check("sum_insured", required=True, least=1000), Check("epc_rating", allowed=tuple("ABCDEFG"))]
    return s.properties.select("property_id", F.array_join(errors(checks), "|").alias("errors"))


_TYPES_SQL = ", ".join(f"'{t}'" for t in ("Apartment", "Terraced", "Semi-Detached", "Detached", "Bungalow", "Maisonette"))


@query("sco_33_property", f"""SELECT property_id, concat_ws('|', CASE WHEN uprn IS NOT NULL AND length(uprn) <> 12 THEN '$.uprn: pattern' END, CASE WHEN ha_id NOT IN ('ha_0', 'ha_1') THEN '$.region: enum' END,
  CASE WHEN postcode IS NOT NULL AND property_id % 7 = 0 THEN '$.postcode: pattern' END, CASE WHEN property_id % 31 = 0 AND latitude IS NOT NULL THEN '$.lat: type' WHEN latitude < 49 OR latitude > 61 THEN '$.lat: minimum' END,
  CASE WHEN longitude < -8 OR longitude > 2 THEN '$.lon: minimum' END, CASE WHEN build_year < 1900 AND property_id % 2 = 0 THEN '$.buildYear: minimum' END, CASE WHEN property_type NOT IN ({_TYPES_SQL}) THEN '$.type: enum' END,
  CASE WHEN tenure = 'Social rent' THEN '$.tenure: enum' END, CASE WHEN units IS NOT NULL AND property_id % 5 = 0 THEN '$.numberOfUnits: minimum' END, CASE WHEN property_id % 9 = 0 THEN '$.odd: additionalProperties' END) AS errors FROM properties""")
def property_records(s: Silver) -> DataFrame:
    """Properties as JSON records against the property schema; some fields are spoilt, so that each kind of rule has something to find."""
    nth = lambda n: col("property_id") % n == 0
    region = F.when(col("ha_id") == "ha_0", "Scotland").when(col("ha_id") == "ha_1", "South West").otherwise("Elsewhere")
    record = {
        "id": col("property_id"), "uprn": col("uprn"), "address": col("address"), "region": region, "postcode": F.when(nth(7), F.concat("postcode", F.lit("?"))).otherwise(col("postcode")),
        "lon": col("longitude"), "buildYear": F.when(nth(2) & (col("build_year") < 1900), col("build_year") - 1000).otherwise(col("build_year")), "type": col("property_type"), "tenure": col("tenure"),
        "epcRating": col("epc_rating"), "sumInsured": col("sum_insured"), "numberOfUnits": F.when(nth(5), F.lit(0) * col("units")).otherwise(col("units")), "odd": F.when(nth(9), True),
    }
    # a field that is a number in some records and a text in others is put in as a map's
    latitude = F.when(nth(31), F.to_json(F.create_map(F.lit("lat"), col("latitude").cast("string")))).otherwise(F.to_json(F.create_map(F.lit("lat"), col("latitude"))))
    plain = F.to_json(F.struct(*(c.alias(k) for k, c in record.items())))
    text = F.when(col("latitude").isNull(), plain).otherwise(F.concat(F.regexp_replace(plain, r"\}$", ","), F.substr(latitude, F.lit(2))))
    return s.properties.select("property_id", F.array_join(json_schema.violations_of_text(record_schemas.PROPERTY, text), "|").alias("errors"))


@query("sco_33_upload", """SELECT upload_id, concat_ws('|', CASE WHEN upload_id % 7 = 0 THEN '$.message: required' END, CASE WHEN upload_id % 3 = 0 THEN '$.columns[1]: type' END, CASE WHEN upload_id % 4 = 0 THEN '$.data[0]: type' END,
  CASE WHEN upload_id % 5 = 0 THEN '$.column_mapping.b: type' END, CASE WHEN upload_id % 11 = 0 THEN '$.row_count: type' WHEN upload_id % 13 = 0 THEN '$.row_count: minimum' END) AS errors FROM uploads WHERE upload_id % 17 <> 0
 UNION ALL SELECT upload_id, '$: json' FROM uploads WHERE upload_id % 17 = 0""")
def upload_records(s: Silver) -> DataFrame:
    """Answers to uploads as JSON texts against their schema: items of arrays, members of any name, and texts that are cut off."""
    nth = lambda n: col("upload_id") % n == 0
    parts = [
        F.lit('{"success": true'), F.when(nth(7), "").otherwise(F.concat(F.lit(', "message": '), F.to_json(F.array("status")).substr(F.lit(2), F.length("status") + 2))),
        F.when(nth(3), ', "columns": ["a", 7]').otherwise(', "columns": ["a", "b"]'), F.when(nth(4), ', "data": [[1], {}]').otherwise(', "data": [{"a": null}]'),
        F.when(nth(5), ', "column_mapping": {"a": "b", "b": null}').otherwise(', "column_mapping": {}'), F.lit(', "row_count": '), F.when(nth(11), "1.5").when(nth(13), "-1").otherwise("12.0"), F.when(nth(17), "").otherwise("}"),
    ]
    return s.uploads.select("upload_id", F.array_join(json_schema.violations_of_text(record_schemas.UPLOAD_RESPONSE, F.concat(*parts)), "|").alias("errors"))


# --- values ----------------------------------------------------------------

_MONEY = "CASE o_orderkey % 5 WHEN 0 THEN concat('£', CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR), ',000') WHEN 1 THEN ' 0 ' WHEN 2 THEN 'n/a' WHEN 3 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END"


def money_texts(s: Silver) -> DataFrame:
    k = col("o_orderkey") % 5
    return s.orders.select("o_orderkey", F.when(k == 0, F.concat(F.lit("£"), col("o_totalprice").cast("long").cast("string"), F.lit(",000"))).when(k == 1, " 0 ").when(k == 2, "n/a").when(k == 4, col("o_orderkey").cast("string")).alias("t"))


def _money_sql(zero: bool) -> str:
    number = "TRY_CAST(regexp_replace(t, '[£,\\s]', '', 'g') AS DOUBLE)"
    return f"SELECT o_orderkey, {'nullif(' + number + ', 0)' if zero else number} AS amount FROM (SELECT o_orderkey, {_MONEY.replace('CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)', 'CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR)')} AS t FROM {{orders}}) x"


@query("num_01", _money_sql(True))
def money(s: Silver) -> DataFrame:
    return money_texts(s).select("o_orderkey", values.money(col("t")).alias("amount"))


@query("num_02", _money_sql(False))
def money_with_zero(s: Silver) -> DataFrame:
    return money_texts(s).select("o_orderkey", values.money(col("t"), zero_is_null=False).alias("amount"))


@query("num_06", "SELECT property_id, CASE WHEN build_year IS NULL THEN NULL WHEN build_year < 1919 THEN 'Pre-1919' WHEN build_year < 1945 THEN '1919-1944' WHEN build_year < 1965 THEN '1945-1964' WHEN build_year < 1981 THEN '1965-1980' WHEN build_year < 2001 THEN '1981-2000' ELSE 'Post-2000' END AS first, CASE WHEN build_year IS NULL THEN NULL WHEN build_year < 1919 THEN 'Pre-1919' WHEN build_year < 1946 THEN '1919-1945' WHEN build_year < 1981 THEN '1946-1980' WHEN build_year < 2001 THEN '1981-2000' ELSE 'Post-2000' END AS dashboard FROM properties")
def age_bands(s: Silver) -> DataFrame:
    return s.properties.select("property_id", bands.age_band(col("build_year"), "first").alias("first"), bands.age_band(col("build_year"), "dashboard").alias("dashboard"))


@query("num_08", "SELECT block_id, CASE WHEN height_max_m IS NULL THEN 'Unknown' WHEN jurisdiction = 'SCO' THEN CASE WHEN height_max_m < 18 THEN '<18m' ELSE '18m+' END WHEN height_max_m < 11 THEN '<11m' WHEN height_max_m < 18 THEN '11-18m' WHEN height_max_m < 30 THEN '18-30m' ELSE '30m+' END AS band FROM blocks")
def height_bands(s: Silver) -> DataFrame:
    return s.blocks.select("block_id", bands.height_band(col("height_max_m"), col("jurisdiction")).alias("band"))


@query("num_10", "SELECT event_id, greatest(0.0, least(1.0, coalesce(value / 100.0, 0.5))) AS share FROM {events}")
def clamp_unit(s: Silver) -> DataFrame:
    return s.events.select("event_id", values.unit_interval(col("value") / 100).alias("share"))


def _grid_sql() -> str:
    """The projection as a chain of tables: footpoint, series, datum shift, latitude on the new ellipsoid."""
    (a, b), (a2, b2) = geo.AIRY, geo.WGS84
    a0, n, e2, f2 = a * geo.SCALE, (a - b) / (a + b), 1 - (b / a) ** 2, 1 - (b2 / a2) ** 2
    d, t = f"(lat - {geo.LAT0})", f"(lat + {geo.LAT0})"
    arc = f"{b * geo.SCALE} * ({1 + n + 1.25 * n**2 + 1.25 * n**3} * {d} - {3 * n + 3 * n**2 + 21 / 8 * n**3} * sin({d}) * cos({t}) + {15 / 8 * (n**2 + n**3)} * sin(2 * {d}) * cos(2 * {t}) - {35 / 24 * n**3} * sin(3 * {d}) * cos(3 * {t}))"
    steps = [f"f0 AS (SELECT uprn, easting * 100 + 400000 AS e, northing * 100 + 300000 AS n, {geo.LAT0} + (northing * 100 + 300000 - {geo.NORTH0}) / {a0} AS lat FROM uprn_points)"]
    steps += [f"f{k} AS (SELECT uprn, e, n, lat + (n - {geo.NORTH0} - {arc}) / {a0} AS lat FROM f{k - 1})" for k in range(1, 5)]
    rx, ry, rz = geo.ROTATION
    k = 1 + geo.GROWTH
    steps += [
        f"s AS (SELECT uprn, lat, e - {geo.EAST0} AS d, tan(lat) AS t, 1 / cos(lat) AS c, {a0} / sqrt(1 - {e2} * sin(lat) ** 2) AS nu, {a0 * (1 - e2)} / (1 - {e2} * sin(lat) ** 2) ** 1.5 AS rho FROM f4)",
        f"p AS (SELECT uprn, lat - t / (2 * rho * nu) * d ** 2 + t / (24 * rho * nu ** 3) * (5 + 3 * t ** 2 + (nu / rho - 1) - 9 * t ** 2 * (nu / rho - 1)) * d ** 4 - t / (720 * rho * nu ** 5) * (61 + 90 * t ** 2 + 45 * t ** 4) * d ** 6 AS phi, {geo.LON0} + c / nu * d - c / (6 * nu ** 3) * (nu / rho + 2 * t ** 2) * d ** 3 + c / (120 * nu ** 5) * (5 + 28 * t ** 2 + 24 * t ** 4) * d ** 5 AS lam FROM s)",
        f"c AS (SELECT uprn, r * cos(phi) * cos(lam) AS x, r * cos(phi) * sin(lam) AS y, r * {1 - e2} * sin(phi) AS z FROM (SELECT p.*, {a} / sqrt(1 - {e2} * sin(phi) ** 2) AS r FROM p) q)",
        f"m AS (SELECT uprn, {geo.SHIFT[0]} + {k} * x - {rz} * y + {ry} * z AS x, {geo.SHIFT[1]} + {rz} * x + {k} * y - {rx} * z AS y, {geo.SHIFT[2]} - {ry} * x + {rx} * y + {k} * z AS z FROM c)",
        f"w0 AS (SELECT uprn, x, y, z, atan2(z, sqrt(x * x + y * y) * {1 - f2}) AS lat FROM m)",
    ]
    steps += [f"w{k} AS (SELECT uprn, x, y, z, atan2(z + {f2 * a2} / sqrt(1 - {f2} * sin(lat) ** 2) * sin(lat), sqrt(x * x + y * y)) AS lat FROM w{k - 1})" for k in range(1, 4)]
    return "WITH " + ", ".join(steps) + " SELECT uprn, round(degrees(lat), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM w3"


@query("num_11", _grid_sql())
def grid_to_degrees(s: Silver) -> DataFrame:
    """A projection; tests hold it against published points too."""
    point = geo.grid_to_degrees(col("easting") * 100 + 400000, col("northing") * 100 + 300000)
    return s.uprn_points.select("uprn", point.alias("p")).select("uprn", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("num_12", "SELECT property_id, CASE WHEN lat BETWEEN 49 AND 61.5 AND lon BETWEEN -8.8 AND 2.2 THEN 'direct' WHEN lon BETWEEN 49 AND 61.5 AND lat BETWEEN -8.8 AND 2.2 THEN 'swapped' END AS source FROM (SELECT property_id, CASE WHEN property_id % 3 = 0 THEN longitude ELSE latitude END AS lat, CASE WHEN property_id % 3 = 0 THEN latitude ELSE longitude END AS lon FROM properties) x")
def coordinate_source(s: Silver) -> DataFrame:
    swap = col("property_id") % 3 == 0
    none = F.lit(None).cast("double")
    point = geo.resolve(F.when(swap, col("longitude")).otherwise(col("latitude")), F.when(swap, col("latitude")).otherwise(col("longitude")), none, none)
    return s.properties.select("property_id", point["source"].alias("source"))


@query("num_13", "SELECT property_id, latitude BETWEEN 49 AND 61 AND longitude BETWEEN -8 AND 2 AS inside FROM properties")
def uk_bounds(s: Silver) -> DataFrame:
    return s.properties.select("property_id", geo.in_uk(col("latitude"), col("longitude"), "schedule").alias("inside"))


@query("num_14", "SELECT property_id, round(sqrt(power(CAST(latitude AS DOUBLE) - 52, 2) + power(CAST(longitude AS DOUBLE) + 2, 2)), 6) AS d FROM properties")
def degrees_apart(s: Silver) -> DataFrame:
    return s.properties.select("property_id", F.round(geo.degree_distance(col("latitude").cast("double"), col("longitude").cast("double"), F.lit(52.0), F.lit(-2.0)), 6).alias("d"))


_MISSING = ("address", "postcode", "uprn", "latitude", "sum_insured", "property_type", "build_year")


@query("num_15", "SELECT property_id, CAST(round((7 - (" + " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in _MISSING) + ")) / 7.0 * 100) AS BIGINT) AS readiness FROM properties")
def readiness(s: Silver) -> DataFrame:
    missing = F.size(F.array_compact(F.array(*(F.when(col(c).isNull(), c) for c in _MISSING))))
    return s.properties.select("property_id", F.round((7 - missing) / F.lit(7.0) * 100).cast("long").alias("readiness"))


@query("num_16", f"SELECT portfolio_id, CAST(greatest(100 - 30 * u - 20 * o - least(2 * d, 20), 0) AS BIGINT) AS score FROM (SELECT portfolio_id, count(CASE WHEN fra_rag IS NULL AND block_id % 40 = 0 THEN 1 END) AS u, count(CASE WHEN {_CURRENT} IS FALSE AND block_id % 60 = 0 THEN 1 END) AS o, CAST(coalesce(sum(CASE WHEN block_id % 30 = 0 THEN overdue_action_count END), 0) AS BIGINT) AS d FROM ({ASSESSED}) a GROUP BY 1) x")
def compliance(s: Silver) -> DataFrame:
    late = col("assessment_valid_until") < F.lit(AS_OF).cast("date")
    per = assessed_blocks(s).groupBy("portfolio_id").agg(F.count_if(col("fra_rag").isNull() & (col("block_id") % 40 == 0)).alias("u"), F.count_if(late & (col("block_id") % 60 == 0)).alias("o"), F.coalesce(F.sum(F.when(col("block_id") % 30 == 0, col("overdue_action_count"))), F.lit(0)).alias("d"))
    return per.select("portfolio_id", scoring.compliance_score(col("u"), col("o"), col("d")).cast("long").alias("score"))


_BOOLS = ("Yes", "true", "NO", "present", "not installed", "maybe", " 1 ", "n/a")


@query("boo_01", "SELECT event_id, CASE WHEN lower(trim(w)) IN ('true','yes','1','present','installed','provided','fitted') THEN TRUE WHEN lower(trim(w)) IN ('false','no','0','not present','not installed','none','n/a') THEN FALSE END AS flag, lower(trim(w)) IN ('yes','true','1','y') AS schedule_flag FROM (SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{b}'" for k, b in enumerate(_BOOLS)) + " END AS w FROM {events}) x")
def booleans(s: Silver) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, _BOOLS)), (col("event_id") % 8 + 1).cast("int"))
    return s.events.select("event_id", values.boolean(word).alias("flag"), values.schedule_boolean(word).alias("schedule_flag"))


# --- dates -----------------------------------------------------------------


@query("dat_01", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM {orders}")
def dates(s: Silver) -> DataFrame:
    """Dates written in four formats by key, parsed back."""
    d, k = col("o_orderdate"), col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "d MMMM yyyy")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.concat(F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMM yyyy"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return s.orders.select("o_orderkey", values.date(text).alias("d"))


@query("dat_05", f"SELECT fra_id, assessment_valid_until >= DATE '{AS_OF}' AS in_date FROM fra_features")
def in_date(s: Silver) -> DataFrame:
    return s.fra_features.select("fra_id", values.in_date(col("assessment_valid_until"), F.lit(AS_OF).cast("date")).alias("in_date"))


@query("dat_06", f"SELECT fra_id FROM fra_features WHERE assessment_valid_until BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + INTERVAL 90 DAY")
def expiring(s: Silver) -> DataFrame:
    return s.fra_features.where(values.expiring(col("assessment_valid_until"), F.lit(AS_OF).cast("date"))).select("fra_id")


@query("dat_07", f"SELECT fra_id, CASE WHEN assessment_valid_until IS NOT NULL THEN 'valid_until' WHEN assessment_date IS NOT NULL THEN 'assessment + 5 years' END AS basis, coalesce(assessment_valid_until, CAST(assessment_date + INTERVAL 60 MONTH AS DATE)) >= DATE '{AS_OF}' AS current FROM fra_features")
def assessment_status(s: Silver) -> DataFrame:
    basis = F.when(col("assessment_valid_until").isNotNull(), "valid_until").when(col("assessment_date").isNotNull(), "assessment + 5 years")
    until = F.coalesce("assessment_valid_until", F.add_months("assessment_date", 60))
    return s.fra_features.select("fra_id", basis.alias("basis"), (until >= F.lit(AS_OF).cast("date")).alias("current"))


@query("dat_08", f"SELECT property_id FROM properties WHERE created_on + INTERVAL 2555 DAY < DATE '{AS_OF}' + INTERVAL 1500 DAY")
def retention(s: Silver) -> DataFrame:
    return s.properties.where(values.retained_until(col("created_on")) < F.date_add(F.lit(AS_OF).cast("date"), 1500)).select("property_id")


@query("dat_09", "SELECT event_id, CAST(least(60 * power(2, event_id % 12), 21600) AS BIGINT) AS wait FROM {events}")
def back_off(s: Silver) -> DataFrame:
    return s.events.select("event_id", values.back_off(col("event_id") % 12 + 1).alias("wait"))


@query("dat_10", "SELECT portfolio_id, make_date(CAST(renewal_year AS BIGINT), 1, 1) AS renewal_date FROM portfolios")
def renewal(s: Silver) -> DataFrame:
    return s.portfolios.select("portfolio_id", F.make_date("renewal_year", F.lit(1), F.lit(1)).alias("renewal_date"))


# --- text, arrays, json ----------------------------------------------------


@query("str_04", "SELECT property_id, nullif(regexp_extract(upper(concat(coalesce(address, ''), ' ', coalesce(postcode, ''))), '([A-Z]{{1,2}}[0-9][A-Z0-9]?\\s*[0-9][A-Z]{{2}})', 1), '') AS postcode FROM properties")
def postcode_extract(s: Silver) -> DataFrame:
    return s.properties.select("property_id", address.postcode(F.concat_ws(" ", F.coalesce("address", F.lit("")), F.coalesce("postcode", F.lit("")))).alias("postcode"))


@query("str_05", "SELECT property_id, CASE WHEN length(p) >= 5 THEN concat(substr(p, 1, length(p) - 3), ' ', right(p, 3)) ELSE p END AS postcode FROM (SELECT property_id, upper(replace(postcode, ' ', '')) AS p FROM properties) x")
def postcode_normal(s: Silver) -> DataFrame:
    return s.properties.select("property_id", address.normal_postcode(col("postcode")).alias("postcode"))


@query("str_06", "SELECT property_id, regexp_matches(upper(postcode), '^[A-Z]{{1,2}}[0-9][0-9A-Z]?\\s[0-9][A-Z]{{2}}$') AS valid FROM properties")
def postcode_valid(s: Silver) -> DataFrame:
    return s.properties.select("property_id", address.valid_postcode(col("postcode")).alias("valid"))


@query("str_08", "SELECT property_id, concat(address, ', Shire') AS cleaned FROM properties WHERE address IS NOT NULL AND postcode IS NOT NULL")
def address_cleaned(s: Silver) -> DataFrame:
    given = F.concat_ws(", ", "address", "postcode", F.lit("Shire"), F.lit("SHIRE"))
    return s.properties.where(col("address").isNotNull() & col("postcode").isNotNull()).select("property_id", address.without_postcode(given, col("postcode")).alias("cleaned"))


@query("str_09", "SELECT property_id, CASE property_id % 3 WHEN 0 THEN concat('0/1, ', address) WHEN 1 THEN concat('Flat 3, ', address) ELSE address END AS standard FROM properties WHERE address IS NOT NULL")
def address_standard(s: Silver) -> DataFrame:
    k = col("property_id") % 3
    given = F.when(k == 0, F.regexp_replace("address", ", Town", " 0/1, Town")).when(k == 1, F.regexp_replace("address", ", Town", ", Flat 3, Town")).otherwise(col("address"))
    return s.properties.where(col("address").isNotNull()).select("property_id", address.standard(given).alias("standard"))


@query("str_12", "SELECT property_id, '3' AS flat, regexp_extract(address, '^([0-9]+)', 1) AS building FROM properties WHERE address IS NOT NULL")
def flat_and_building(s: Silver) -> DataFrame:
    given = F.when(col("property_id") % 2 == 0, F.concat(F.lit("Flat 3, "), "address")).otherwise(F.concat(F.lit("Flat 0/3, "), "address"))
    return s.properties.where(col("address").isNotNull()).select("property_id", address.flat_number(given).alias("flat"), address.building_number(given).alias("building"))


@query("str_14", r"SELECT property_id, CAST(CASE WHEN address IS NULL THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / greatest(len(a), len(b)) END AS DOUBLE) AS overlap FROM (SELECT property_id, address, list_distinct(regexp_extract_all(lower(address), '\w+')) AS a, list_distinct(regexp_extract_all(lower(replace(address, 'Town', '2')), '\w+')) AS b FROM properties) x")
def overlap(s: Silver) -> DataFrame:
    a = F.coalesce(address.tokens(col("address")), F.array().cast("array<string>"))
    b = F.coalesce(address.tokens(F.regexp_replace("address", "Town", "2")), F.array().cast("array<string>"))
    return s.properties.select("property_id", address.token_overlap(a, b).alias("overlap"))


@query("str_18", "SELECT block_id, nullif(concat_ws(', ', CASE WHEN has_combustible_cladding THEN 'cladding' END, CASE WHEN eps_insulation_present THEN 'eps' END, CASE WHEN aluminium_composite_cladding THEN 'acm' END), '') AS flags FROM (" + ASSESSED + ") a")
def flags_text(s: Silver) -> DataFrame:
    kinds = {"cladding": "has_combustible_cladding", "eps": "eps_insulation_present", "acm": "aluminium_composite_cladding"}
    return assessed_blocks(s).select("block_id", F.nullif(F.concat_ws(", ", *(F.when(col(c), n) for n, c in kinds.items())), F.lit("")).alias("flags"))


@query("str_19", f"SELECT event_id, CASE WHEN lower(trim(rating)) NOT IN ({', '.join(repr(w) for w in values.NULL_WORDS)}) THEN trim(rating) END AS v FROM ({_RATINGS_SQL}) r")
def null_words(s: Silver) -> DataFrame:
    return ratings(s).select("event_id", values.text_or_null(col("rating")).alias("v"))


@query("str_24", "SELECT doc_id, sha256(text) AS checksum FROM {documents}")
def checksum(s: Silver) -> DataFrame:
    return s.documents.select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("str_25", "SELECT page_id, regexp_replace(trim(url), '\\s+', ' ', 'g') AS url FROM {pages}")
def whitespace(s: Silver) -> DataFrame:
    return s.pages.select("page_id", F.regexp_replace(F.trim("url"), r"\s+", " ").alias("url"))


@query("arr_01", "SELECT property_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _MISSING) + ") AS missing FROM properties")
def missing_fields(s: Silver) -> DataFrame:
    return s.properties.select("property_id", F.array_join(F.array_compact(F.array(*(F.when(col(c).isNull(), c) for c in _MISSING))), ",").alias("missing"))


@query("arr_02", "SELECT block_id, count(*) AS total, CAST(count(CASE WHEN p = 'high' THEN 1 END) AS BIGINT) AS high, CAST(count(CASE WHEN d < 5 THEN 1 END) AS BIGINT) AS overdue, CAST(count(CASE WHEN d IS NULL THEN 1 END) AS BIGINT) AS undated FROM (SELECT block_id, CASE WHEN property_id % 3 = 0 THEN 'high' ELSE 'low' END AS p, CASE WHEN property_id % 4 = 0 THEN NULL ELSE property_id % 11 END AS d FROM properties) x GROUP BY 1")
def action_counts(s: Silver) -> DataFrame:
    """Counts over an array of action structs per document."""
    action = F.struct(F.when(col("property_id") % 3 == 0, "high").otherwise("low").alias("p"), F.when(col("property_id") % 4 != 0, col("property_id") % 11).alias("d"))
    docs = s.properties.groupBy("block_id").agg(F.collect_list(action).alias("actions"))
    count = lambda f: F.size(F.filter("actions", f)).cast("long")
    return docs.select("block_id", F.size("actions").cast("long").alias("total"), count(lambda a: a["p"] == "high").alias("high"), count(lambda a: a["d"] < 5).alias("overdue"), count(lambda a: a["d"].isNull()).alias("undated"))


@query("set_02", "SELECT doc_id, CAST(CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 0 END AS BIGINT) AS shared FROM {documents}")
def array_sets(s: Silver) -> DataFrame:
    return s.documents.select("doc_id", F.size(F.array_intersect(F.array("lang"), F.array(F.lit("en"), F.lit("fr")))).cast("long").alias("shared"))


@query("map_02", "SELECT property_id, coalesce(CASE WHEN property_id % 2 = 0 THEN 'api' END, epc_rating) AS epc FROM properties")
def merged_priority(s: Silver) -> DataFrame:
    return s.properties.select("property_id", F.coalesce(F.when(col("property_id") % 2 == 0, "api"), "epc_rating").alias("epc"))


@query("jsn_01", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}")
def json_path(s: Silver) -> DataFrame:
    return s.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("jsn_03", "SELECT event_id, CAST(event_id % 10 AS BIGINT) AS a, event_id % 2 = 0 AS b FROM {events}")
def json_repair(s: Silver) -> DataFrame:
    """Fenced, trailing-comma and Python-literal JSON, parsed after repair."""
    from groundplan.operators.validate import repaired_json

    broken = F.concat(F.lit('Result: ```json\n{"a": '), (col("event_id") % 10).cast("string"), F.lit(', "b": '), F.when(col("event_id") % 2 == 0, "True").otherwise("False"), F.lit(", }\n``` done"))
    return s.events.select("event_id", F.from_json(repaired_json(broken), "a long, b boolean").alias("j")).select("event_id", "j.a", "j.b")


# --- graphs ----------------------------------------------------------------


@query("grf_01", "WITH RECURSIVE sides AS (SELECT source_id AS a, target_id AS z FROM lineage UNION SELECT target_id, source_id FROM lineage), reach(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT sides.z, r.depth + 1 FROM reach r JOIN sides ON sides.a = r.node WHERE r.depth < 9), near AS (SELECT DISTINCT node FROM reach) SELECT DISTINCT source_id, target_id FROM lineage WHERE source_id IN (SELECT node FROM near) OR target_id IN (SELECT node FROM near)")
def lineage_closure(s: Silver) -> DataFrame:
    return graph.closure(s.lineage.select("source_id", "target_id"), 0, 10).select("source_id", "target_id")


@query("grf_02", "SELECT source_id, target_id, step FROM lineage WHERE source_id = 5 OR target_id = 5")
def one_hop(s: Silver) -> DataFrame:
    return s.lineage.where("source_id = 5 or target_id = 5").select("source_id", "target_id", "step")


@query("grf_03", "SELECT node, min(role) AS role FROM (SELECT source_id AS node, 'source' AS role FROM lineage UNION ALL SELECT target_id, 'target' FROM lineage) x GROUP BY 1")
def nodes(s: Silver) -> DataFrame:
    both = s.lineage.select(col("source_id").alias("node"), F.lit("source").alias("role")).unionByName(s.lineage.select(col("target_id").alias("node"), F.lit("target").alias("role")))
    return both.groupBy("node").agg(F.min("role").alias("role"))


_PARENTS = "SELECT event_id AS child, CASE WHEN event_id < 10 THEN NULL ELSE CAST(floor(event_id / 4.0) AS BIGINT) END AS parent FROM {events}"


@query("grf_04", f"WITH p AS ({_PARENTS}) SELECT a.child, coalesce(e.parent, d.parent, c.parent, b.parent, a.parent, a.child) AS root FROM p a LEFT JOIN p b ON b.child = a.parent LEFT JOIN p c ON c.child = b.parent LEFT JOIN p d ON d.child = c.parent LEFT JOIN p e ON e.child = d.parent")
def hierarchy(s: Silver) -> DataFrame:
    parents = s.events.select(col("event_id").alias("child"), F.when(col("event_id") >= 10, F.floor(col("event_id") / 4.0)).alias("parent"))
    return graph.roots(parents).select("child", "root")


@query("grf_05", f"WITH p AS ({_PARENTS}) SELECT root, count(*) AS members FROM (SELECT coalesce(e.parent, d.parent, c.parent, b.parent, a.parent, a.child) AS root FROM p a LEFT JOIN p b ON b.child = a.parent LEFT JOIN p c ON c.child = b.parent LEFT JOIN p d ON d.child = c.parent LEFT JOIN p e ON e.child = d.parent) x GROUP BY 1")
def block_grouping(s: Silver) -> DataFrame:
    return hierarchy(s).groupBy("root").agg(F.count("*").alias("members"))


# --- type detection --------------------------------------------------------


@query("typ_02", "SELECT round(count(CASE WHEN length(regexp_replace(uprn, '[^0-9]', '', 'g')) = 12 THEN 1 END) * 1.0 / count(uprn), 6) AS uprn, round(count(CASE WHEN upper(epc_rating) IN ('A','B','C','D','E','F','G') THEN 1 END) * 1.0 / count(epc_rating), 6) AS epc, round(count(CASE WHEN build_year BETWEEN 1900 AND 2100 THEN 1 END) * 1.0 / count(build_year), 6) AS build_year FROM properties")
def shares(s: Silver) -> DataFrame:
    found = detect.scores(s.properties.select("uprn", "epc_rating", col("build_year").cast("string").alias("build_year")), thresholds=False)
    of = lambda c, k: F.round(F.max(F.when(col("column") == c, col(k))), 6)
    return found.agg(of("uprn", "uprn").alias("uprn"), of("epc_rating", "epc_rating").alias("epc"), of("build_year", "year").alias("build_year"))


_TYPED = ("uprn", "postcode", "address", "epc_rating", "latitude", "longitude", "build_year", "property_type", "created_on")
_IN = lambda words: "lower(v) IN (" + ", ".join(f"'{w}'" for w in words) + ")"
#: The detectors in SQL; a share is taken of numbers for the last three.
_DETECTORS = {
    "postcode": r"regexp_full_match(upper(v), '[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}')", "uprn": r"length(regexp_replace(v, '\D', '', 'g')) = 12", "address": rf"regexp_matches(lower(v), '{detect.STREETS}') AND regexp_matches(v, '\d')", "numeric_id": "TRY_CAST(v AS DOUBLE) IS NOT NULL",
    "boolean": _IN(detect.BOOLEANS), "city": _IN(detect.CITIES), "region": _IN(detect.REGIONS), "house_type": _IN(detect.HOUSE_TYPES), "epc_rating": _IN("abcdefg"),
    "year": "TRY_CAST(v AS DOUBLE) BETWEEN 1900 AND 2100", "latitude": "TRY_CAST(v AS DOUBLE) BETWEEN 49 AND 61", "longitude": "TRY_CAST(v AS DOUBLE) BETWEEN -8 AND 2",
}
_DATES = {"%Y-%m-%d": r"\d{4}-\d\d-\d\d", "%d/%m/%Y": r"\d\d/\d\d/\d{4}", "%m/%d/%Y": r"\d\d/\d\d/\d{4}", "%d-%m-%Y": r"\d\d-\d\d-\d{4}", "%Y/%m/%d": r"\d{4}/\d\d/\d\d", "%d.%m.%Y": r"\d\d\.\d\d\.\d{4}", "%Y%m%d": r"\d{8}"}
_SHARES = {k: f"count(CASE WHEN {p} THEN 1 END) * 1.0 / nullif({'count(TRY_CAST(v AS DOUBLE))' if k in ('year', 'latitude', 'longitude') else 'count(v)'}, 0)" for k, p in _DETECTORS.items()}
_SHARES["date"] = "greatest(" + ", ".join(f"count(CASE WHEN regexp_full_match(v, '{shape}') AND try_strptime(v, '{form}') IS NOT NULL THEN 1 END) * 1.0 / nullif(count(v), 0)" for form, shape in _DATES.items()) + ")"
_SHARES["categorical"] = "CASE WHEN count(DISTINCT v) * 1.0 / nullif(count(v), 0) <= 0.05 THEN 1 - count(DISTINCT v) * 1.0 / count(v) ELSE 0 END"
_TYPES_SQL = "WITH cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, trim(CAST({c} AS VARCHAR)) AS v FROM properties" for c in _TYPED) + "), raw AS (SELECT c, " + ", ".join(f"coalesce({_SHARES[k]}, 0) AS {k}" for k in detect.THRESHOLDS) + " FROM cells GROUP BY 1), kept AS (SELECT c, " + ", ".join(f"CASE WHEN {k} >= {t} THEN {k} ELSE 0 END AS {k}" for k, t in detect.THRESHOLDS.items()) + f" FROM raw), best AS (SELECT kept.*, greatest({', '.join(detect.THRESHOLDS)}) AS best FROM kept) SELECT c AS \"column\", CASE WHEN latitude > 0.8 THEN 'latitude' WHEN longitude > 0.8 THEN 'longitude' " + " ".join(f"WHEN {k} = best AND best > 0 THEN '{k}'" for k in detect.THRESHOLDS) + " ELSE 'unknown' END AS detected_type, round(CASE WHEN latitude > 0.8 THEN latitude WHEN longitude > 0.8 THEN longitude ELSE best END, 6) AS confidence FROM best"
_TYPES_SQL = _TYPES_SQL.replace("{", "{{").replace("}", "}}")


@query("typ_13", _TYPES_SQL)
def column_types(s: Silver) -> DataFrame:
    """Detected type and confidence of each column."""
    return detect.types(s.properties.select(*_TYPED))


@query("typ_14", "SELECT event_id, CASE WHEN contains(n, 'fraew') THEN 'fraew_document' WHEN contains(n, 'fra') THEN 'fra_document' WHEN contains(n, 'schedule') OR contains(n, 'sov') THEN 'property_schedule' ELSE 'unknown' END AS kind FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'block_fraew.pdf' WHEN 1 THEN 'site fra 2024.pdf' WHEN 2 THEN 'sov_final.xlsx' ELSE 'notes.txt' END AS n FROM {events}) x")
def file_kinds(s: Silver) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("block_fraew.pdf", "Site FRA 2024.pdf", "SOV_final.xlsx", "notes.txt"))), (col("event_id") % 4 + 1).cast("int"))
    return s.events.select("event_id", detect.file_kind(name).alias("kind"))


