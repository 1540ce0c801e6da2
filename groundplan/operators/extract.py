"""Field extraction from document text: ordered patterns per field, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"(\d{1,2}(?:st|nd|rd|th)?\s+[a-z]+\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{4})"
#: Fixed patterns of external wall appraisals: field to patterns, the first that fits wins.
FRAEW = {
    "pas_9980_version": (r"pas\s*9980[:\s]*(\d{4})",),
    "building_risk_rating": (r"risk\s+rating[^.]*?(?:is\s+)?(?:therefore\s+)?(?:considered\s+)?(?:as\s+)?(high|medium|low)", r"rated\s+as[:\s]*(high|medium|low)\s+risk"),
    "building_name": (r"property\n([a-z0-9 ]+?)(?:,|\n)", r"property[:\s]+([a-z]+(?:court|house|tower|building|place|square))"),
    "job_reference": (r"(?:job\s*(?:nr|no|number|ref)|reference)[:\s\n]+(\d+[-a-z0-9]*)",),
    "client_name": (r"client[:\s]+([a-z0-9 ]+(?:limited|ltd|llp|plc))",),
    "assessment_date": (rf"(?:date\s+of\s+(?:inspection|assessment|survey))[:\s]+{DATE}",),
    "building_height_m": (r"(\d{1,3}(?:\.\d+)?)\s*(?:m|metres|meters)\s+(?:high|in\s+height|tall)", r"height[^.]{0,30}?(\d{1,3}(?:\.\d+)?)\s*(?:m\b|metres)"),
    "num_storeys": (r"(\d{1,2})\s*(?:no\.?\s*)?(?:storeys|stories|storey)",),
    "interim_measures": (r"(interim\s+measures\s+(?:are\s+)?(?:required|necessary|recommended))",),
    "clause_14": (r"(clause\s+14)",),
    "postcode": (r"\b([a-z]{1,2}\d[a-z\d]?\s*\d[a-z]{2})\b",),
}
#: Fixed patterns of fire risk assessments.
FRA = {
    "risk_rating": (r"(?:overall\s+)?(?:fire\s+)?risk\s+(?:rating|level)[:\s]+([a-z ]+?)(?:\n|\.|$)", r"considered\s+to\s+be[:\s]+(trivial|tolerable|moderate|substantial|intolerable)"),
    "assessment_date": (rf"(?:date\s+of\s+(?:fra|assessment|inspection))[:\s]+{DATE}",),
    "next_review_date": (rf"(?:next\s+review|review\s+date)[^\d]{{0,20}}{DATE}",),
    "assessment_type": (r"\b(type\s+[1-4])\b",),
    "assessor_name": (r"(?:assessor|assessed\s+by|carried\s+out\s+by)[:\s]+([a-z]+\s+[a-z]+)",),
    "responsible_person": (r"responsible\s+person[:\s]+([a-z ]+?)(?:\n|\.|$)",),
    "evacuation_strategy": (r"(stay\s*put|simultaneous|phased|temporary)\s+evacuation|evacuation\s+(?:strategy|policy)[:\s]+(?:stay\s*put|simultaneous|phased)", r"(stay\s*put)\s+(?:policy|strategy)"),
    "num_storeys": (r"(\d{1,2})\s*(?:storeys|stories|floors)",),
    "num_units": (r"(\d{1,4})\s*(?:flats|units|apartments|dwellings)",),
    "build_year": (r"(?:built|constructed)\s+(?:in|circa|c\.?)\s*(\d{4})",),
    "smoke_detection": (r"((?:no\s+)?(?:smoke|fire)\s+detection)",),
    "fire_doors": (r"((?:no\s+)?fire\s+doors?)",),
    "sprinklers": (r"((?:no\s+)?sprinklers?)",),
    "emergency_lighting": (r"((?:no\s+)?emergency\s+lighting)",),
    "compartmentation": (r"(compartmentation)",),
    "client_name": (r"client[:\s]+([a-z0-9 ]+(?:limited|ltd|llp|plc|association|council))",),
    "postcode": (r"\b([a-z]{1,2}\d[a-z\d]?\s*\d[a-z]{2})\b",),
}

def fields(text: Column, patterns: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """The first match of each field's patterns in the lower-cased text, trimmed; null without one."""
    low = F.lower(text)
    return {name: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(low, p, 1)), F.lit("")) for p in given)) for name, given in patterns.items()}


def wall_types(text: Column) -> Column:
    """(type number, name) of each wall type heading; of a repeated number the first."""
    low = F.lower(text)
    pattern = r"wall\s+type\s+(\d+)[:\s\-]+([a-z ]+?)(?:\s*[-–]\s*summary|\n)"
    found = F.transform(F.regexp_extract_all(low, F.lit(pattern), 0), lambda m: F.struct(F.regexp_extract(m, pattern, 1).cast("int").alias("number"), F.initcap(F.trim(F.regexp_extract(m, pattern, 2))).alias("name")))
    numbers = F.transform(found, lambda w: w["number"])
    return F.filter(found, lambda w, k: F.array_position(numbers, w["number"]) == k + 1)


def layout_errors(pages: Column) -> Column:
    """Errors of an array of pages (width, height, words of bbox x0, x1, top, bottom)."""
    words = F.flatten(F.transform(pages, lambda p: p["words"]))
    flag = lambda p, n: F.when(p, n)
    return F.array_compact(
        F.array(
            flag(pages.isNull() | (F.size(pages) <= 0), "pages missing or empty"),
            flag(F.exists(words, lambda w: w["x0"].isNull() | w["x1"].isNull() | w["top"].isNull() | w["bottom"].isNull()), "word box missing"),
            flag(F.exists(words, lambda w: (w["x1"] < w["x0"]) | (w["bottom"] < w["top"])), "word box inverted"),
            flag(F.exists(pages, lambda p: F.exists(p["words"], lambda w: (w["x0"] < -1) | (w["x1"] > p["width"] + 1))), "word outside page"),
        )
    )


def sections(text: Column, starts: dict[str, str], budget: int) -> Column:
    """A text cut to ``budget`` characters by sections: a share of it each, from where the section's heading stands."""
    shares = {"head": 0.15, "actions": 0.65, "findings": 0.10, "tail": 0.10}
    at = {n: F.instr(F.lower(text), w) for n, w in starts.items()}
    part = lambda n: F.when(at[n] > 0, F.substr(text, at[n], F.lit(int(budget * shares[n])))).otherwise("") if n in at else F.lit("")
    head, tail = F.left(text, F.lit(int(budget * shares["head"]))), F.right(text, F.lit(int(budget * shares["tail"])))
    return F.when(F.length(text) <= budget, text).otherwise(F.concat_ws("\n", head, part("actions"), part("findings"), tail))
