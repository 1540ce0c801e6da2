"""The 46 fields of safety case reports, as columns over one text column.

Fields are tables of patterns, phrases and ordered choices; what is computed from them
(bands, fallbacks, spelling) is added on top. No field needs more than built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POSTCODE = r"[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}"
_DAY = r"(\d{2}[/-]\d{2}[/-]\d{4})"
_LETTERS = r"MIFSM|AIFireE|MIFireE|FIFireE|GIFireE|TechIFireE|CMIOSH"
#: Fixed patterns: the first that fits gives the field by its group, in any case but where marked.
PATTERNS = {
    "building_name": (r"building\s+name[:\s]+([A-Za-z0-9\s,\-()]+?)(?:\n|address|uprn)", r"block[:\s]+([A-Za-z0-9\s\-()]+(?:Court|House|Tower|Block))"),
    "building_address": (rf"address[:\s]+([A-Za-z0-9\s,\-]+?(?:Road|Street|Lane|Avenue|Close|Drive|Way)[^.]*?{_POSTCODE})", rf"(\d+\s+[A-Za-z\s]+(?:Road|Street|Lane|Avenue),?\s*[A-Za-z\s]+,?\s*{_POSTCODE})"),
    "uprn_labeled": (r"UPRN[:\s]+([A-Z0-9]+)",),
    "building_height_metres": (r"(?:building\s+)?height[:\s]+(\d+(?:\.\d+)?)\s*(?:m|metres?)",),
    "number_of_storeys": (r"(\d+)\s+(?:storey|floor)s?(?:\s+building)?", r"(?:number\s+of\s+)?(?:storey|floor)s?[:\s]+(\d+)"),
    "construction_year": (r"(?:built|constructed|construction\s+year)[:\s]+(\d{4})", r"completed\s+(?:in\s+)?(\d{4})"),
    "total_units": (r"(\d+)\s+(?:units?|flats?|apartments?)",),
    "safety_case_version": (r"version[:\s]+([0-9.]+)",),
    "safety_case_date": (rf"(?:issue\s+date|document\s+date|date)[:\s]+{_DAY}", rf"dated[:\s]+{_DAY}"),
    "principal_accountable_person": (r"(?:principal\s+accountable\s+person|pap)[:\s]+([A-Za-z\s]+?)(?:\n|address|telephone)",),
    "building_safety_manager": (r"(?:building\s+safety\s+manager|bsm)[:\s]+([A-Za-z\s]+?)(?:\n|address|telephone)",),
    "accountable_person_entity": (r"(?:accountable\s+person|managing\s+agent)[:\s]+([A-Za-z0-9\s]+(?:Heart|Group|Limited|Ltd|Association))", r"(Midland\s+Heart|Entity\s+Group|[A-Za-z]+\s+Housing)"),
    "fra_type": (r"(?:fra\s+)?type[:\s]+(\d+)",),
    "fra_date": (rf"(?:fra|fire\s+risk\s+assessment)\s+date[:\s]+{_DAY}",),
    "fra_assessor": (r"(?:fra\s+)?assessor[:\s]+([A-Za-z\s]+?)(?:\n|mifsm|credentials)",),
    "fra_peer_reviewer": (r"(?:peer\s+)?reviewer[:\s]+([A-Za-z\s]+?)(?:\n|mifsm|credentials)",),
    "evacuation_strategy_description": (r"evacuation\s+strategy[:\s]+([^.]+\.)",),
    "fire_alarm_system_type": (r"(?:fire\s+alarm|bs\s*5839)[:\s]*(?:pt\s*1)?[:\s]*(l[0-5]|grade\s*[a-d])",),
    "smoke_detection_type": (r"(?:smoke\s+detection|bs\s*5839)[:\s]*(?:pt\s*6)?[:\s]*(l[0-5])",),
    "construction_type": (r"(?:construction|structure)\s+type[:\s]+([A-Za-z\s]+?)(?:\n|floor|wall)", r"(reinforced\s+concrete|masonry|steel\s+frame|timber\s+frame)"),
    "cladding_type": (r"cladding\s+(?:type|material)[:\s]+([A-Za-z\s]+?)(?:\n|status|safe)", r"(ACM|HPL|timber\s+cladding|brick\s+slip|render)"),
}
#: Fixed patterns of names that stand for the building, of references and of contacts.
NAMED = r"(?:crocodile|aura|tower|court)\s+(?:court|house|tower|block)\s*\(?([A-Za-z0-9\s]*)\)?"
TITLED = r"safety\s+case\s+report\s+(?:for\s+)?([A-Za-z0-9\s,\-()]+?)(?:\n|address|version)"
REGISTERED, NUMBERED = r"(?:bsr\s+registration|hrb)[:\s]*([A-Z0-9]{10,15})", r"\b(HRB[A-Z0-9]{8,12})\b"
REFERENCE = r"(?:building\s+ref(?:erence)?|block\s+(?:id|code))[:\s]+([A-Z0-9]+)"
CONTACTS = {"fire_safety": r"fire\s+safety[^@]*?(\S+@\S+\.\S+)", "building_safety": r"building\s+safety[^@]*?(\S+@\S+\.\S+)", "emergency": r"emergency[^@]*?(\S+@\S+\.\S+)"}
#: Fixed phrases: a field is true if the text has one of them.
PHRASES = {
    "personal_evacuation_plans_required": ("personal evacuation plan", "peep"), "dry_riser_present": ("dry riser",), "wet_riser_present": ("wet riser",), "sprinklers_present": ("sprinkler",),
    "aov_present": ("aov", "automatic opening vent"), "emergency_lighting_present": ("emergency lighting",), "premises_information_box_present": ("premises information box", "pib"),
    "building_control_certificate": ("building control certificate", "completion certificate"), "structural_issues_identified": ("structural issue", "structural concern", "structural defect"),
    "gas_detectors_present": ("gas detector", "gas monitor"), "lightning_protection_present": ("lightning protection",), "bsa_2022_applicable": ("building safety act", "bsa 2022"),
    "mandatory_occurrence_reporting_in_place": ("mandatory occurrence report", "mor"), "resident_engagement_strategy_present": ("resident engagement", "customer engagement"),
}
#: Fixed choices: the first value one of whose phrases the text has.
CHOICES = {
    "building_type": (("HRRB", ("higher-risk residential building", "hrrb")), ("RESIDENTIAL", ("residential",))),
    "evacuation_strategy": (("FULL_EVACUATION", ("full evacuation",)), ("STAY_PUT", ("stay put", "stay-put")), ("SIMULTANEOUS", ("simultaneous evacuation",)), ("PHASED", ("phased evacuation",)), ("DEFEND_IN_PLACE", ("defend in place",))),
    "cladding_status": (("safe", ("cladding safe", "no acm")), ("remediation_required", ("cladding removal", "remediation"))),
    "fire_compartmentation_status": (("present", ("compartmentation",)),),
}
#: Least metres and least storeys of a band.
HEIGHTS = (("HIGH_RISE", 18, 7), ("MEDIUM_RISE", 11, 4), ("LOW_RISE", 0, 0))


def _first(text: Column, *patterns: str, flags: str = "(?i)") -> Column:
    """The trimmed group of the first pattern that fits; null without one."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, flags + p, 1), r"^\s+|\s+$", "")), F.lit("")) for p in patterns))


def _has(low: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | low.contains(p)
    return found


def _iso(day: Column) -> Column:
    """dd/MM/yyyy as yyyy-MM-dd, without a look at the calendar."""
    return F.regexp_replace(day, r"^(\d{2})[/-](\d{2})[/-](\d{4})$", "$3-$2-$1")


def fields(text: Column) -> dict[str, Column]:
    """Name to column of all 46 fields; a null text gives null."""
    low = F.lower(text)
    found = {name: _first(text, *patterns) for name, patterns in PATTERNS.items()}
    # a name such as "Aura Court (B)" stands for the building by what is in brackets, or by itself
    named = F.coalesce(_first(text, NAMED), F.nullif(F.trim(F.regexp_extract(text, "(?i)" + NAMED, 0)), F.lit("")))
    spelled = F.regexp_replace(F.coalesce(found["building_name"], named), "([a-z])([A-Z])", "$1 $2")
    found["building_name"] = F.coalesce(spelled, _first(text, TITLED))
    found["bsr_registration_number"] = F.coalesce(F.upper(_first(text, REGISTERED)), _first(text, NUMBERED, flags=""))
    labelled = found["uprn_labeled"]
    found["building_reference"] = F.when(labelled.isNotNull() & ~labelled.rlike(r"^\d{12}$"), labelled).otherwise(_first(text, REFERENCE))
    found["uprns"] = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b\d{12}\b"), 0)))
    for name, kind in (("building_height_metres", "double"), ("number_of_storeys", "int"), ("construction_year", "int"), ("total_units", "int")):
        found[name] = found[name].try_cast(kind)
    height, storeys = found["building_height_metres"], found["number_of_storeys"]
    band = lambda value, k: F.coalesce(*(F.when((value >= row[k]) & (value > 0), row[0]) for row in HEIGHTS))
    found["height_category"] = F.coalesce(band(height, 1), band(storeys, 2))
    found["safety_case_date"], found["fra_date"] = _iso(found["safety_case_date"]), _iso(found["fra_date"])
    found["fra_type"] = F.concat(F.lit("Type "), found["fra_type"])
    found["fire_alarm_system_type"] = F.concat(F.lit("BS 5839 pt1: "), F.upper(found["fire_alarm_system_type"]))
    found["smoke_detection_type"], found["cladding_type"] = F.upper(found["smoke_detection_type"]), F.upper(found["cladding_type"])
    found["construction_type"] = F.initcap(found["construction_type"])
    letters = rf"({_LETTERS})[,\s]*({_LETTERS})*"
    found["fra_assessor_credentials"] = F.nullif(F.concat_ws(" ", F.nullif(F.regexp_extract(text, letters, 1), F.lit("")), F.nullif(F.regexp_extract(text, letters, 2), F.lit(""))), F.lit(""))
    found |= {name: _has(low, phrases) for name, phrases in PHRASES.items()}
    found["firefighters_lift_present"] = low.contains("firefighter") & low.contains("lift")
    found |= {name: F.coalesce(*(F.when(_has(low, phrases), value) for value, phrases in rows)) for name, rows in CHOICES.items()}
    contacts = F.array_compact(F.array(*(F.when(_first(text, p).isNotNull(), F.struct(F.lit(k).alias("type"), F.lower(_first(text, p)).alias("email"))) for k, p in CONTACTS.items())))
    found["key_contacts"] = F.when(F.size(contacts) > 0, contacts)
    return found
