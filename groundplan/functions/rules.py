"""Ordered rule cascades: a table of (pattern, value), first match wins, as one CASE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str | None]]


def cascade(text: Column, rules: Rules, fallback: str | None = None) -> Column:
    """The value of the first pattern found in the text, which is trimmed and lower-cased; null for null and blank."""
    word = F.lower(F.trim(text))
    found = F.lit(fallback)
    for pattern, value in reversed(rules):
        found = F.when(word.rlike(pattern), F.lit(value)).otherwise(found)
    return F.when(word != "", found)


def cascade_sql(text: str, rules: Rules, fallback: str | None = None) -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    cases = " ".join(f"WHEN regexp_matches(lower(trim({text})), '{p.replace(chr(39), chr(39) * 2)}') THEN {quoted(v)}" for p, v in rules)
    return f"CASE WHEN {text} IS NULL OR trim({text}) = '' THEN NULL {cases} ELSE {quoted(fallback)} END".replace("{", "{{").replace("}", "}}")


def keywords(text: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """The name of the first keyword list with a word that the lower-cased text contains."""
    word = F.lower(F.trim(text))
    found = F.lit(other)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | word.contains(w)
        found = F.when(hit, name).otherwise(found)
    return F.when(word != "", found)


def keywords_sql(text: str, rules: Sequence[tuple[str, Sequence[str]]], other: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules)
    return f"CASE WHEN {text} IS NULL OR trim({text}) = '' THEN NULL {cases} ELSE '{other}' END"


#: Ratings of fire risk assessments, in order of test.
FRA_RULES: Rules = (
    (r"^(n/?a|not\s+assessed|not\s+applicable|not\s+available|unknown|not\s+stated|tbc|tbd|none|[-–—]+)$", None),
    (r"\btolerable\b.{0,30}\b(but|with\s+actions|with\s+improvements|must\s+reduce)\b", "AMBER"),
    (r"\bno\s+significant\b", "GREEN"),
    (r"\bbroadly\s+satisfactory\b", "GREEN"),
    (r"\badequately\s+controlled\b", "GREEN"),
    (r"\bvery\s+high\b", "RED"),
    (r"\bvery\s+low\b", "GREEN"),
    (r"\bsignificant\s+risk\b", "AMBER"),
    (r"\bgrade\s+[de]\b|^[de]$", "RED"),
    (r"\bgrade\s+c\b|^c$", "AMBER"),
    (r"\bgrade\s+[ab]\b|^[ab]$", "GREEN"),
    (r"^[45](\s*/\s*\d)?$", "RED"),
    (r"^3(\s*/\s*\d)?$", "AMBER"),
    (r"^[12](\s*/\s*\d)?$", "GREEN"),
    (r"\b(intolerable|substantial|critical|extreme|severe|urgent|immediate)\b", "RED"),
    (r"\bhigh\b", "RED"),
    (r"\bpriority\s*1\b", "RED"),
    (r"\b(moderate|medium)\b", "AMBER"),
    (r"\bmust\s+reduce\b|\brequires\s+attention\b", "AMBER"),
    (r"\bpriority\s*2\b", "AMBER"),
    (r"\b(trivial|negligible|minor|acceptable)\b", "GREEN"),
    (r"\blow\b", "GREEN"),
    (r"\btolerable\b", "GREEN"),
    (r"\bpriority\s*3\b", "GREEN"),
)
#: Ratings of external wall appraisals, in order of test.
FRAEW_RULES: Rules = (
    (r"^(n/?a|not\s+assessed|not\s+applicable|not\s+available|unknown|not\s+stated|tbc|tbd|none|[-–—]+)$", None),
    (r"\bno\s+(further|remedial)\s+action\b", "GREEN"),
    (r"\btolerable\b.{0,40}\b(but|with\s+recommendations|with\s+concerns|further\s+action)\b", "AMBER"),
    (r"\bfurther\s+(action|assessment|investigation)\b", "AMBER"),
    (r"\bbroadly\s+acceptable\b", "GREEN"),
    (r"\bnot\s+acceptable\b", "RED"),
    (r"\b(high|intolerable|unacceptable|extreme|critical|severe)\b", "RED"),
    (r"\b(medium|moderate|significant)\b", "AMBER"),
    (r"\b(low|tolerable|acceptable|negligible)\b", "GREEN"),
)
#: Dwelling forms and their keywords, in order of test.
DWELLING_FORMS = (
    ("bungalow", ("bungalow",)),
    ("maisonette", ("maisonette",)),
    ("house", ("shared house", "house", "detached", "terrace", "semi")),
    ("sheltered", ("sheltered",)),
    ("garage", ("garage",)),
    ("mixed_use", ("mixed",)),
    ("commercial", ("retail", "shop", "office", "commercial", "industrial", "community")),
    ("infrastructure", ("drainage", "services", "organisation")),
    ("flat", ("flat", "apartment", "studio", "tenement", "deck access", "main door", "multiple residential", "bedsit")),
)
NON_DWELLINGS = ("garage", "infrastructure", "commercial")
NO_ASSESSMENT_ALONE = ("house", "bungalow")


def fra_rating(text: Column) -> Column:
    return cascade(text, FRA_RULES, "AMBER")


def fraew_rating(text: Column) -> Column:
    return cascade(text, FRAEW_RULES, "AMBER")


def dwelling_form(property_type: Column, built_form: Column) -> Column:
    return F.coalesce(keywords(property_type, DWELLING_FORMS, "other"), keywords(built_form, DWELLING_FORMS, "other"))


def is_standalone(form: Column, block_reference: Column) -> Column:
    """False in a block, true for a house or bungalow without one, else unknown."""
    return F.when(F.trim(block_reference) != "", False).when(form.isin(*NO_ASSESSMENT_ALONE), True)


def fra_requirement(form: Column, standalone: Column) -> Column:
    exempt = form.isin(*NON_DWELLINGS) | (form.isin(*NO_ASSESSMENT_ALONE) & standalone)
    return F.when(exempt, "not_required").when(form.isNull() | standalone.isNull(), "unknown").otherwise("required")
