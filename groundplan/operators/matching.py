"""Traffic lights for address matches: ordered rules over numbers, tokens and similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.functions import address as a
from groundplan.operators import similar
from groundplan.operators.lineage_cut import cut

CAP = 0.30


def traffic_lights(df: DataFrame) -> DataFrame:
    """Adds ``level``, ``confidence`` and ``reason`` to rows of given, matched, os_match, parent_uprn, parent_address.

    All that only looks at addresses is computed once for each distinct set of the three,
    and joined to the rows; the rules are one ordered CASE.
    """
    c = F.col
    texts = ["given", "matched", "parent_address"]
    held = {f"_{k}": F.coalesce(k, F.lit("")) for k in texts} | {"_nulls": F.concat(*(c(k).isNull().cast("string") for k in texts))}
    keyed = df.withColumns(held)
    distinct = cut(keyed.select(*texts, *held).distinct())
    alike = similar.with_segment_share(similar.with_ratio(distinct, a.normal(c("given")), a.normal(c("matched")), "_sim"), c("given"), c("matched"), "_seg")
    alike = similar.with_ratio(alike, a.normal(c("given")), a.normal(c("parent_address")), "_to_parent")
    signals = alike.withColumns(
        {
            "_gb": a.building_number(c("given")), "_mb": a.building_number(c("matched")), "_gf": a.flat_number(c("given")), "_mf": a.flat_number(c("matched")),
            "_gflat": a.has_flat_token(c("given")), "_mflat": a.has_flat_token(c("matched")), "_named": c("given").rlike(r"(?i)\b(block|building|tower|wing|phase|stair|entrance)\s+\d+\b"),
            "_street": a.token_overlap(a.street_tokens(c("given")), a.street_tokens(c("matched"))), "_subset": F.size(F.array_except(a.tokens(c("matched")), a.tokens(c("given")))) == 0,
            "_gp": F.regexp_replace(a.postcode(c("given")), " ", ""), "_mp": F.regexp_replace(a.postcode(c("matched")), " ", ""),
            "_parent": F.when(c("parent_address").isNotNull(), F.greatest(c("_to_parent"), a.token_overlap(a.tokens(c("given")), a.tokens(c("parent_address"))))),
        }
    ).drop(*texts)
    signals = similar.with_texts(keyed, signals, list(held)).withColumn("_sub", F.coalesce(F.trim(c("parent_uprn")) != "", F.lit(False)))
    os, sim = c("os_match"), c("_sim")
    differ = lambda x, y: F.coalesce(c(x) != c(y), F.lit(False))
    aligned = c("_gflat") == c("_mflat")
    only_matched = c("_mb").isNotNull() & c("_gb").isNull()
    lone = ~c("_gflat") & c("_sub")
    implied = lone & F.coalesce(c("_gb") == c("_mf"), F.lit(False)) & (os >= 0.7) & (c("_street") >= 0.6) & ~c("_named")
    same_format = (os >= 0.7) & F.coalesce((c("_gb") == c("_mb")) & (c("_gf") == c("_mf")), F.lit(False)) & (c("_street") >= 0.6)
    #: The rules in order, their limits, levels and reasons.
    rules = [
        (differ("_gb", "_mb"), "RED", None, "building_number_mismatch"), (differ("_gf", "_mf"), "RED", None, "flat_number_mismatch"),
        (os == 1.0, "GREEN", F.greatest(os, F.lit(0.95)), "exact_match"), ((os >= 0.8) & (sim >= 0.8) & aligned & ~only_matched, "GREEN", os, "good_match_aligned"),
        ((os >= 0.8) & (sim >= 0.85) & aligned & c("_subset"), "GREEN", os, "good_match_input_has_extra_descriptors"), (same_format, "GREEN", F.greatest(os, F.lit(0.8)), "format_mismatch_same_property"),
        (implied, "GREEN", os, "implicit_flat_number_matches"), (lone & ~c("_mflat") & ~only_matched & (c("_seg") >= 0.9), "GREEN", F.greatest(os, F.lit(0.75)), "segment_match_same_property"),
        (lone & F.coalesce(c("_parent") >= 0.6, F.lit(False)), "AMBER", F.lit(0.5), "parent_uprn_resolves_to_building"), (lone, "RED", None, "missing_flat_parent_mismatch"),
        (differ("_gp", "_mp"), "RED", None, "postcode_mismatch"), (sim < 0.4, "RED", None, "low_address_similarity"), ((os >= 0.8) & (sim < 0.5), "RED", None, "high_os_score_low_similarity"),
        (os < 0.7, "RED", None, "low_os_match"), (aligned & (sim >= 0.5) & (c("_street") >= 0.6) & ~only_matched, "GREEN", os, "moderate_match_aligned"),
    ]
    pick = lambda level, confidence, reason: F.struct(F.lit(level).alias("level"), F.round(confidence if confidence is not None else F.least(os, F.lit(CAP)), 3).alias("confidence"), F.lit(reason).alias("reason"))
    found = pick("RED", None, "uncertain_match")
    for p, *rest in reversed(rules):
        found = F.when(p, pick(*rest)).otherwise(found)
    return signals.withColumn("_light", found).select(*df.columns, "_light.level", "_light.confidence", "_light.reason")
