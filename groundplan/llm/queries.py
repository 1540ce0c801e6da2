"""The registered queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from groundplan.llm import collocations, decontaminate, jaccard_join, language_id, license_scan, media, negatives, packing, quality, repeats, simhash, url_filter, warc

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_url_filter": url_filter.query,
    "op3_media": media.query,
    "op4_quality": quality.query,
    "op5_language_id": language_id.query,
    "op6_packing": packing.query,
    "op7_decontaminate": decontaminate.query,
    "op8_warc": warc.query,
    "op9_license_scan": license_scan.query,
    "op10_suffix_dedup": repeats.query,
    "op11_hard_negatives": negatives.query,
    "op12_jaccard_join": jaccard_join.query,
    "op13_collocations": collocations.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_license_scan": license_scan.ORACLE_SQL,
    "op11_hard_negatives": negatives.ORACLE_SQL,
    "op12_jaccard_join": jaccard_join.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
