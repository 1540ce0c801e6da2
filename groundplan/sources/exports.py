"""Sinks: schedules with fixed columns, GeoJSON, metadata patches, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings and the columns behind them; None is filled by the insurer.
SCHEDULE_A = (
    ("Client Name", "ha_name"), ("Start Date", None), ("End Date", None), ("Policy Reference", None), ("Product Type", None), ("Property Reference", "property_reference"), ("Block Reference", "block_reference"), ("Occupancy Type", "occupancy_type"), ("Deductible", "deductible"), ("Flood Deductible", None),
    ("Storm Deductible", None), ("Basis of Deductible (EEL/SEC)", "basis_of_deductible"), ("Address 1", "address"), ("Address 2", "address_2"), ("Address 3", "address_3"), ("Postcode", "postcode"), ("Number of Units", "units"), ("Sum Insured", "sum_insured"), ("Sum Insured Type", "sum_insured_type"),
    ("Property Type", "property_type"), ("Avid Property Type", "avid_property_type"), ("Wall Construction", "wall_construction"), ("Roof Construction", "roof_construction"), ("Floor Construction", "floor_construction"), ("Year of Build", "year_of_build"), ("Age Banding", "age_banding"), ("Number of Bedrooms", "num_bedrooms"),
    ("Number of Storeys", "storeys"), ("Basement location", "basement"), ("Listed building (if blank = not listed)", "is_listed"), ("Security Features", "security_features"), ("Fire Protection", "fire_protection"), ("Alarms", "alarms"), ("Flood insured", "flood_insured"), ("Storm insured", "storm_insured"), ("UPRN", "uprn"),
    ("UPRN Confidence", "uprn_confidence"), ("UPRN Confidence Reason", "uprn_confidence_reason"), ("Height (metres)", "height_max_m"), ("Building Footprint (m²)", "building_footprint_m2"), ("EPC Rating", "epc_rating"), ("Listed Grade", "listed_grade"), ("Flood Risk Band", "flood_risk_band"), ("Flood Risk Source", "flood_risk_source"),
    ("Enrichment Status", "enrichment_status"), ("Enrichment Source", "enrichment_source"),
)


#: Questions of the second schedule and the columns that answer them; None is answered by the insurer or not held.
SCHEDULE_B = (
    ("Asset Type", "asset_type"),
    ("Q1 Policy number", None), ("Q2 Cover Commencement Date", None), ("Q3 Single location or portfolio?", None), ("Q4 Insured Type", None), ("Q5 Insured Name", None), ("Q6 Managing Agent?", None), ("Q7 GWP for building", None), ("Q8 Fire Deductible", None),
    ("Q9 Block Name/Reference", "block_reference"), ("Q10 Address Line 1", "address"), ("Q11 Address Line 2", "address_2"), ("Q12 Postcode", "postcode"), ("Q13 Sum Insured", "sum_insured"), ("Q14 LOR/AA/ICOW", "lor_value"), ("Q15 Total Insured Value", "total_insured_value"),
    ("Q16 Storeys above ground", "storeys"), ("Q17 Height (metres)", "height_max_m"), ("Q18 Basement flats present", "basement"), ("Q19 Property Type", "property_type"), ("Q20 Occupancy Type", "occupancy_type"), ("Q21 Is block unoccupied?", None), ("Q22 Number of units", "units"),
    ("Q23 Date of build", "build_year"), ("Q24 Date of refurb", None), ("Q25 Refurbishment ongoing?", None), ("Q26 Listed building?", "is_listed"), ("Q27 Asylum seekers present?", None),
    ("Q28 Wall Construction", "wall_construction"), ("Q29 Floor construction", "floor_construction"), ("Q30 Roof construction", "roof_construction"), ("Q31 Timber Framed", None),
    ("Q32 Date of last FRA", "fra_date"), ("Q33 FRA Report Shared with Insurers?", None), ("Q34 Sprinklers in common parts?", "sprinklers_common"), ("Q35 Sprinklers in Flats?", None), ("Q36 Fire Alarms in common parts?", "fire_alarms_common"), ("Q37 Fire Alarms in Flats?", None), ("Q38 Waking watch in place?", None),
    ("Q39 Other fire protection precautions?", "other_fire_protection"), ("Q40 Security measures in place?", None),
    ("Q41 Combustible materials present?", "combustible_materials"), ("Q42 Which part contains combustibles?", None), ("Q43 Details of combustibles", None), ("Q44 Is remediation work required?", "remediation_required"), ("Q45 Reasons if no remediation", None), ("Q46 Remediation status", None),
    ("Q47 Remediation details", "interim_measures_detail"), ("Q48 Remediation completion date", None), ("Q49 Cladding present?", "cladding_present"), ("Q50 % external walls covered", None), ("Q51 Type of cladding", None), ("Q52 Cladding combustibility rating (A-E)", None), ("Q53 Insulation Type", "insulation_type"),
    ("Q54 Insulation Combustibility Rating (A-E)", None), ("Q55 Date EWS fitted", None), ("Q56 Does EWS require remediation?", "ews_remediation_required"), ("Q57 EWS remediation plan", None), ("Q58 EWS remediation date", None),
    ("Q59 Number of fire claims", None), ("Q60 Incurred fire claims amount", None), ("Q61 Number of EOW claims", None), ("Q62 Incurred EOW claims amount", None), ("Q63 Incurred all claims amount", None), ("Q64 Additional Comments", None),
)


def schedule(df: DataFrame, columns: tuple = SCHEDULE_A) -> DataFrame:
    """The columns by their headings, in order; those that ``df`` lacks are empty."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(heading) for heading, c in columns))


def write_schedule(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """CSV part files, rows by ``order`` in each and across them."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True)


def features(df: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature per row with coordinates; the other rows get none."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(feature).alias("feature"))


def patched(metadata: Column, patch: Column) -> Column:
    """A map with the entries of another put over its own."""
    return F.map_concat(F.map_filter(metadata, lambda k, _: ~F.array_contains(F.map_keys(patch), k)), patch)
