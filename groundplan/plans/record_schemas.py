"""The record schemas that uploads and properties are checked against, put together from one line a field."""

from __future__ import annotations


def _text(*allowed: str, pattern: str | None = None) -> dict:
    return {"type": "string"} | ({"enum": list(allowed)} if allowed else {}) | ({"pattern": pattern} if pattern else {})


def _number(least: float | None = None, most: float | None = None, kind: str = "number") -> dict:
    return {"type": kind} | ({} if least is None else {"minimum": least}) | ({} if most is None else {"maximum": most})


def _whole(least: float | None = None, most: float | None = None) -> dict:
    return _number(least, most, "integer")


# The fields of records, and what each may hold.
_TENURES = ("Rented", "Owner Occupied", "Shared Ownership", "Leasehold", "Freehold", "Private Rent", "Student")
_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y", "%Y%m%d")
_TYPES = ("postcode", "uprn", "date", "address", "numeric_id", "categorical", "boolean", "year", "latitude", "longitude", "city", "region", "house_type", "epc_rating")
_REGIONS = ("Scotland", "England", "Wales", "Northern Ireland", "London", "North East", "North West", "Yorkshire and the Humber", "East Midlands", "West Midlands", "East of England", "South East", "South West")
_BUILDINGS = ("Apartment", "Terraced", "Semi-Detached", "Detached", "High-Rise Flat", "Tenement Flat", "Terraced House", "Semi-Detached House", "Bungalow", "Cottage", "Maisonette", "Duplex", "Studio", "Villa", "Townhouse")
PROPERTY = {
    "type": "object", "required": ["id"],
    "properties": {
        "id": {"type": "integer"}, "uprn": {"type": ["string", "integer"], "pattern": "^[0-9]{12}$"},
        **{k: _text() for k in ("address", "address1", "address2", "address3", "city")}, "region": _text(*_REGIONS),
        "postcode": _text(pattern=r"^[A-Z]{1,2}[0-9]{1,2}[A-Z]?\s*[0-9][A-Z]{2}$"), "lat": _number(49, 61), "lon": _number(-8, 2),
        "buildYear": _whole(1800, 2100), "type": _text(*_BUILDINGS), "propertyType": _text(), "tenure": _text(*_TENURES), "occupancyType": _text(*_TENURES),
        **{k: _text() for k in ("landlord", "clientName", "policyReference")}, "productType": _text("Social Housing Property", "High value student / mixed use", "Residential Property"),
        "propertyReference": _text(), "blockReference": _text(), "epcRating": _text(*"ABCDEFG"), "lastClaimDate": _text(pattern=r"^\d{4}-\d{2}-\d{2}$"),
        "claimFrequency": _number(0), "riskBand": _text("Low", "Medium", "High", "Very High", ""), "deprivationIndex": _number(0, 10), "floodScore": _number(0, 1), "crimeIndex": _number(0, 10),
        "expectedSeverity": _number(0), "purePremium": _number(0), "maintenanceScore": _number(0, 10), "voidDaysLastYear": _whole(0), "numberOfUnits": _whole(1),
        "sumInsured": _number(0), "sumInsuredType": _text("Reinstatement", "Declared value", "Market value"), **{k: _number(0) for k in ("deductible", "floodDeductible", "stormDeductible")},
        "deductibleBasis": _text("Each and every loss", "Per occurrence", "Aggregate"), **{k: _text() for k in ("avidPropertyType", "wallConstruction", "roofConstruction", "floorConstruction")},
        "ageBanding": _text(pattern=r"^\d{4}-\d{4}$"), "numberOfBedrooms": _whole(0), "numberOfStoreys": _whole(1), "basementLocation": _text(), "listedBuilding": _text("Not listed", "Grade I", "Grade II", "Grade II*"),
        **{k: _text() for k in ("securityFeatures", "fireProtection", "alarms")}, "floodInsured": {"type": "boolean"}, "stormInsured": {"type": "boolean"}, "docBRef": _text(),
        "singleLocationOrPortfolio": _text("Single location within programme", "Part of portfolio"), "floorsAboveGround": _whole(0), "floorsBelowGround": _whole(0),
        **{k: _text() for k in ("claddingType", "ewsStatus", "fireRiskManagementSummary", "evacuationStrategy")},
    },
    "additionalProperties": False,
}
STANDARDIZED = {
    "type": "object", "additionalProperties": True,
    "properties": {
        "id": {"type": ["integer", "string"]}, "uprn": {"type": ["string", "integer"]}, **{k: _text() for k in ("address", "city", "postcode")}, "buildYear": {"type": ["integer", "string"]},
        **{k: _text() for k in ("type", "tenure", "landlord", "epcRating", "lastClaimDate")}, "claimFrequency": {"type": ["number", "string"]}, "riskBand": _text(),
    },
}
UPLOAD_RESPONSE = {
    "type": "object", "required": ["success", "message", "columns", "data", "row_count"], "additionalProperties": False,
    "properties": {
        "success": {"type": "boolean"}, "message": _text(), "columns": {"type": "array", "items": _text()}, "data": {"type": "array", "items": {"type": "object", "additionalProperties": True}},
        "column_mapping": {"type": "object", "additionalProperties": _text()}, "row_count": _whole(0), "original_filename": _text(),
    },
}
DETECTION = {
    "type": "object", "additionalProperties": False,
    "patternProperties": {
        "^.*$": {
            "type": "object", "required": ["detected_type", "confidence", "all_scores"], "additionalProperties": False,
            "properties": {
                "detected_type": _text(*_TYPES, "unknown"), "confidence": _number(0, 1), "all_scores": {"type": "object", "properties": {t: _number(0, 1) for t in _TYPES}, "additionalProperties": False},
                "format": _text(*_FORMATS), "is_sequential": {"type": "boolean"}, "unique_count": _whole(0),
            },
        }
    },
}
