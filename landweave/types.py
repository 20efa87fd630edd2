"""Schemas and fixed vocabularies of the land-record model."""

from __future__ import annotations

# Vocabularies and constants of the data model.
EXPECTED_FIELDS = ("village", "district", "tehsil", "khasra")
OPTIONAL_FIELDS = ("village", "district", "tehsil", "khasra", "parcel_type")
MERGED_FIELDS = ("ulpin", "district", "district_code", "village", "village_code", "tehsil", "tehsil_code", "block", "pargana", "khasra", "parcel_type", "area", "development_status", "remarks")
SEVERITY_PENALTY = {"critical": 0.5, "high": 0.3, "medium": 0.15, "low": 0.05, "info": 0.0}
CHANNEL_WEIGHTS = {"model": 0.35, "geometric": 0.25, "attribute": 0.2, "source": 0.1, "temporal": 0.1}
STAGES = ("validation", "crs", "geometry", "candidate_matching", "parcel_matching", "entity_resolution", "anomaly_detection", "building_extraction", "change_detection", "provenance", "export")
TEXT_FIELDS = ("village", "district", "khasra", "tehsil", "block", "pargana")
FIELD_ALIASES = {
    "village": ("village", "vill_name", "vname_e", "vname_h"),
    "district": ("district",),
    "khasra": ("khasra", "sno"),
    "tehsil": ("tehsil", "tahsil"),
    "block": ("block", "block_name", "block_name_1"),
    "pargana": ("pargana",),
    "village_code": ("village_code", "vill_code", "village_co", "ccode11"),
    "district_code": ("district_code", "district_c", "dtcode11"),
    "tehsil_code": ("tehsil_code", "tehsil_cod"),
    "area": ("area", "area_srs", "area_decim"),
    "parcel_type": ("parcel_type", "par_type"),
    "remarks": ("remarks",),
}
#: Keys under which a canonical field may arrive, in order; the first present one counts, even if null there.
CANONICAL_KEYS = {
    "ulpin": ("ulpin", "unique_land_parcel_id"),
    "village": ("village",),
    "village_code": ("village_code",),
    "district": ("district",),
    "district_code": ("district_code",),
    "tehsil": ("tehsil",),
    "tehsil_code": ("tehsil_code",),
    "block": ("block",),
    "pargana": ("pargana",),
    "khasra": ("khasra",),
    "parcel_type": ("parcel_type",),
    "area": ("area",),
    "development_status": ("status", "development_status"),
    "remarks": ("remarks",),
    "source_timestamp": ("source_timestamp", "timestamp", "observed_at"),
    "confidence": ("confidence",),
}


class LandRecordError(Exception):
    """Base of all errors of the engine."""


class InvalidInput(LandRecordError):
    """A source that cannot be read or does not have the required form."""


class CrsError(LandRecordError):
    """A coordinate system that is unknown where one is needed."""
