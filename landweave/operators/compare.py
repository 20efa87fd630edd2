"""Pairwise comparison of records by rules, confidence of a result, conflicts from topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions.numeric import clip01, product, weighted_geometric_mean
from landweave.functions.text import norm_conflict
from landweave.types import CHANNEL_WEIGHTS, SEVERITY_PENALTY

IOU_AGREES, IOU_HIGH, AREA_TOLERANCE = 0.9, 0.5, 0.05


def area_conflict(a: Column, b: Column, unit_a: Column, unit_b: Column) -> Column:
    """units if both are stated and differ; area beyond the tolerance of the larger; else null."""
    apart = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))
    return F.when(F.lower(F.trim(unit_a)) != F.lower(F.trim(unit_b)), "unit").when(apart > AREA_TOLERANCE, "area")


def compare_pairs(pairs: DataFrame) -> DataFrame:
    """Conflicts of record pairs with columns suffixed _a and _b: key, system, crs, iou, ulpin, parcel_id, district, village,
    khasra, parcel_type, area, area_unit. Geometry is judged only where both systems are stated and equal."""

    def a(c: str) -> Column:
        return F.col(f"{c}_a")

    def b(c: str) -> Column:
        return F.col(f"{c}_b")

    def rule(when: Column, kind: str, severity: Column | str, field: str) -> Column:
        s = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(kind).alias("conflict_type"), s.alias("severity"), F.lit(field).alias("field")))

    def differs(c: str) -> Column:
        x, y = norm_conflict(a(c)), norm_conflict(b(c))
        return (x != "") & (y != "") & (x != y)

    same_crs = F.upper(F.trim(a("crs"))) == F.upper(F.trim(b("crs")))
    undeclared = a("crs").isNull() | b("crs").isNull()
    area = area_conflict(a("area"), b("area"), a("area_unit"), b("area_unit"))
    rules = [
        rule(undeclared, "crs_conflict", "high", "crs"),
        rule(~undeclared & ~same_crs, "crs_conflict", "medium", "crs"),
        rule(same_crs & (F.col("iou") < IOU_AGREES), "geometry_conflict", F.when(F.col("iou") < IOU_HIGH, "high").otherwise("medium"), "geometry"),
        rule(differs("ulpin"), "identity_conflict", "critical", "ulpin"),
        rule((a("system") == b("system")) & differs("parcel_id"), "identity_conflict", "high", "parcel_id"),
        *[rule(differs(c), "attribute_conflict", "high" if c != "parcel_type" else "low", c) for c in ("district", "village", "khasra", "parcel_type")],
        rule(F.coalesce(area.isNotNull(), F.lit(False)), "attribute_conflict", "medium", "area"),
        *[rule(F.coalesce(F.trim(s(c)), F.lit("")) == "", "missing_attribute", "medium", f"{c}{tag}") for c in ("district", "village", "khasra") for s, tag in ((a, "_a"), (b, "_b"))],
    ]
    found = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return pairs.select("key_a", "key_b", F.explode(found).alias("c")).select("key_a", "key_b", "c.conflict_type", "c.severity", "c.field")


def topology_conflicts(issues: DataFrame) -> DataFrame:
    """Topology issues as conflicts: overlaps are geometry conflicts, all others topology errors; medium where unrated."""
    return issues.withColumns({"conflict_type": F.when(F.col("issue_type") == "overlap", "geometry_conflict").otherwise("topology_error"), "severity": F.coalesce("severity", F.lit("medium"))})


def penalty(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, value in SEVERITY_PENALTY.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def confidence(df: DataFrame, channels: dict[str, str], severities: str) -> DataFrame:
    """Add base, factor, final and the list of missing channels.

    ``channels`` maps the five channel names to columns (null: missing, outside 0..1: an error); ``severities`` is an array
    of severities of unresolved conflicts. No channel at all gives null.
    """
    unknown = set(channels) - set(CHANNEL_WEIGHTS)
    if unknown:
        raise ValueError(f"unknown channels: {sorted(unknown)}")
    checked = {n: F.when(F.col(c).between(0, 1) | F.col(c).isNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{n} must lie between 0 and 1")).cast("double")) for n, c in channels.items()}
    base = weighted_geometric_mean([(checked[n], CHANNEL_WEIGHTS[n]) for n in channels])
    factor = product(F.transform(F.coalesce(F.col(severities), F.array().cast("array<string>")), lambda s: 1 - penalty(s)))
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for n, c in channels.items()]), lambda x: x.isNotNull())
    return df.withColumns({"base_confidence": base, "conflict_factor": factor, "missing_channels": missing}).withColumn("final_confidence", clip01(F.col("base_confidence") * F.col("conflict_factor")))


def agreement(matched: Column, conflicting: Column) -> Column:
    """Share of compared attributes that agree; null when none was compared."""
    return F.try_divide(matched, matched + conflicting)
