"""Exact-identity linkage, field merge without a winner, conflicts, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions.text import norm_link

_SEP = "|"


def identity_key(source: str = "source_id", record: str = "record_id") -> Column:
    """ulpin if not blank; else district, village, tehsil, khasra if none is blank; else the record itself."""
    u = norm_link(F.col("ulpin"))
    parts = [norm_link(F.col(c)) for c in ("district", "village", "tehsil", "khasra")]
    whole = F.lit(True)
    for p in parts:
        whole = whole & (p != "")
    return F.when(u != "", F.concat_ws(_SEP, F.lit("ulpin"), u)).when(whole, F.concat_ws(_SEP, F.lit("cadastral"), *parts)).otherwise(F.concat_ws(_SEP, F.lit("source-record"), F.col(source), F.col(record)))


def with_identity(records: DataFrame) -> DataFrame:
    return records.withColumn("identity_key", identity_key())


def observed_values(records: DataFrame, fields: list[str], group: str = "identity_key") -> DataFrame:
    """(group, field, values, n_values, value): distinct normalised values in order of first sight; value only if there is one."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = records.select(group, "row_ix", F.explode(cells).alias("c")).select(group, "row_ix", "c.field", "c.value").filter("value is not null and trim(value) <> ''")
    firsts = long.groupBy(group, "field", norm_link(F.col("value")).alias("norm")).agg(F.min("row_ix").alias("at"), F.min_by("value", "row_ix").alias("value"))
    merged = firsts.groupBy(group, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
    return merged.select(group, "field", "values", F.size("values").alias("n_values"), F.when(F.size("values") == 1, F.col("values")[0]).alias("value"))


def conflict_rows(records: DataFrame, fields: list[str], group: str = "identity_key") -> DataFrame:
    """Disagreeing fields as conflicts: kind and severity by field, unresolved, no value selected."""
    rows = observed_values(records, fields, group).filter("n_values > 1")
    kind = F.when(F.col("field") == "ulpin", "identity_conflict").otherwise("attribute_conflict")
    severity = F.when(F.col("field") == "ulpin", "critical").when(F.col("field").isin("district", "village", "khasra"), "high").otherwise("medium")
    return rows.select(group, "field", "values", kind.alias("conflict_type"), severity.alias("severity"), F.lit("Requires review").alias("status"), F.lit("unresolved").alias("resolution_status"), F.lit(None).cast("string").alias("selected_value"))


def missing_attribute_rows(records: DataFrame, group: str = "identity_key") -> DataFrame:
    """One low conflict for every record and missing district, village or khasra."""
    gaps = F.filter(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in ("district", "village", "khasra")]), lambda x: x.isNotNull())
    return records.select(group, "source_id", "record_id", F.explode(gaps).alias("field")).withColumns({"conflict_type": F.lit("missing_attribute"), "severity": F.lit("low")})


def merge_groups(records: DataFrame, fields: list[str], group: str = "identity_key") -> DataFrame:
    """One row per group: merged fields (null where values disagree), counts, representative and lineage lists in row order."""
    values = observed_values(records, fields, group)
    wide = values.groupBy(group).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    ordered = F.array_sort(F.collect_list(F.struct("row_ix", "source_id", "record_id")))
    base = records.groupBy(group).agg(F.count(F.lit(1)).alias("record_count"), F.count_distinct("source_id").alias("source_count"), F.min("row_ix").alias("first_row"), F.min_by("record_id", "row_ix").alias("representative"), F.transform(ordered, lambda x: F.concat_ws(":", x["source_id"], x["record_id"])).alias("source_records"))
    return base.join(wide, group, "left")


def output_crs(records: DataFrame) -> DataFrame:
    """EPSG:4326 if every geometry has a coordinate system, else null."""
    return records.agg(F.when(F.every(F.col("geometry").isNull() | F.col("crs").isNotNull()), "EPSG:4326").alias("output_crs"))


def resolution(groups: DataFrame, evidence: DataFrame, group: str = "identity_key") -> DataFrame:
    """Method, reason and least match confidence of every group (evidence: group, decision, confidence)."""
    conf = evidence.groupBy(group).agg(F.min(F.when(F.col("decision") == "match", F.col("confidence"))).alias("confidence"), F.count_if(F.col("decision") == "match").alias("n_matches"))
    method = F.when(F.coalesce("n_matches", F.lit(0)) > 0, "model_assisted").when(F.col(group).startswith("ulpin"), "exact_ulpin").when(F.col(group).startswith("cadastral"), "exact_cadastral").otherwise("single_source")
    reason = F.when(F.coalesce("n_matches", F.lit(0)) > 0, "linked by scored candidates").when(F.col("record_count") > 1, "exact identifiers agree").otherwise("no second record")
    return groups.join(conf, group, "left").select(group, "record_count", "source_count", method.alias("matching_method"), reason.alias("resolution_reason"), "confidence")


def link_decision(decisions: Column, error: Column) -> Column:
    """linked if some model decided and all that did say match; skipped after an error; else review."""
    known = F.filter(decisions, lambda d: d.isNotNull())
    return F.when(error, "skipped").when((F.size(known) > 0) & F.forall(known, lambda d: d == "match"), "linked").otherwise("review")
