"""Harmonisation jobs: merged features with geometry, conflicts and lineage; the job store, its exports and the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators.link import conflict_rows, observed_values
from landweave.operators.reproject import reproject
from landweave.types import FIELD_ALIASES, InvalidInput


def source_key(source: str = "source_id", record: str = "record_id") -> Column:
    return F.concat_ws(":", source, record)


def merged_features(records: DataFrame, fields: list[str], group: str = "identity_key") -> DataFrame:
    """One feature per group: merged fields (null where values disagree), geometry in EPSG:4326, conflicts and lineage lists.

    ``geometry`` is that of the group's first record, null where its system is unknown. ``conflicts`` holds the disagreeing
    fields with all their values; ``source_records``, ``source_ids``, ``source_types`` and ``original_attributes`` hold one entry per
    record in row order. Columns ``source_type`` and ``raw_attributes`` may be missing. Large groups are summed map-side.
    """
    has = set(records.columns)
    kind = F.col("source_type") if "source_type" in has else F.lit(None).cast("string")
    raw = F.to_json("raw_attributes") if "raw_attributes" in has else F.lit(None).cast("string")
    lines = F.array_sort(F.collect_list(F.struct("row_ix", source_key().alias("record"), "source_id", kind.alias("source_type"), raw.alias("raw"))))
    base = records.groupBy(group).agg(
        F.count(F.lit(1)).alias("record_count"), F.count_distinct("source_id").alias("source_count"), F.min("row_ix").alias("first_row"), lines.alias("l"), F.min_by(F.struct("geometry", "crs"), "row_ix").alias("g"),
    )
    lists = (("source_records", "record"), ("source_ids", "source_id"), ("source_types", "source_type"), ("original_attributes", "raw"))
    base = base.select(group, "record_count", "source_count", "first_row", *[F.col(f"l.{c}").alias(n) for n, c in lists], F.col("g.geometry").alias("__shape"), F.col("g.crs").alias("__crs"))
    base = reproject(base, "__shape", "__crs", 4326).drop("__shape", "__crs")
    values = observed_values(records, fields, group)
    wide = values.groupBy(group).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    clashes = conflict_rows(records, fields, group).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("field", "conflict_type", "severity", "values", "status", "resolution_status"))).alias("conflicts"))
    return base.join(wide, group, "left").join(clashes, group, "left").withColumn("conflicts", F.coalesce("conflicts", F.array().cast(clashes.schema["conflicts"].dataType)))


def linked_ulpin(records: DataFrame, group: str = "identity_key") -> DataFrame:
    """(group, ulpin, ulpin_source, ulpin_disagreements): the first identifier in row order with the record it comes from, and all where several differ."""
    own = F.when(F.trim("ulpin") != "", F.trim("ulpin"))
    rows = records.select(group, "row_ix", own.alias("u"), source_key().alias("key"))
    per = rows.groupBy(group).agg(F.min_by(F.struct("u", "key"), F.when(F.col("u").isNotNull(), F.col("row_ix"))).alias("first"), F.array_sort(F.collect_set("u")).alias("all"))
    return per.select(group, F.col("first.u").alias("ulpin"), F.when(F.col("first.u").isNotNull(), F.col("first.key")).alias("ulpin_source"), F.when(F.size("all") > 1, F.col("all")).otherwise(F.array().cast("array<string>")).alias("ulpin_disagreements"))


def model_inputs(records: DataFrame, attributes: str, fields: list[str] | None = None) -> DataFrame:
    """Add one column per model field: the attribute under the first of the field's aliases that is present, even if null there; '' without any."""

    def value(field: str) -> Column:
        out: Column = F.lit("")
        for key in reversed(FIELD_ALIASES.get(field, (field,))):
            out = F.when(F.map_contains_key(attributes, key), F.try_element_at(attributes, F.lit(key))).otherwise(out)
        return out

    return records.withColumns({f: value(f) for f in (fields or list(FIELD_ALIASES))})


def feature_json(features: DataFrame, group: str = "identity_key") -> DataFrame:
    """(feature_id, feature): GeoJSON text of every merged feature; all columns but the geometry are its properties."""
    properties = [c for c in features.columns if c != "geometry"]
    text = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.struct(F.col(group).alias("i"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(group).alias("i")))) - 6), F.lit(',"geometry":'), F.coalesce("geometry", F.lit("null")), F.lit(',"properties":'), F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}), F.lit("}"))
    return features.select(F.col(group).alias("feature_id"), text.alias("feature"))


def provenance_rows(features: DataFrame, group: str = "identity_key") -> DataFrame:
    """(record_id, provenance, model_evidence, source_records, resolution_reason, processing_timestamp) of every merged feature."""
    have = set(features.columns)

    def column(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string").alias(name)

    return features.select(F.col(group).alias("record_id"), *[column(c).alias(c) for c in ("provenance", "model_evidence", "source_records", "resolution_reason", "processing_timestamp")])


class JobStore:
    """Jobs below a folder: one partition of features and one of conflicts per job, and one row about the job."""

    PARTS = ("features", "conflicts")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, job_id: str, source_ids: list[str], features: DataFrame, conflicts: DataFrame, status: str = "completed", created_at: str | None = None) -> None:
        """Write the job's tables, then its row: a job without a row was never finished. A repeated id replaces the job."""
        for part, df in zip(self.PARTS, (features, conflicts), strict=True):
            df.write.mode("overwrite").parquet(f"{self.path}/{part}/job={job_id}")
        n_features, n_conflicts = (self.spark.read.parquet(f"{self.path}/{part}/job={job_id}").count() for part in self.PARTS)
        row = self.spark.createDataFrame([(job_id, status, source_ids, n_features, n_conflicts)], "job_id string, status string, source_ids array<string>, feature_count long, conflict_count long")
        row.withColumn("created_at", F.coalesce(F.lit(created_at).cast("timestamp"), F.current_timestamp())).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/jobs/job={job_id}")

    def jobs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/jobs").drop("job")

    def get(self, job_id: str, part: str = "features") -> DataFrame:
        path = f"{self.path}/{part}/job={job_id}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            raise InvalidInput(f"job {job_id!r} not found")
        return self.spark.read.parquet(path)

    def export(self, job_id: str, fmt: str, group: str = "identity_key") -> DataFrame:
        """(value): the lines of an export: geojson (one feature a line), csv (header first), conflicts or provenance (one JSON object a line)."""
        if fmt == "geojson":
            return feature_json(self.get(job_id), group).select(F.col("feature").alias("value"))
        if fmt == "conflicts":
            rows = self.get(job_id, "conflicts")
            return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
        if fmt == "provenance":
            return provenance_rows(self.get(job_id), group).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        if fmt == "csv":
            features = self.get(job_id)
            names = sorted(features.columns)
            cells = [F.coalesce(F.to_json(c) if not _plain(features, c) else F.col(c).cast("string"), F.lit("")) for c in names]
            quoted = [F.when(c.contains(",") | c.contains('"') | c.contains("\n"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
            header = self.spark.createDataFrame([(",".join(names),)], "value string")
            return header.unionByName(features.select(F.concat_ws(",", *quoted).alias("value")))
        raise InvalidInput(f"unsupported export format {fmt!r}")


def _plain(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString().split("<")[0] not in ("array", "map", "struct")


def dashboard_totals(records: DataFrame, jobs: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row: sources, features, parcels merged, conflicts, jobs, average confidence, healthy sources, warnings, status of the last job.

    ``records``: source_id, confidence; ``jobs``: as JobStore.jobs(); ``warnings``: source_id, one row per warning. Every
    figure is a partial sum; the frames are put side by side by a constant key, one row each.
    """
    a = records.agg(F.count_distinct("source_id").alias("registered_sources"), F.count(F.lit(1)).alias("total_features"), F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("average_confidence")).withColumn("k", F.lit(1))
    last = F.max_by(F.struct("status", "source_ids"), F.struct("created_at", "job_id"))
    b = jobs.agg(F.coalesce(F.sum("feature_count"), F.lit(0)).alias("harmonized_parcels"), F.coalesce(F.sum("conflict_count"), F.lit(0)).alias("conflicts"), F.count(F.lit(1)).alias("processing_jobs"), last.alias("l"))
    b = b.select("harmonized_parcels", "conflicts", "processing_jobs", F.coalesce("l.status", F.lit("PENDING")).alias("processing_status"), F.coalesce("l.source_ids", F.array().cast("array<string>")).alias("recent_activity"), F.lit(1).alias("k"))
    warned = records.sparkSession.createDataFrame([], "source_id string") if warnings is None else warnings
    c = warned.agg(F.count(F.lit(1)).alias("warning_count"), F.count_distinct("source_id").alias("__warned")).withColumn("k", F.lit(1))
    return a.join(b, "k").join(c, "k").withColumn("healthy_sources", F.col("registered_sources") - F.col("__warned")).drop("k", "__warned")
