"""The engine's entry points: ingest, harmonise, compare, topology, score, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators import canonical, catalog, compare, components, features, jobs, link, spatial_join, topology
from landweave.operators.catalog import Catalog
from landweave.operators.reproject import reproject
from landweave.sources.readers import check_upload, read_geojson_text, reader_for
from landweave.types import MERGED_FIELDS, STAGES, InvalidInput


@dataclass(frozen=True)
class Ingested:
    """Valid canonical records, the invalid rows with their errors, and the statistics of the source."""

    records: DataFrame
    rejected: DataFrame
    statistics: DataFrame


@dataclass(frozen=True)
class Harmonised:
    features: DataFrame
    conflicts: DataFrame
    missing: DataFrame
    candidates: DataFrame | None
    stages: DataFrame


class Engine:
    """All operators over one catalogue folder."""

    def __init__(self, spark: SparkSession, catalog_path: str):
        self.spark, self.catalog = spark, Catalog(spark, catalog_path)
        self.jobs = jobs.JobStore(spark, f"{catalog_path.rstrip('/')}.jobs")

    def ingest(self, path: str, source_type: str = "other", source_crs: str | None = None, register: bool = True) -> Ingested:
        check_upload(path)
        reader = reader_for(path)
        extra = {} if path.lower().endswith((".kml", ".gpkg")) else {"source_crs": source_crs}
        return self._ingested(reader(self.spark, path, source_type=source_type, **extra), register)

    def ingest_payload(self, payload: str, name: str, source_type: str = "other", source_crs: str | None = None, register: bool = True) -> Ingested:
        return self._ingested(read_geojson_text(self.spark, payload, name, source_type, source_crs), register)

    def _ingested(self, rows: DataFrame, register: bool) -> Ingested:
        records = canonical.canonicalise(rows.filter("valid"))
        if register:
            name = rows.select("source_id").limit(1).collect()
            if name:
                self.catalog.register(name[0]["source_id"], records)
        return Ingested(records, rows.filter("not valid").select("row_ix", "error"), canonical.ingest_statistics(rows))

    def sources(self) -> DataFrame:
        return self.catalog.summary()

    def harmonize(self, source_ids: list[str], scorer=None) -> Harmonised:  # noqa: ANN001
        """Exact linkage, then candidates if a ``scorer`` (DataFrame of candidate pairs -> decision) is given."""
        if not 1 <= len(source_ids) <= 20:
            raise InvalidInput("between 1 and 20 sources")
        unknown = [s for s in source_ids if not self.catalog.has(s)]
        if unknown:
            raise InvalidInput(f"sources not found: {', '.join(unknown)}")
        records = canonical.union_sources([self.catalog.source(s) for s in source_ids])
        records = link.with_identity(records.withColumn("row_ix", F.col("source_ix").cast("long") * (1 << 40) + F.col("row_ix")))
        candidates = None
        if scorer is not None:
            # boxes of one system: geometries of unknown systems meet nothing
            placed = reproject(records.select("row_ix", "source_id", "geometry", "crs"), "geometry", "crs", 4326).filter("geometry is not null")
            candidates = scorer(spatial_join.spatial_candidates(spatial_join.with_boxes(placed.select("row_ix", "source_id", "geometry"), "geometry")))
            firsts = records.groupBy("identity_key").agg(F.min("row_ix").alias("first"))
            exact = records.join(firsts, "identity_key").select(F.col("first").alias("left_ix"), F.col("row_ix").alias("right_ix"))
            linked = candidates.filter("decision = 'linked'").select("left_ix", "right_ix").unionByName(exact)
            groups = components.components(records, linked, "row_ix").select(F.col("id").alias("row_ix"), F.col("component").cast("string").alias("component_id"))
            first = records.join(groups, "row_ix").groupBy("component_id").agg(F.min("identity_key").alias("least_key"))
            records = records.join(groups, "row_ix").join(first, "component_id").drop("identity_key", "component_id").withColumnRenamed("least_key", "identity_key")
        fields = [f for f in MERGED_FIELDS if f in records.columns]
        ran = {"validation", "crs", "geometry", "provenance", "export"} | ({"candidate_matching", "entity_resolution"} if scorer is not None else set())
        stages = self.spark.createDataFrame([(s, "COMPLETED" if s in ran else "SKIPPED", None if s in ran else "no trained model is configured") for s in STAGES], "stage string, status string, reason string")
        return Harmonised(jobs.merged_features(records, fields), link.conflict_rows(records, fields), link.missing_attribute_rows(records), candidates, stages)

    def save_job(self, job_id: str, source_ids: list[str], result: Harmonised) -> None:
        self.jobs.save(job_id, source_ids, result.features, result.conflicts)

    def export_job(self, job_id: str, fmt: str, path: str) -> None:
        """Write a job's features (geojson, csv), conflicts or provenance as lines of text, in parallel; CSV has its header in the first file."""
        self.jobs.export(job_id, fmt).write.mode("overwrite").text(path)

    def layers(self) -> DataFrame:
        return catalog.layers(self.catalog.sources())

    def layer(self, source_id: str) -> DataFrame:
        """(source_id, row_ix, feature, warning): a source as GeoJSON features in EPSG:4326."""
        records = self.catalog.source(source_id)
        shown = reproject(records.withColumn("attributes", F.col("raw_attributes")), "geometry", "crs", 4326)
        return catalog.geojson_features(shown)

    def dashboard(self, warnings: DataFrame | None = None) -> DataFrame:
        return jobs.dashboard_totals(self.catalog.sources(), self.jobs.jobs(), warnings)

    def topology(self, layer: DataFrame, key: str = "feature_id", geometry: str = "geometry") -> DataFrame:
        return topology.topology_issues(layer, key, geometry)

    def compare(self, pairs: DataFrame) -> DataFrame:
        return compare.compare_pairs(pairs)

    def pair_features(self, pairs: DataFrame, keys: list[str]) -> DataFrame:
        return features.pair_features(pairs, keys)

    def lookup(self, ulpin: str) -> DataFrame:
        return catalog.lookup(self.catalog.sources(), ulpin)

    def export_source(self, source_id: str, fmt: str, path: str) -> None:
        records = self.catalog.source(source_id)
        if fmt == "geojson":
            catalog.write_geojson(reproject(records.withColumn("attributes", F.col("raw_attributes")), "geometry", "crs", 4326), path)
        elif fmt == "csv":
            catalog.write_csv(records, "raw_attributes", path)
        else:
            raise InvalidInput(f"unknown export format {fmt!r}")
