"""Catalogue of sources and jobs, dashboard, searches and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dashboard(records: DataFrame) -> DataFrame:
    """Numbers of sources, features and parcels, and the average confidence (4 places, 0.0 when there is none)."""
    return records.agg(F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("features"), F.count_distinct("identity_key").alias("parcels"), F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("average_confidence"))


def latest(jobs: DataFrame, created: str, key: str) -> DataFrame:
    """The job created last (the greatest key among equals): a top-1, not a full sort."""
    return jobs.orderBy(F.desc(created), F.desc(key)).limit(1)


def layers(records: DataFrame) -> DataFrame:
    """One layer per source with its number of features."""
    return records.groupBy("source_id").agg(F.count(F.lit(1)).alias("feature_count")).select(F.col("source_id").alias("layer_id"), "source_id", "feature_count")


def geojson_features(records: DataFrame, attributes: str = "attributes") -> DataFrame:
    """(source_id, row_ix, feature, warning): GeoJSON text of every record; a geometry of unknown CRS is withheld with a warning."""
    known = F.col("crs").isNotNull()
    geometry = F.when(known & F.col("geometry").isNotNull(), F.col("geometry")).otherwise("null")
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.col(attributes), {"ignoreNullFields": "false"}), F.lit(',"geometry":'), geometry, F.lit("}"))
    return records.select("source_id", "row_ix", feature.alias("feature"), F.when(~known, "CRS is unknown; geometry is withheld").alias("warning"))


def write_geojson(records: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features, ordered by row; written in parallel."""
    geojson_features(records).orderBy("row_ix").select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def export_header(records: DataFrame, group: str, attributes: str) -> DataFrame:
    """(group, header): sorted union of the attribute names and the geometry column."""
    keys = records.select(group, F.explode(F.map_keys(attributes)).alias("k")).unionByName(records.select(group, F.lit("geometry_geojson").alias("k"))).distinct()
    return keys.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("header"))


def write_csv(records: DataFrame, attributes: str, path: str) -> None:
    """CSV with one column per attribute name (sorted) and the geometry as text, quoted where needed."""
    names = [r["k"] for r in records.select(F.explode(F.map_keys(attributes)).alias("k")).distinct().orderBy("k").collect()]  # field names, not rows
    records.select(*[F.try_element_at(attributes, F.lit(n)).alias(n) for n in names], F.col("geometry").alias("geometry_geojson")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def provenance_report(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("identity_key").alias("record_id"), "source_records", "record_count", "source_count")


def search(records: DataFrame, needle: str, columns: list[str], source: str | None = None) -> DataFrame:
    """Rows whose columns contain the text, without case, optionally of one source."""
    found = records.filter(F.lower(F.concat_ws(" ", *columns)).contains(needle.lower()))
    return found if source is None else found.filter(F.col("source_id") == source)


def lookup(records: DataFrame, ulpin: str, own: Column | None = None) -> DataFrame:
    """Rows with the identifier, trimmed and without case."""
    return records.filter(F.lower(F.trim(own if own is not None else F.col("ulpin"))) == ulpin.strip().lower())


class Catalog:
    """Sources as Parquet partitions below a folder: registering overwrites one source's partition only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def register(self, source_id: str, records: DataFrame) -> None:
        records.drop("source_id").write.mode("overwrite").parquet(f"{self.path}/source_id={source_id}")

    def sources(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def source(self, source_id: str) -> DataFrame:
        return self.sources().filter(F.col("source_id") == source_id)

    def has(self, source_id: str) -> bool:
        fs, p = self._fs(f"{self.path}/source_id={source_id}")
        return bool(fs.exists(p))

    def drop(self, source_id: str) -> bool:
        fs, p = self._fs(f"{self.path}/source_id={source_id}")
        return bool(fs.delete(p, True))

    def summary(self) -> DataFrame:
        return layers(self.sources())
