"""Queries of the general problems: timestamps (2), schema drift (4), proximity (6), units (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators.drift import schema_changes, unified_table
from landweave.operators.proximity import near_pairs, regions_containing, with_point_position
from landweave.operators.timestamps import normalise_timestamps
from landweave.operators.units import normalise_areas
from landweave.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank timestamp text of both tables with its instant or the reason there is none."""
    a = table(spark, sf_dir, "source_records").select(F.lit("source_records").alias("table_name"), F.col("row_ix").alias("row_key"), F.col("observed_at").alias("raw"), "source_system")
    b = table(spark, sf_dir, "canonical_parcels").select(F.lit("canonical_parcels").alias("table_name"), F.col("row_id").alias("row_key"), F.col("source_timestamp").alias("raw"), F.col("source_name").alias("source_system"))
    found = normalise_timestamps(a.unionByName(b), "raw", "source_system", table(spark, sf_dir, "sources"))
    return found.filter("ts_status <> 'blank'").select("table_name", "row_key", "instant_utc")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of every delivered file against the preceding file of its feed."""
    return schema_changes(table(spark, sf_dir, "raw_records"))


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All delivered rows in one consistent long table."""
    return unified_table(table(spark, sf_dir, "raw_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point records at most 30 m from each other, and the survey zones that contain each."""
    points = cut(with_point_position(table(spark, sf_dir, "source_records").select("source_record_id", "geometry", "crs"), "geometry", "crs").filter("lon is not null and lat is not null").select("source_record_id", "lon", "lat"))
    near = near_pairs(points, "source_record_id", "lon", "lat", 30.0).select(F.lit("near").alias("relation_kind"), "left_key", "right_key")
    inside = regions_containing(points, "source_record_id", "lon", "lat", table(spark, sf_dir, "survey_zones"), "zone_id", "geometry", "crs")
    return near.unionByName(inside.select(F.lit("inside").alias("relation_kind"), F.col("point_key").alias("left_key"), F.col("region_key").alias("right_key")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of every record in whole square metres, where a positive extent in a known unit stands."""
    records = table(spark, sf_dir, "source_records").select("row_ix", "source_system", "district", "area", "area_unit", "area_raw")
    found = normalise_areas(records, table(spark, sf_dir, "sources"), table(spark, sf_dir, "area_units"))
    return found.filter("area_sqm is not null").select("row_ix", F.rint("area_sqm").cast("long").alias("area_sqm"))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_unified": p4_unified, "p6_found": p6_found, "p7_found": p7_found}
SQL: dict[str, str] = {}
