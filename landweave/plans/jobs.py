"""Queries over jobs, merged features and reprojected geometries, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators import jobs
from landweave.operators.catalog import lookup, search
from landweave.operators.drift import cells
from landweave.operators.reproject import reproject
from landweave.operators.spatial_join import with_boxes
from landweave.plans.reference import FIELDS, KEYED, OBSERVED, WITH, keyed, norm
from landweave.session import cut, shared_dir
from landweave.sources.views import parcels, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_DEGREES = "minx / 100 + 70 AS west, least(miny / 100, 80) AS south, maxx / 100 + 70 AS east, least(maxy / 100, 80.09) AS north"


def _with_polygons(df: DataFrame) -> DataFrame:
    """Records with their box as a polygon in degrees; every tenth one without a coordinate system."""
    corner = [F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string")) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))]
    shape = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corner), F.lit("))"))
    return df.selectExpr("*", *_DEGREES.split(", ", 4)[:1], "least(miny / 100, 80) AS south", "maxx / 100 + 70 AS east", "least(maxy / 100, 80.09) AS north").withColumn("geometry", shape).withColumn("crs", F.when(F.col("row_ix") % 10 != 0, "EPSG:4326"))


@query(f"{WITH}, d AS (SELECT row_ix, {_DEGREES} FROM parcels) SELECT row_ix, round(radians(west) * 6378137.0, 3) AS minx, round(6378137.0 * ln(tan(pi() / 4 + radians(south) / 2)), 3) + 0.0 AS miny, round(radians(east) * 6378137.0, 3) AS maxx, round(6378137.0 * ln(tan(pi() / 4 + radians(north) / 2)), 3) AS maxy FROM d WHERE row_ix % 10 <> 0")
def reproject_geometries(spark: SparkSession, sf: str) -> DataFrame:
    """Whole polygons from degrees to Web Mercator; those of unknown system have no geometry."""
    moved = reproject(_with_polygons(parcels(spark, sf)).select("row_ix", "geometry", "crs"), "geometry", "crs", 3857).filter("geometry is not null")
    boxed = with_boxes(moved.select("row_ix", "geometry"), "geometry")
    return boxed.select("row_ix", *[F.round(F.col(c) + 0.0, 3).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query()
def reproject_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Greatest distance in degrees of any corner of a box after the way to its UTM zone and back, and the number of boxes."""
    boxes = _with_polygons(parcels(spark, sf)).filter("crs is not null and west < 84").withColumn("zone", F.lit("EPSG:32643"))
    there = reproject(boxes.filter("west >= 72 and west < 78").select("row_ix", "west", "south", "geometry", "crs", "zone"), "geometry", "crs", 32643)
    back = with_boxes(reproject(there, "geometry", "zone", 4326), "geometry")
    return back.agg(F.count(F.lit(1)).alias("boxes"), F.count_if((F.abs(F.col("minx") - F.col("west")) > 1e-9) | (F.abs(F.col("miny") - F.col("south")) > 1e-9)).alias("moved"))


@query(f"""{OBSERVED.rstrip().rstrip(",")}, per AS (SELECT identity_key, field, count(*) AS n FROM firsts GROUP BY ALL), bad AS (SELECT identity_key, string_agg(field, ';' ORDER BY field) AS conflict_fields FROM per WHERE n > 1 GROUP BY 1)
SELECT k.identity_key, count(*)::BIGINT AS record_count, count(DISTINCT source_id)::BIGINT AS source_count, string_agg(concat(source_id, ':', record_id), ';' ORDER BY row_ix) AS source_records, coalesce(any_value(conflict_fields), '') AS conflict_fields, min(row_ix) % 10 <> 0 AS located
FROM keyed k LEFT JOIN bad USING (identity_key) GROUP BY k.identity_key""")
def merged_features(spark: SparkSession, sf: str) -> DataFrame:
    """Merged features with geometry, conflicts and lineage lists."""
    merged = jobs.merged_features(_with_polygons(keyed(spark, sf)), FIELDS)
    return merged.select("identity_key", "record_count", "source_count", F.array_join("source_records", ";").alias("source_records"), F.array_join(F.transform("conflicts", lambda c: c["field"]), ";").alias("conflict_fields"), F.col("geometry").isNotNull().alias("located"))


@query(f"""{KEYED}, u AS (SELECT identity_key, row_ix, CASE WHEN trim(ulpin) <> '' THEN trim(ulpin) END AS u, concat(source_id, ':', record_id) AS k FROM keyed)
SELECT identity_key, arg_min(u, row_ix) FILTER (u IS NOT NULL) AS ulpin, arg_min(k, row_ix) FILTER (u IS NOT NULL) AS ulpin_source, CASE WHEN count(DISTINCT u) > 1 THEN string_agg(DISTINCT u, ';' ORDER BY u) ELSE '' END AS disagreements FROM u GROUP BY 1""")
def linked_ulpin(spark: SparkSession, sf: str) -> DataFrame:
    """Identifier each group adopts, the record it comes from, and the identifiers that disagree."""
    found = jobs.linked_ulpin(keyed(spark, sf))
    return found.select("identity_key", "ulpin", "ulpin_source", F.array_join("ulpin_disagreements", ";").alias("disagreements"))


_FIRST = {"village": ("village", "vill_name", "vname_e", "vname_h"), "khasra": ("khasra", "sno"), "area": ("area", "area_srs", "area_decim")}


def _alias_sql(field: str) -> str:
    cases = " ".join(f"WHEN map_contains(m, '{k}') THEN m['{k}']" for k in _FIRST[field])
    return f"CASE {cases} ELSE '' END AS {field}"


@query(f"SELECT row_ix, {', '.join(_alias_sql(f) for f in _FIRST)} FROM (SELECT row_ix, MAP {{CASE WHEN row_ix % 2 = 0 THEN 'vill_name' ELSE 'village' END: village, CASE WHEN row_ix % 3 = 0 THEN 'sno' WHEN row_ix % 3 = 1 THEN 'khasra' ELSE 'plot' END: khasra, 'area_decim': area_raw}} AS m FROM source_records)")
def model_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Model fields read under the first of their aliases that is present."""
    rows = table(spark, sf, "source_records")
    names = (F.when(F.col("row_ix") % 2 == 0, "vill_name").otherwise("village"), F.when(F.col("row_ix") % 3 == 0, "sno").when(F.col("row_ix") % 3 == 1, "khasra").otherwise("plot"))
    attributes = F.create_map(names[0], F.col("village"), names[1], F.col("khasra"), F.lit("area_decim"), F.col("area_raw"))
    return jobs.model_inputs(rows.select("row_ix", attributes.alias("m")), "m", list(_FIRST)).select("row_ix", *_FIRST)


def _store(spark: SparkSession, sf: str) -> jobs.JobStore:
    """A store with one job for each source and one for both."""
    import uuid

    from landweave.operators.link import conflict_rows

    store = jobs.JobStore(spark, f"{shared_dir(spark)}/landweave/{spark.sparkContext.applicationId}/jobs-{uuid.uuid4().hex}")
    records = cut(_with_polygons(keyed(spark, sf)))
    for name, chosen, when in (("j1", ["revenue"], "2024-01-01"), ("j2", ["municipal"], "2024-01-02"), ("j3", ["municipal", "revenue"], "2024-01-03")):
        own = records.filter(F.col("source_id").isin(chosen))
        store.save(name, chosen, jobs.merged_features(own, FIELDS), conflict_rows(own, FIELDS), created_at=when)
    return store


@query(f"{KEYED}, n AS (SELECT source_id, count(*) AS n, count(DISTINCT identity_key) AS g FROM keyed GROUP BY 1), c AS (SELECT count(*) AS c FROM (SELECT identity_key, field FROM (SELECT identity_key, unnest(['ulpin', 'district', 'village', 'tehsil', 'khasra']) AS field, unnest([ulpin, district, village, tehsil, khasra]) AS v FROM keyed) WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY 1, 2 HAVING count(DISTINCT {norm('v')}) > 1)) SELECT (SELECT count(DISTINCT source_id) FROM keyed)::BIGINT AS registered_sources, (SELECT count(*) FROM keyed)::BIGINT AS total_features, ((SELECT sum(g) FROM n) + (SELECT count(DISTINCT identity_key) FROM keyed))::BIGINT AS harmonized_parcels, (SELECT c FROM c)::BIGINT AS conflicts, 3::BIGINT AS processing_jobs, 'completed' AS processing_status, 'municipal;revenue' AS recent_activity, coalesce(round((SELECT avg(CASE WHEN ulpin IS NOT NULL THEN 0.9 ELSE 0.5 END) FROM keyed), 4), 0.0) AS average_confidence, 1::BIGINT AS warning_count, 1::BIGINT AS healthy_sources")
def dashboard_totals(spark: SparkSession, sf: str) -> DataFrame:
    """All totals of the dashboard over the records and a store of three jobs."""
    records = keyed(spark, sf).withColumn("confidence", F.when(F.col("ulpin").isNotNull(), 0.9).otherwise(0.5))
    warnings = spark.createDataFrame([("revenue",)], "source_id string")
    return jobs.dashboard_totals(records, _store(spark, sf).jobs(), warnings).withColumn("recent_activity", F.array_join("recent_activity", ";"))


@query(f"{KEYED} SELECT identity_key AS feature_id, min(row_ix) % 10 <> 0 AS located, count(*)::BIGINT AS record_count FROM keyed GROUP BY 1")
def job_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """The GeoJSON export of a job, read back."""
    lines = _store(spark, sf).export("j3", "geojson")
    doc = lines.select(F.get_json_object("value", "$.id").alias("feature_id"), F.get_json_object("value", "$.geometry.type").isNotNull().alias("located"), F.get_json_object("value", "$.properties.record_count").cast("long").alias("record_count"))
    return doc


@query(f"{WITH} SELECT source_id, record_id FROM parcels WHERE lower(trim(ulpin)) = 'up-000006'")
def catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookup(parcels(spark, sf), " UP-000006 ").select("source_id", "record_id")


@query(f"{WITH} SELECT row_ix FROM parcels WHERE source_id = 'revenue' AND contains(lower(concat_ws(' ', ulpin, district, village, tehsil, khasra, record_id)), 'up-00001')")
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    return search(parcels(spark, sf), "UP-00001", ["ulpin", "district", "village", "tehsil", "khasra", "record_id"], "revenue").select("row_ix")


@query("SELECT feed_id, file_no, count(*)::BIGINT AS n FROM raw_records WHERE feed_id IS NOT NULL AND file_no IS NOT NULL AND raw_attributes LIKE '{%' GROUP BY ALL")
def delivered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every delivered file that hold a JSON object, by the reading of the drift operator."""
    found = cells(table(spark, sf, "raw_records").filter("feed_id is not null and file_no is not null"))
    return found.groupBy("feed_id", "file_no").agg(F.count_distinct("raw_id").alias("n"))
