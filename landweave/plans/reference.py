"""Queries over the land-record operators, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions import crs as CRS
from landweave.functions import fuzzy, numeric, text
from landweave.operators import canonical, compare, components, features, link, scoring, spatial_join, topology
from landweave.sources.views import PARCELS, parcels, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WITH = f"WITH parcels AS ({PARCELS})"
FIELDS = ["ulpin", "district", "village", "tehsil", "khasra"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def norm(c: str) -> str:
    return f"coalesce(lower(regexp_replace(trim({c}), '\\s+', ' ', 'g')), '')"


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


KEY = f"""CASE WHEN {norm("ulpin")} <> '' THEN concat_ws('|', 'ulpin', {norm("ulpin")})
  WHEN {norm("district")} <> '' AND {norm("village")} <> '' AND {norm("tehsil")} <> '' AND {norm("khasra")} <> ''
  THEN concat_ws('|', 'cadastral', {norm("district")}, {norm("village")}, {norm("tehsil")}, {norm("khasra")})
  ELSE concat_ws('|', 'source-record', source_id, record_id) END"""
KEYED = f"{WITH}, keyed AS (SELECT *, {KEY} AS identity_key FROM parcels)"
LONG = ", long AS (" + " UNION ALL ".join(f"SELECT identity_key, row_ix, '{f}' AS field, {f} AS value FROM keyed WHERE {f} IS NOT NULL AND trim({f}) <> ''" for f in FIELDS) + ")"
OBSERVED = f"""{KEYED}{LONG}, firsts AS (SELECT identity_key, field, {norm("value")} AS nv, min(row_ix) AS seen, arg_min(value, row_ix) AS value FROM long GROUP BY ALL),
observed AS (SELECT identity_key, field, string_agg(value, ' ; ' ORDER BY seen) AS vals, count(*) AS n, min(value) AS single FROM firsts GROUP BY ALL)"""


# --- canonicalisation -----------------------------------------------------------------------------------------


@query(f"{WITH} SELECT source_id, row_ix, record_id, nullif(trim(ulpin), '') AS ulpin, nullif(district, '') AS district, nullif(khasra, '') AS khasra, CASE WHEN nullif(khasra, '') IS NULL THEN 'khasra;parcel_type' ELSE 'parcel_type' END AS missing FROM parcels")
def canonical_projection(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf)
    props = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in ((" ID ", "record_id"), ("Ulpin", "ulpin"), ("DISTRICT", "district"), ("village", "village"), ("Tehsil", "tehsil"), ("khasra", "khasra"))]))
    rows = p.select("source_id", F.col("source_id").alias("source_name"), F.lit("other").alias("source_type"), "row_ix", props.alias("properties"), F.lit(None).cast("string").alias("geometry"), F.lit(None).cast("string").alias("geometry_type"), F.lit(None).cast("string").alias("crs"))
    return canonical.canonicalise(rows).select("source_id", "row_ix", "record_id", "ulpin", "district", "khasra", F.array_join("missing_fields", ";").alias("missing"))


@query("SELECT replace(replace(lower(trim(event_type)), ' ', '_'), '-', '_') AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def key_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(text.norm_key(F.col("event_type")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT row_ix, coalesce(nullif(ulpin, ''), nullif(khasra, ''), concat(source_id, '-', row_ix)) AS rid FROM parcels")
def record_id_chain(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("id"), F.col("ulpin"), F.lit("source_id"), F.col("khasra"))
    return parcels(spark, sf).select("row_ix", canonical.record_id(m, F.col("source_id"), F.col("row_ix")).alias("rid"))


@query(f"{WITH} SELECT source_id, row_ix, concat_ws(';', CASE WHEN ulpin IS NULL THEN 'ulpin' END, CASE WHEN khasra IS NULL THEN 'khasra' END) AS flags FROM parcels")
def missing_flags(spark: SparkSession, sf: str) -> DataFrame:
    return parcels(spark, sf).select("source_id", "row_ix", F.array_join(canonical.missing_fields(("ulpin", "khasra")), ";").alias("flags"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf)
    keys = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("district", "village", "khasra", "ulpin")])), lambda k, v: v.isNotNull())
    return p.select("source_id", "row_ix", keys.alias("properties"), F.when(F.col("row_ix") % 5 == 0, "Point").otherwise("Polygon").alias("geometry_type"), (F.col("row_ix") % 7 != 0).alias("valid"))


_STATS = f"""{WITH}, k AS (SELECT DISTINCT source_id, unnest(list_filter([CASE WHEN district IS NOT NULL THEN 'district' END, CASE WHEN village IS NOT NULL THEN 'village' END, CASE WHEN khasra IS NOT NULL THEN 'khasra' END, CASE WHEN ulpin IS NOT NULL THEN 'ulpin' END], lambda x: x IS NOT NULL)) AS k FROM parcels)"""


@query(f"""{_STATS} SELECT source_id, count(*)::BIGINT AS total_records, count(*) FILTER (row_ix % 7 <> 0)::BIGINT AS valid_records, count(*) FILTER (row_ix % 7 = 0)::BIGINT AS invalid_records,
string_agg(DISTINCT CASE WHEN row_ix % 5 = 0 THEN 'Point' ELSE 'Polygon' END, ';' ORDER BY CASE WHEN row_ix % 5 = 0 THEN 'Point' ELSE 'Polygon' END) AS geometry_types FROM parcels GROUP BY 1""")
def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = canonical.ingest_statistics(_features(spark, sf))
    return s.select("source_id", "total_records", "valid_records", "invalid_records", F.array_join("geometry_types", ";").alias("geometry_types"))


@query(f"{_STATS} SELECT source_id, string_agg(k, ';' ORDER BY k) AS detected, 'tehsil' AS missing FROM k GROUP BY 1")
def detected_fields(spark: SparkSession, sf: str) -> DataFrame:
    s = canonical.ingest_statistics(_features(spark, sf))
    return s.select("source_id", F.array_join("detected_fields", ";").alias("detected"), F.array_join("missing_expected_fields", ";").alias("missing"))


@query(f"{WITH}, m AS (SELECT source_id, row_ix, 'missing optional field: khasra' AS message FROM parcels WHERE khasra IS NULL UNION ALL SELECT source_id, row_ix, 'missing optional field: ulpin' FROM parcels WHERE ulpin IS NULL), f AS (SELECT source_id, message, min(row_ix) AS seen FROM m GROUP BY ALL) SELECT source_id, string_agg(message, ';' ORDER BY seen, message) AS warnings FROM f GROUP BY 1")
def warnings_in_order(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf)
    m = p.select("source_id", "row_ix", F.explode(canonical.missing_fields(("khasra", "ulpin"))).alias("f")).select("source_id", "row_ix", F.concat(F.lit("missing optional field: "), "f").alias("message"))
    return canonical.ordered_warnings(m).select("source_id", F.array_join("warnings", ";").alias("warnings"))


@query(f"{WITH} SELECT row_ix, concat_ws(';', CASE WHEN ulpin IS NOT NULL THEN concat('ulpin=', ulpin) END, concat('district=', district), 'note=x') AS flat FROM parcels")
def attribute_flatten(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf).withColumn("extra", F.create_map(F.lit("note"), F.lit("x"), F.lit("district"), F.lit("other")))
    flat = canonical.flatten_attributes(["ulpin", "district"], "extra")
    return p.select("row_ix", F.array_join(F.transform(F.map_entries(flat), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("flat"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, json_array_length(json_keys(props::JSON))::INT AS n_keys FROM events")
def json_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query(f"{WITH} SELECT source_id, count(*)::BIGINT AS n, 0 AS source_ix FROM parcels WHERE source_id = 'municipal' GROUP BY 1 UNION ALL SELECT source_id, count(*)::BIGINT, 1 FROM parcels WHERE source_id = 'revenue' GROUP BY 1")
def source_concatenation(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf)
    u = canonical.union_sources([p.filter("source_id = 'municipal'"), p.filter("source_id = 'revenue'")])
    return u.groupBy("source_id", "source_ix").agg(F.count(F.lit(1)).alias("n"))


# --- linkage, merge, conflicts --------------------------------------------------------------------------------


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return link.with_identity(parcels(spark, sf))


@query(f"{KEYED} SELECT row_ix, identity_key FROM keyed")
def identity_link(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(spark, sf).select("row_ix", "identity_key")


@query(f"{OBSERVED}, g AS (SELECT identity_key, count(*)::BIGINT AS record_count, count(DISTINCT source_id)::BIGINT AS source_count, arg_min(record_id, row_ix) AS representative FROM keyed GROUP BY 1) SELECT g.*, max(CASE WHEN field = 'district' AND n = 1 THEN single END) AS district, max(CASE WHEN field = 'khasra' AND n = 1 THEN single END) AS khasra FROM g LEFT JOIN observed USING (identity_key) GROUP BY ALL")
def harmonize_exact(spark: SparkSession, sf: str) -> DataFrame:
    return link.merge_groups(keyed(spark, sf), FIELDS).select("identity_key", "record_count", "source_count", "representative", "district", "khasra")


CONFLICTS = f"""{OBSERVED}, conflicts AS (SELECT identity_key, field, vals, CASE WHEN field = 'ulpin' THEN 'identity_conflict' ELSE 'attribute_conflict' END AS conflict_type,
 CASE WHEN field = 'ulpin' THEN 'critical' WHEN field IN ('district', 'village', 'khasra') THEN 'high' ELSE 'medium' END AS severity, 'unresolved' AS resolution_status FROM observed WHERE n > 1)"""


@query(f"{CONFLICTS} SELECT * FROM conflicts")
def conflict_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = link.conflict_rows(keyed(spark, sf), FIELDS)
    return c.select("identity_key", "field", F.array_join("values", " ; ").alias("vals"), "conflict_type", "severity", "resolution_status")


@query(f"{CONFLICTS} SELECT identity_key, field FROM conflicts WHERE conflict_type = 'attribute_conflict' AND resolution_status = 'unresolved'")
def conflicts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return link.conflict_rows(keyed(spark, sf), FIELDS).filter("conflict_type = 'attribute_conflict' and resolution_status = 'unresolved'").select("identity_key", "field")


@query(f"{CONFLICTS} SELECT conflict_type, severity, count(*)::BIGINT AS n FROM conflicts GROUP BY ROLLUP (conflict_type, severity)")
def conflict_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return link.conflict_rows(keyed(spark, sf), FIELDS).rollup("conflict_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"{CONFLICTS} SELECT identity_key, field FROM conflicts WHERE lower(concat(identity_key, vals)) LIKE '%asia x%'")
def conflict_search(spark: SparkSession, sf: str) -> DataFrame:
    c = link.conflict_rows(keyed(spark, sf), FIELDS)
    return c.filter(F.lower(F.to_json(F.struct("identity_key", "values"))).contains("asia x")).select("identity_key", "field")


@query(f"{KEYED} SELECT identity_key, source_id, record_id, f.field FROM keyed, (VALUES ('district'), ('village'), ('khasra')) f(field) WHERE CASE f.field WHEN 'district' THEN coalesce(trim(district), '') WHEN 'village' THEN coalesce(trim(village), '') ELSE coalesce(trim(khasra), '') END = ''")
def missing_attribute_rows(spark: SparkSession, sf: str) -> DataFrame:
    return link.missing_attribute_rows(keyed(spark, sf)).select("identity_key", "source_id", "record_id", "field")


@query(f"{KEYED} SELECT identity_key, string_agg(concat_ws(':', source_id, record_id), ';' ORDER BY row_ix) AS source_records FROM keyed GROUP BY 1")
def provenance_lists(spark: SparkSession, sf: str) -> DataFrame:
    return link.merge_groups(keyed(spark, sf), FIELDS).select("identity_key", F.array_join("source_records", ";").alias("source_records"))


@query(f"{KEYED} SELECT identity_key, count(*)::BIGINT AS record_count, CASE WHEN identity_key LIKE 'ulpin%' THEN 'exact_ulpin' WHEN identity_key LIKE 'cadastral%' THEN 'exact_cadastral' ELSE 'single_source' END AS matching_method, CASE WHEN count(*) > 1 THEN 'exact identifiers agree' ELSE 'no second record' END AS resolution_reason FROM keyed GROUP BY 1")
def resolution_methods(spark: SparkSession, sf: str) -> DataFrame:
    k = keyed(spark, sf)
    none = k.select("identity_key", F.lit("review").alias("decision"), F.lit(None).cast("double").alias("confidence")).limit(0)
    return link.resolution(link.merge_groups(k, FIELDS), none).select("identity_key", "record_count", "matching_method", "resolution_reason")


@query(f"{KEYED} SELECT count(DISTINCT identity_key)::BIGINT AS groups, count(*)::BIGINT AS records, (SELECT count(*) FROM (SELECT identity_key FROM keyed GROUP BY 1 HAVING count(*) > 1))::BIGINT AS linked FROM keyed")
def job_counters(spark: SparkSession, sf: str) -> DataFrame:
    g = keyed(spark, sf).groupBy("identity_key").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("records"), F.count_if(F.col("n") > 1).alias("linked"))


@query(f"{WITH} SELECT source_id, record_id FROM parcels WHERE lower(trim(ulpin)) = 'up-000006'")
def ulpin_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return parcels(spark, sf).filter(F.lower(F.trim("ulpin")) == "up-000006").select("source_id", "record_id")


@query(f"{WITH} SELECT row_ix FROM parcels WHERE source_id = 'revenue' AND lower(concat_ws(' ', ulpin, district, village, tehsil, khasra, record_id)) LIKE '%china%'")
def parcel_search(spark: SparkSession, sf: str) -> DataFrame:
    return parcels(spark, sf).filter("source_id = 'revenue'").filter(F.lower(F.concat_ws(" ", "ulpin", "district", "village", "tehsil", "khasra", "record_id")).contains("china")).select("row_ix")


@query(f"{WITH} SELECT source_id, string_agg(DISTINCT trim(lower(ulpin)), ';' ORDER BY trim(lower(ulpin))) FILTER (row_ix % 1000 < 20) AS ulpins FROM parcels GROUP BY 1")
def ulpin_lists(spark: SparkSession, sf: str) -> DataFrame:
    u = F.when(F.col("row_ix") % 1000 < 20, F.trim(F.lower("ulpin")))
    return parcels(spark, sf).groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set(u)), ";").alias("ulpins"))


@query(f"{WITH} SELECT source_id, string_agg(DISTINCT trim(lower(ulpin)), ';' ORDER BY trim(lower(ulpin))) AS ulpins FROM parcels GROUP BY 1")
def ulpin_lists_whole(spark: SparkSession, sf: str) -> DataFrame:
    u = F.trim(F.lower("ulpin"))
    return parcels(spark, sf).groupBy("source_id").agg(F.when(F.count("ulpin") > 0, F.array_join(F.array_sort(F.collect_set(u)), ";")).alias("ulpins"))


@query(f"{WITH} SELECT (SELECT count(*) FROM parcels p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT source_id FROM parcels WHERE source_id = 'revenue') s WHERE s.source_id = p.source_id))::BIGINT AS missing")
def requested_sources_check(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf)
    return p.join(p.filter("source_id = 'revenue'").select("source_id").distinct(), "source_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


# --- geometry and spatial joins -------------------------------------------------------------------------------

PAIRS = f"{WITH}, pairs AS (SELECT a.row_ix AS left_ix, b.row_ix AS right_ix, greatest(0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS inter, (a.maxx - a.minx) * (a.maxy - a.miny) AS sa, (b.maxx - b.minx) * (b.maxy - b.miny) AS sb, a.source_id AS s1, b.source_id AS s2 FROM parcels a JOIN parcels b ON a.row_ix < b.row_ix AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy)"


@query(f"{PAIRS} SELECT left_ix, right_ix FROM pairs WHERE s1 <> s2")
def spatial_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return spatial_join.spatial_candidates(parcels(spark, sf), cell=20.0)


@query(f"{PAIRS} SELECT left_ix, right_ix FROM pairs WHERE s1 <> s2 ORDER BY 1, 2 LIMIT 250")
def candidate_cap(spark: SparkSession, sf: str) -> DataFrame:
    return spatial_join.spatial_candidates(parcels(spark, sf), cell=20.0, cap=250)


@query(f"{PAIRS} SELECT left_ix, right_ix, round(inter, 6) AS intersection_area, round(sa + sb - inter, 6) AS union_area, round(inter / (sa + sb - inter), 6) AS iou, round(inter / sa, 6) AS fraction_a, round(inter / sb, 6) AS fraction_b FROM pairs")
def overlap_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = spatial_join.box_overlap(spatial_join.box_pairs(parcels(spark, sf), "row_ix", [], 20.0))
    return m.select(F.col("row_ix_a").alias("left_ix"), F.col("row_ix_b").alias("right_ix"), *[r6(F.col(c)).alias(c) for c in ("intersection_area", "union_area", "iou", "fraction_a", "fraction_b")])


def _wkt() -> Column:
    p = [F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string")) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *p), F.lit("))"))


@query(f"{PAIRS} SELECT left_ix, right_ix, round(inter, 6) AS intersection_area, CASE WHEN inter / (sa + sb - inter) > 0.1 THEN 'high' ELSE 'medium' END AS severity FROM pairs WHERE inter > 1e-9")
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    o = spatial_join.polygon_overlaps(parcels(spark, sf).select("row_ix", _wkt().alias("geometry")), "row_ix", "geometry")
    return o.select(F.col("row_ix_a").alias("left_ix"), F.col("row_ix_b").alias("right_ix"), r6(F.col("intersection_area")).alias("intersection_area"), "severity")


@query(f"{WITH}, k AS (SELECT row_ix, concat_ws(',', minx, miny, maxx, maxy) AS k FROM parcels), f AS (SELECT k, min(row_ix) AS first_id FROM k GROUP BY 1) SELECT first_id, row_ix AS duplicate_id FROM k JOIN f USING (k) WHERE row_ix > first_id")
def duplicate_geometry(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf)
    keys = topology.normal_key(p.select(F.lpad(F.col("row_ix").cast("string"), 12, "0").alias("row_ix"), _wkt().alias("g")), "row_ix", "g")
    return topology.duplicates(keys).select(F.col("first_id").cast("long").alias("first_id"), F.col("duplicate_id").cast("long").alias("duplicate_id"))


@query(f"{WITH} SELECT source_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM parcels GROUP BY 1")
def total_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return parcels(spark, sf).groupBy("source_id").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


@query(f"{WITH} SELECT row_ix, minx, miny, maxx, maxy, round((maxx - minx) * (maxy - miny), 6) AS area FROM parcels")
def bbox(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf).select("row_ix", _wkt().alias("g"))
    b = spatial_join.with_boxes(p, "g")
    return b.select("row_ix", "minx", "miny", "maxx", "maxy", r6((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("area"))


@query(f"{WITH} SELECT row_ix, CASE WHEN minx BETWEEN -180 AND 180 AND maxx BETWEEN -180 AND 180 AND miny BETWEEN -90 AND 90 AND maxy BETWEEN -90 AND 90 THEN 'EPSG:4326' END AS crs FROM parcels")
def crs_infer(spark: SparkSession, sf: str) -> DataFrame:
    pts = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("minx", "miny"), ("maxx", "maxy"))])
    return parcels(spark, sf).select("row_ix", F.when(F.forall(pts, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90)), "EPSG:4326").alias("crs"))


_LL = "row_ix, minx / 100 + 70 AS lon, least(miny / 100, 80) AS lat"


@query(f"{WITH} SELECT row_ix, round(radians(lon) * 6378137.0, 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y FROM (SELECT {_LL} FROM parcels)")
def web_mercator(spark: SparkSession, sf: str) -> DataFrame:
    x, y = CRS.mercator_forward(F.col("lon"), F.col("lat"))
    return parcels(spark, sf).selectExpr(*_LL.split(", ", 2)[:2], "least(miny / 100, 80) as lat").select("row_ix", F.round(x, 4).alias("x"), F.round(y + 0.0, 4).alias("y"))


@query()
def utm_forward(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf).selectExpr("row_ix", "minx / 100 + 70 as lon", "least(miny / 100, 80) as lat").withColumn("zone", F.floor((F.col("lon") + 180) / 6) + 1)
    x, y = CRS.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    return p.select("row_ix", "zone", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


@query("SELECT zone_id, CASE WHEN crs LIKE '%CRS84%' THEN 4326 ELSE CAST(regexp_extract(crs, '(\\d+)$', 1) AS INT) END AS epsg FROM survey_zones")
def crs_describe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "survey_zones").select("zone_id", CRS.epsg_code(F.col("crs")).cast("int").alias("epsg"))


def _shapes(spark: SparkSession) -> DataFrame:
    rows = [("square", "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))"), ("bowtie", "POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))"), ("shifted", "POLYGON ((5 0, 5 10, 15 10, 15 0, 5 0))"), ("holed", "POLYGON ((20 0, 20 10, 30 10, 30 0, 20 0), (22 2, 24 2, 24 4, 22 4, 22 2))"), ("empty", "POLYGON EMPTY"), ("broken", "POLYGON (())"), ("again", "POLYGON ((10 0, 0 0, 0 10, 10 10, 10 0))")]
    return spark.createDataFrame(rows, "feature_id string, geometry string")


@query("SELECT * FROM (VALUES ('square', 'Polygon', true, NULL, 100.0), ('bowtie', 'Polygon', false, 'self_intersection', 0.0), ('shifted', 'Polygon', true, NULL, 100.0), ('holed', 'Polygon', true, NULL, 96.0), ('empty', 'Polygon', true, 'empty_geometry', 0.0), ('broken', NULL, false, 'unparseable_geometry', NULL), ('again', 'Polygon', true, NULL, 100.0)) t(feature_id, geometry_type, valid, issue_type, area)")
def validity_report(spark: SparkSession, sf: str) -> DataFrame:
    return topology.validity_report(_shapes(spark)).select("feature_id", "geometry_type", "valid", "issue_type", "area")


@query("SELECT 'bowtie' AS feature_id, 'make_valid' AS operation, 50.0::DOUBLE AS area_after, true AS type_changed, false AS applied")
def repair_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return topology.repair_proposals(topology.validity_report(_shapes(spark))).select("feature_id", "operation", "area_after", "type_changed", "applied")


@query("SELECT * FROM (VALUES (0, 'self_intersection', 'bowtie', 'high'), (0, 'empty_geometry', 'empty', 'medium'), (0, 'unparseable_geometry', 'broken', 'high'), (1, 'duplicate_geometry', 'again;square', 'medium'), (2, 'overlap', 'again;square', 'high'), (2, 'overlap', 'again;shifted', 'high'), (2, 'overlap', 'shifted;square', 'high')) t(check_ix, issue_type, ids, severity)")
def topology_issues(spark: SparkSession, sf: str) -> DataFrame:
    return topology.topology_issues(_shapes(spark), with_gaps=False).select("check_ix", "issue_type", F.array_join(F.array_sort("feature_ids"), ";").alias("ids"), "severity")


@query("SELECT issue_type, CASE WHEN issue_type = 'overlap' THEN 'geometry_conflict' ELSE 'topology_error' END AS conflict_type, count(*)::BIGINT AS n FROM (VALUES ('self_intersection'), ('empty_geometry'), ('unparseable_geometry'), ('duplicate_geometry'), ('overlap'), ('overlap'), ('overlap')) t(issue_type) GROUP BY 1")
def topology_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return compare.topology_conflicts(topology.topology_issues(_shapes(spark), with_gaps=False)).groupBy("issue_type", "conflict_type").agg(F.count(F.lit(1)).alias("n"))


def _walled_gaps(orders: DataFrame) -> DataFrame:
    o = orders.select((F.col("o_orderkey") * 100).alias("x"), "o_orderkey")
    walls = [("n", 0, 20, 30, 30), ("s", 0, 0, 30, 10), ("w", 0, 10, 10, 20), ("e", 20, 10, 30, 20)]
    shapes = o.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (F.col("x") + a).alias("minx"), F.lit(b).alias("miny"), (F.col("x") + c).alias("maxx"), F.lit(d).alias("maxy")) for n, a, b, c, d in walls])).alias("w")).select("o_orderkey", "w.*")
    g = topology.gaps(shapes.select(F.concat_ws("-", "o_orderkey", "n").alias("feature_id"), _wkt().alias("geometry")))
    return g.select(F.substring_index(F.col("feature_ids")[0], "-", 1).cast("long").alias("block"), "area", F.array_join(F.transform("feature_ids", lambda x: F.substring_index(x, "-", -1)), ";").alias("ids"))


@query("SELECT o.o_orderkey AS block, 100.0::DOUBLE AS area, 'e;n;s;w' AS ids FROM (SELECT * FROM orders WHERE o_orderkey <= 20) o")
def gap_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Four walls around a gap, one set of walls per small order."""
    return _walled_gaps(table(spark, sf, "orders").filter("o_orderkey <= 20"))


@query("SELECT o_orderkey AS block, 100.0::DOUBLE AS area, 'e;n;s;w' AS ids FROM orders")
def gap_cells_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Four walls around a gap, one set of walls per order."""
    return _walled_gaps(table(spark, sf, "orders"))


@query()
def boundary_sample_64(spark: SparkSession, sf: str) -> DataFrame:
    from landweave.operators.imaging import boundary_samples

    return boundary_samples(parcels(spark, sf).select(F.col("row_ix").alias("feature_id"), _wkt().alias("geometry")))


# --- comparison and confidence --------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = parcels(spark, sf).withColumn("c", F.regexp_extract("record_id", r"(\d+)", 1))
    cols = ["ulpin", "district", "village", "khasra", "tehsil", "area"]
    a = p.filter("source_id = 'revenue'").select("c", F.col("record_id").alias("key_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = p.filter("source_id = 'municipal'").select("c", F.col("record_id").alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, "c")


PAIRED = f"{WITH}, pr AS (SELECT a.record_id AS key_a, b.record_id AS key_b, a.ulpin AS ulpin_a, b.ulpin AS ulpin_b, a.district AS district_a, b.district AS district_b, a.village AS village_a, b.village AS village_b, a.khasra AS khasra_a, b.khasra AS khasra_b, a.tehsil AS tehsil_a, b.tehsil AS tehsil_b, a.area AS area_a, b.area AS area_b FROM parcels a JOIN parcels b ON a.source_id = 'revenue' AND b.source_id = 'municipal' AND a.record_id[3:] = b.record_id[3:])"
_DIFF = " UNION ALL ".join(f"SELECT key_a, key_b, '{'identity' if c == 'ulpin' else 'attribute'}_conflict' AS conflict_type, '{'critical' if c == 'ulpin' else 'high'}' AS severity, '{c}' AS field FROM pr WHERE {norm(c + '_a')} <> '' AND {norm(c + '_b')} <> '' AND {norm(c + '_a')} <> {norm(c + '_b')}" for c in ("ulpin", "district", "village", "khasra"))
_MISS = " UNION ALL ".join(f"SELECT key_a, key_b, 'missing_attribute', 'medium', '{c}{s}' FROM pr WHERE coalesce(trim({c}{s}), '') = ''" for c in ("district", "village", "khasra") for s in ("_a", "_b"))


@query(f"{PAIRED} {_DIFF} UNION ALL SELECT key_a, key_b, 'attribute_conflict', 'medium', 'area' FROM pr WHERE abs(area_a - area_b) / greatest(abs(area_a), abs(area_b)) > 0.05 UNION ALL SELECT key_a, key_b, 'crs_conflict', 'high', 'crs' FROM pr UNION ALL {_MISS}")
def pair_compare(spark: SparkSession, sf: str) -> DataFrame:
    n = F.lit(None).cast("string")
    extra = {f"{c}_{s}": n for c in ("crs", "parcel_id", "parcel_type", "area_unit") for s in ("a", "b")} | {"iou": F.lit(None).cast("double"), "system_a": F.lit("revenue"), "system_b": F.lit("municipal")}
    return compare.compare_pairs(_pairs(spark, sf).withColumns(extra))


@query(f"{PAIRED} SELECT key_a, CASE WHEN abs(area_a - area_b) / greatest(abs(area_a), abs(area_b)) > 0.05 THEN 'area' END AS conflict FROM pr")
def area_conflict(spark: SparkSession, sf: str) -> DataFrame:
    u = F.lit("sqm")
    return _pairs(spark, sf).select("key_a", compare.area_conflict(F.col("area_a"), F.col("area_b"), u, u).alias("conflict"))


_CH = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 1 - l_discount END AS c1, 1 - l_tax AS c2, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity / 50 END AS c3, CASE WHEN l_returnflag = 'A' THEN ['critical', 'low'] WHEN l_returnflag = 'N' THEN ['medium'] ELSE [] END AS sev FROM lineitem"


@query(f"WITH ch AS ({_CH}), b AS (SELECT *, exp(((CASE WHEN c1 IS NULL THEN 0.0::DOUBLE ELSE 0.35::DOUBLE * ln(greatest(c1, 1e-6)) END) + (CASE WHEN c2 IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE * ln(greatest(c2, 1e-6)) END) + (CASE WHEN c3 IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE * ln(greatest(c3, 1e-6)) END)) / ((CASE WHEN c1 IS NULL THEN 0 ELSE 0.35 END) + (CASE WHEN c2 IS NULL THEN 0 ELSE 0.25 END) + (CASE WHEN c3 IS NULL THEN 0 ELSE 0.2 END))) AS base, (CASE len(sev) WHEN 2 THEN 0.5 * 0.95 WHEN 1 THEN 0.85 ELSE 1.0 END)::DOUBLE AS factor FROM ch) SELECT l_orderkey, l_linenumber, round(base, 6) AS base_confidence, round(factor, 6) AS conflict_factor, round(least(1, greatest(0, base * factor)), 6) AS final_confidence, concat_ws(', ', CASE WHEN c1 IS NULL THEN 'model' END, CASE WHEN c3 IS NULL THEN 'attribute' END) AS missing FROM b")
def confidence_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    sev = F.when(F.col("l_returnflag") == "A", F.array(F.lit("critical"), F.lit("low"))).when(F.col("l_returnflag") == "N", F.array(F.lit("medium"))).otherwise(F.array().cast("array<string>"))
    ch = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, 1 - F.col("l_discount")).alias("c1"), (1 - F.col("l_tax")).alias("c2"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 50).alias("c3"), sev.alias("sev"))
    out = compare.confidence(ch, {"model": "c1", "geometric": "c2", "attribute": "c3"}, "sev")
    return out.select("l_orderkey", "l_linenumber", r6(F.col("base_confidence")).alias("base_confidence"), r6(F.col("conflict_factor")).alias("conflict_factor"), r6(F.col("final_confidence")).alias("final_confidence"), F.array_join("missing_channels", ", ").alias("missing"))


@query("SELECT l_returnflag, round(product(CASE l_linestatus WHEN 'O' THEN 0.95 ELSE 0.85 END), 6) AS factor FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) GROUP BY 1")
def conflict_penalty(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.collect_set(F.when(F.col("l_linestatus") == "O", "low").otherwise("medium")).alias("s"))
    return g.select("l_returnflag", r6(numeric.product(F.transform("s", lambda x: 1 - compare.penalty(x)))).alias("factor"))


@query(f"{PAIRED}, n AS (SELECT key_a, ({norm('district_a')} = {norm('district_b')})::INT + ({norm('village_a')} = {norm('village_b')})::INT AS m FROM pr) SELECT key_a, round(m / 2.0, 6) AS agreement FROM n")
def attribute_agreement(spark: SparkSession, sf: str) -> DataFrame:
    same = [(text.norm_link(F.col(f"{c}_a")) == text.norm_link(F.col(f"{c}_b"))).cast("int") for c in ("district", "village")]
    m = same[0] + same[1]
    return _pairs(spark, sf).select("key_a", r6(compare.agreement(m, 2 - m)).alias("agreement"))


@query("WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY edge_id) AS i, left_id, right_id FROM link_edges WHERE decision IN ('match', 'review')), d AS (SELECT left_id AS u, right_id AS v FROM e UNION SELECT right_id, left_id FROM e), reach(a, b) AS (SELECT u, u FROM d UNION SELECT reach.a, d.v FROM reach JOIN d ON reach.b = d.u) SELECT a AS id, min(b) AS component FROM reach GROUP BY 1")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "link_edges").filter("decision in ('match', 'review')")
    nodes = e.select(F.explode(F.array("left_id", "right_id")).alias("id"))
    return components.components(nodes, e, "id", "left_id", "right_id")


@query("SELECT edge_id, CASE WHEN len(list_filter(d, lambda x: x IS NOT NULL)) > 0 AND len(list_filter(d, lambda x: x IS NOT NULL AND x <> 'match')) = 0 THEN 'linked' ELSE 'review' END AS decision FROM (SELECT edge_id, [decision, CASE WHEN score > 0.7 THEN 'match' END] AS d FROM link_edges)")
def link_decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = F.array(F.col("decision"), F.when(F.col("score") > 0.7, "match"))
    return table(spark, sf, "link_edges").select("edge_id", link.link_decision(d, F.lit(False)).alias("decision"))


# --- text and features ----------------------------------------------------------------------------------------

_NAMES = "WITH pr AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, lower(a.n_name) AS x, lower(b.n_name) AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.lower("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.lower("n_name").alias("y"))
    return a.join(b, F.col("a") < F.col("b"))


@query(f"{_NAMES} SELECT a, b, round(jaro_winkler_similarity(x, y), 6) AS s FROM pr")
def jaro_winkler(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("a", "b", r6(fuzzy.jaro_winkler_udf("x", "y")).alias("s"))


@query(f"{_NAMES} SELECT a, b, round(1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)), 6) AS s FROM pr")
def levenshtein_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("a", "b", r6(text.levenshtein_ratio(F.col("x"), F.col("y"))).alias("s"))


_G = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 2)), lambda i: substr({0}, i, 3)))"


@query(f"{_NAMES}, g AS (SELECT a, b, {_G.format('x')} AS gx, {_G.format('y')} AS gy FROM pr) SELECT a, b, round(len(list_intersect(gx, gy))::DOUBLE / len(list_distinct(list_concat(gx, gy))), 6) AS s FROM g")
def trigram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("a", "b", r6(text.jaccard(text.grams(F.col("x")), text.grams(F.col("y")))).alias("s"))


@query("WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, string_split(p_type, ' ') AS v FROM part) SELECT p_partkey, round(len(list_intersect(list_distinct(w), list_distinct(v)))::DOUBLE / greatest(1, len(list_distinct(list_concat(w, v)))), 6) AS s FROM p")
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", r6(text.token_overlap(F.col("p_name"), F.col("p_type"))).alias("s"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN regexp_matches(text, '[ऀ-ॿ]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'devanagari' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script FROM documents")
def script_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.script_type(F.col("text")).alias("script"))


@query()
def fuzzy_ratios(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("p_name"), F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", *[r6(u(x, y)).alias(n) for n, u in (("ratio", fuzzy.ratio_udf), ("token_sort", fuzzy.token_sort_udf), ("token_set", fuzzy.token_set_udf), ("partial", fuzzy.partial_udf), ("wratio", fuzzy.wratio_udf))])


@query("SELECT row_ix, CASE WHEN regexp_matches(replace(trim(area_raw), ',', ''), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(replace(trim(area_raw), ',', '') AS DOUBLE) END AS x FROM source_records")
def to_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_records").select("row_ix", text.to_number(F.col("area_raw")).alias("x"))


@query(f"{PAIRED} SELECT key_a, round(CASE WHEN greatest(area_a, area_b) = 0 THEN 1 ELSE least(area_a, area_b) / greatest(area_a, area_b) END, 6) AS ratio, round(abs(area_a - area_b), 6) AS diff, round(CASE WHEN greatest(area_a, area_b) = 0 THEN 0 ELSE abs(area_a - area_b) / greatest(area_a, area_b) END, 6) AS rel, round(CASE WHEN least(area_a, area_b) <= 0 THEN 0 ELSE abs(ln(area_a / area_b)) END, 6) AS logr FROM pr")
def numeric_comparators(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("area_a"), F.col("area_b")
    return _pairs(spark, sf).select("key_a", r6(numeric.ratio(a, b)).alias("ratio"), r6(numeric.absolute_difference(a, b)).alias("diff"), r6(numeric.relative_difference(a, b)).alias("rel"), r6(numeric.log_ratio(a, b)).alias("logr"))


def _full_pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = F.lit(None).cast("string")
    return _pairs(spark, sf).withColumns({f"{c}_{s}": n for c in ("block", "pargana") for s in ("a", "b")})


@query()
def pair_features_104(spark: SparkSession, sf: str) -> DataFrame:
    return features.pair_features(_full_pairs(spark, sf), ["key_a", "key_b"])


_T = {"district": "district", "village": "village", "khasra": "khasra"}


def _m4(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[_/\\\\-]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"{PAIRED}, n AS (SELECT key_a, {', '.join(f'{_m4(c + s)} AS {c}{s}' for c in _T for s in ('_a', '_b'))}, area_a, area_b FROM pr) SELECT key_a, {', '.join(f'({c}_a <> {chr(39)}{chr(39)} AND {c}_a = {c}_b)::INT::DOUBLE AS {c}__exact, least(length({c}_a), 100)::DOUBLE AS {c}__len_a, ({c}_a = {chr(39)}{chr(39)} AND {c}_b = {chr(39)}{chr(39)})::INT::DOUBLE AS {c}__both_empty' for c in _T)}, round(least(abs(area_a - area_b) / greatest(abs(area_a), abs(area_b), 1e-9), 10), 6) AS area__relative_diff, (abs(area_a - area_b) / greatest(abs(area_a), abs(area_b), 1e-9) <= 0.05)::INT::DOUBLE AS area__close_5pct FROM n")
def pair_features_plain(spark: SparkSession, sf: str) -> DataFrame:
    f = features.pair_features(_full_pairs(spark, sf), ["key_a"], fuzzy_columns=False)
    return f.select("key_a", *[f"{c}__{s}" for c in _T for s in ("exact", "len_a", "both_empty")], r6(F.col("area__relative_diff")).alias("area__relative_diff"), "area__close_5pct")


def _records54(spark: SparkSession, sf: str) -> DataFrame:
    have = {"village", "district", "khasra", "tehsil"}
    p = parcels(spark, sf)
    return p.select("row_ix", *[F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in features.RECORD_FIELDS])


@query()
def record_features_54(spark: SparkSession, sf: str) -> DataFrame:
    return features.record_features(_records54(spark, sf), ["row_ix"])


@query(f"{WITH}, n AS (SELECT row_ix, {_m4('district')} AS d, {_m4('khasra')} AS k, khasra FROM parcels), fd AS (SELECT d, count(*) AS f FROM n WHERE d <> '' GROUP BY 1), fk AS (SELECT k, count(*) AS f FROM n WHERE k <> '' GROUP BY 1) SELECT row_ix, coalesce(fd.f, 0)::DOUBLE AS district__frequency, round(1 / (1 + coalesce(fd.f, 0)), 6) AS district__rarity, coalesce(fk.f, 0)::DOUBLE AS khasra__frequency, (contains(coalesce(khasra, ''), '/'))::INT::DOUBLE AS khasra__has_slash FROM n LEFT JOIN fd USING (d) LEFT JOIN fk USING (k)")
def frequency_rarity(spark: SparkSession, sf: str) -> DataFrame:
    f = features.record_features(_records54(spark, sf), ["row_ix"])
    return f.select("row_ix", "district__frequency", r6(F.col("district__rarity")).alias("district__rarity"), "khasra__frequency", "khasra__has_slash")


@query()
def schema_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.schema_features(_full_pairs(spark, sf), ["key_a"], ["village_jaro_winkler", "khasra_exact", "area_ratio", "district_token_sort", "ulpin_both_present"])


_VEC = "SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a")


@query(f"SELECT a, b, round(list_cosine_similarity(x::DOUBLE[], y::DOUBLE[]), 4) AS s FROM ({_VEC})")
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("a", "b", F.round(numeric.cosine(F.col("x"), F.col("y")), 4).alias("s"))


@query(f"SELECT a, b, round(1 / (1 + list_distance(x::DOUBLE[], y::DOUBLE[])), 4) AS s FROM ({_VEC})")
def euclidean_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("a", "b", F.round(1 / (1 + numeric.euclidean(F.col("x"), F.col("y"))), 4).alias("s"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS p, round(exp(l_discount) / (exp(l_tax) + exp(l_discount)), 6) AS q, round(0.75 * l_discount + 0.25 * least(1, greatest(0, (l_tax - 0.01) / 0.05)), 6) AS h, round(CASE WHEN l_quantity > 0 THEN ln(1 + l_quantity) ELSE 0 END, 6) AS lg FROM lineitem")
def probability_functions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(numeric.sigmoid((F.col("l_quantity") - 25) / 10)).alias("p"), r6(numeric.softmax2(F.col("l_tax"), F.col("l_discount"))).alias("q"), r6(numeric.hybrid(F.col("l_discount"), F.col("l_tax"), 0.01, 0.06)).alias("h"), r6(numeric.log1p_positive(F.col("l_quantity"))).alias("lg"))


# --- scoring and masks ----------------------------------------------------------------------------------------


@query()
def entity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of pairs by a scorer trained here on the pairs' own exact identifiers."""
    f = features.pair_features(_full_pairs(spark, sf), ["key_a", "key_b"], fuzzy_columns=False)
    names = [c for c in f.columns if c.startswith(("village__", "district__", "khasra__", "area__"))]
    labelled = f.withColumn("label", (F.col("cross__exact_field_ratio") > 0.6).cast("double"))
    return scoring.score(scoring.fit_scorer(labelled, names), f, 0.05).select("key_a", "key_b", r6(F.col("probability")).alias("probability"), "decision")


@query()
def isolation_scores(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return scoring.IsolationForest.fit(li, names).score(li, names).select("l_orderkey", "l_linenumber", r6(F.col("isolation")).alias("isolation"))


@query("SELECT min(l_discount) AS min, max(l_discount) AS max, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, count(*) FILTER (l_discount >= 0.05)::BIGINT AS positive_count, round(100.0 * count(*) FILTER (l_discount >= 0.05) / count(*), 6) AS positive_percent, round(avg(l_discount) FILTER (l_discount >= 0.05), 6) AS mean_positive FROM lineitem")
def mask_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = scoring.mask_statistics(table(spark, sf, "lineitem"), "l_discount", 0.05)
    return m.select("min", "max", *[r6(F.col(c)).alias(c) for c in ("mean", "std")], "positive_count", *[r6(F.col(c)).alias(c) for c in ("positive_percent", "mean_positive")])


@query("WITH c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM (SELECT l_returnflag = 'R' AS t, l_discount >= 0.05 AS p FROM lineitem)) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall, round(tp / (tp + fp + fn + 1e-9), 6) AS iou, round((tp + tn) / (tp + fp + fn + tn + 1e-9), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn + 1e-9), 6) AS dice FROM c")
def segmentation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = scoring.segmentation_metrics(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", F.col("l_discount") >= 0.05)
    return m.select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "iou", "accuracy", "dice")])


@query()
def mask_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines of the masks of eight tiles for every 4001 order keys."""
    from landweave.operators.imaging import mask_outlines

    m = table(spark, sf, "lineitem").select((F.floor(F.col("l_orderkey") / 4001) * 8 + F.col("l_orderkey") % 8).alias("tile_id"), (F.col("l_orderkey") / 8 % 32).cast("int").alias("row"), (F.col("l_partkey") % 32).cast("int").alias("col"), F.col("l_discount").alias("prob")).groupBy("tile_id", "row", "col").agg(F.max("prob").alias("prob"))
    return mask_outlines(m, 0.05, 1).select("tile_id", "polygon_ix", r6(F.col("area")).alias("area"), "space")


# --- catalogue, dashboard, history ----------------------------------------------------------------------------


@query(f"{KEYED} SELECT (SELECT count(DISTINCT source_id) FROM keyed)::BIGINT AS sources, (SELECT count(*) FROM keyed)::BIGINT AS features, (SELECT count(DISTINCT identity_key) FROM keyed)::BIGINT AS parcels, coalesce(round((SELECT avg(CASE WHEN ulpin IS NOT NULL THEN 0.9 ELSE 0.5 END) FROM keyed), 4), 0.0) AS average_confidence")
def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    from landweave.operators.catalog import dashboard

    return dashboard(keyed(spark, sf).withColumn("confidence", F.when(F.col("ulpin").isNotNull(), 0.9).otherwise(0.5)))


@query("SELECT o_orderkey AS job_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_job(spark: SparkSession, sf: str) -> DataFrame:
    from landweave.operators.catalog import latest

    return latest(table(spark, sf, "orders"), "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("job_id"))


@query(f"{WITH} SELECT source_id AS layer_id, count(*)::BIGINT AS feature_count FROM parcels GROUP BY 1")
def source_layers(spark: SparkSession, sf: str) -> DataFrame:
    from landweave.operators.catalog import layers

    return layers(parcels(spark, sf)).select("layer_id", "feature_count")


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS best FROM orders")
def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.max("o_totalprice").over(w).alias("best"))


@query("WITH f AS (SELECT concat('img_', doc_id % 500, CASE WHEN doc_id % 2 = 0 THEN '_mask' ELSE '_image' END, '.png') AS path, doc_id FROM documents), s AS (SELECT replace(replace(replace(path, '.png', ''), '_mask', ''), '_image', '') AS id, path LIKE '%mask%' AS m, doc_id FROM f) SELECT id, count(*)::BIGINT AS n FROM s GROUP BY 1")
def image_mask_pairs(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("dir/img_"), (F.col("doc_id") % 500).cast("string"), F.when(F.col("doc_id") % 2 == 0, "_mask").otherwise("_image"), F.lit(".png"))
    return table(spark, sf, "documents").select(text.stem_clean(path).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 3 = 1))::BIGINT AS train_val, (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 6 = 0))::BIGINT AS train_test")
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").dropDuplicates(["doc_id"])
    train, val, test = d.filter("doc_id % 3 = 0"), d.filter("doc_id % 3 = 1"), d.filter("doc_id % 6 = 0")
    a = train.join(val, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("train_val")).withColumn("k", F.lit(1))
    return a.join(train.join(test, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("train_test")).withColumn("k", F.lit(1)), "k").drop("k")


@query(f"{WITH} SELECT row_ix, CASE WHEN row_ix % 2 = 0 THEN concat('R', row_ix) END AS geometry FROM parcels")
def withhold_unknown_crs(spark: SparkSession, sf: str) -> DataFrame:
    crs = F.when(F.col("row_ix") % 2 == 0, "EPSG:4326")
    return parcels(spark, sf).select("row_ix", F.when(crs.isNotNull(), F.concat(F.lit("R"), F.col("row_ix"))).alias("geometry"))


@query(f"{WITH} SELECT source_id, string_agg(k, ',' ORDER BY k) AS header FROM (SELECT DISTINCT source_id, unnest(['district', 'geometry_geojson', 'khasra', 'ulpin']) AS k FROM parcels) GROUP BY 1")
def export_header(spark: SparkSession, sf: str) -> DataFrame:
    from landweave.operators.catalog import export_header as header

    p = parcels(spark, sf).withColumn("attributes", F.create_map(F.lit("khasra"), F.col("khasra"), F.lit("ulpin"), F.col("ulpin"), F.lit("district"), F.col("district")))
    return header(p, "source_id", "attributes")


@query()
def export_geojson(spark: SparkSession, sf: str) -> DataFrame:
    from landweave.operators.catalog import geojson_features

    p = parcels(spark, sf).withColumns({"geometry": F.concat(F.lit('{"type":"Point","coordinates":['), F.col("minx").cast("string"), F.lit(","), F.col("miny").cast("string"), F.lit("]}")), "crs": F.lit("EPSG:4326"), "attributes": F.create_map(F.lit("ulpin"), F.col("ulpin"), F.lit("district"), F.col("district"))})
    return geojson_features(p)


# --- streams (extension): the batch result equals the stream's --------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    from landweave.streaming.events import run_available, tumbling_counts

    return run_available(spark, f"{sf}/events.parquet", tumbling_counts, "complete")


@query("SELECT event_id, event_type, user_id FROM events GROUP BY ALL")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from landweave.streaming.events import deduplicated, run_available

    return run_available(spark, f"{sf}/events.parquet", deduplicated, "append").select("event_id", "event_type", "user_id")


@query()
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    from landweave.streaming.events import run_available, session_counts

    return run_available(spark, f"{sf}/events.parquet", session_counts, "complete")


