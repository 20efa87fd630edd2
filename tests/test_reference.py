"""Goldens of the land-record operators, and every query with SQL against DuckDB on the smallest data."""

import datetime
import json
import math
import os
import sqlite3
import struct
import zipfile
from pathlib import Path

import duckdb
import numpy as np
import pytest

from landweave.functions import fuzzy
from landweave.functions import geometry as G
from landweave.operators.imaging import png, read_png
from landweave.plans import reference
from landweave.types import InvalidInput

SF = "/root/testdata/sf0.001"
SQUARE, BOWTIE = "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))", "POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))"


def shape(text):
    return G.polygons(*G.parse(text))


def test_geometry_goldens():
    inter, _, iou, fa, _ = G.overlap_metrics(shape(SQUARE), shape("POLYGON ((5 0, 15 0, 15 10, 5 10, 5 0))"))
    assert (inter, round(iou, 9), fa) == (50.0, round(1 / 3, 9), 0.5)
    assert "elf-intersection" in G.validity(*G.parse(BOWTIE))[1]
    how, kind, parts = G.repair(*G.parse(BOWTIE))
    assert (how, kind, G.area(parts)) == ("make_valid", "MultiPolygon", 50.0)
    assert G.repair(*G.parse(SQUARE))[0] == "none"
    assert G.distance(shape(SQUARE), shape("POLYGON ((20 0, 25 0, 25 10, 20 10, 20 0))")) == 10.0
    pts = G.boundary_sample(shape("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))"), 4)
    assert np.allclose(np.abs(pts), 1 / math.sqrt(2))


def test_overlap_area_against_jts(spark):
    jts = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = np.random.default_rng(5)
    for _ in range(40):
        rings = []
        for _ in range(2):
            angle = np.sort(rng.random(9)) * 2 * np.pi
            if np.diff(np.r_[angle, angle[0] + 2 * np.pi]).max() > 3.0:
                angle = np.linspace(0, 2 * np.pi, 9, endpoint=False)
            r = np.stack([np.cos(angle), np.sin(angle)], 1) * (0.3 + rng.random((9, 1))) + rng.random(2)
            rings.append(np.r_[r, r[:1]])
        wkts = ["POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in r.tolist()) + "))" for r in rings]
        a, b = (jts.read(w) for w in wkts)
        assert math.isclose(G.intersection_area([[rings[0]]], [[rings[1]]]), a.intersection(b).getArea(), rel_tol=1e-9, abs_tol=1e-12)


def test_mask_outline_and_png():
    m = np.zeros((5, 5))
    m[1:4, 1:4], m[2, 2], m[0, 0] = 1, 0, 1
    assert sorted(a for _, a in G.mask_polygons(m)) == [1.0, 8.0]
    assert read_png(png(np.array([[0, 1], [0.5, 0.25]])))[..., 0].tolist() == [[0, 255], [128, 64]]


def test_fuzzy():
    assert round(fuzzy.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert fuzzy.token_set("new york mets", "mets york new city") == 100.0
    assert fuzzy.partial("york", "new york city") == 100.0
    assert fuzzy.wratio("", "x") == 0.0


def test_feature_names():
    from landweave.operators.features import PAIR_FEATURES, RECORD_FEATURES, parse_feature_name

    assert (len(PAIR_FEATURES), len(set(PAIR_FEATURES)), len(RECORD_FEATURES), len(set(RECORD_FEATURES))) == (104, 104, 54, 54)
    assert parse_feature_name("village_jaro_winkler") == ("village", "jaro_winkler")
    with pytest.raises(ValueError, match="unknown comparator"):
        parse_feature_name("village_sounds_like")


def _collection():
    ring = [[77.0, 28.0], [77.1, 28.0], [77.1, 28.1], [77.0, 28.1], [77.0, 28.0]]
    return json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "A", "properties": {"Village": "Sultanpur", "khasra": "121/2", "ulpin": None, "unique_land_parcel_id": "X", "area": 0}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"district": "Agra"}, "geometry": {"type": "Point", "coordinates": [77.0, 28.0]}},
        {"type": "Feature", "properties": {}, "geometry": None},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [10, 10], [10, 0], [0, 10], [0, 0]]]}},
    ]})


def test_ingest_harmonise_export(spark, tmp_path):
    from landweave.engine import Engine

    engine = Engine(spark, str(tmp_path / "catalog"))
    got = engine.ingest_payload(_collection(), "revenue")
    rows = {r["record_id"]: r for r in got.records.collect()}
    assert set(rows) == {"A", "revenue-1"}
    assert rows["A"]["ulpin"] is None  # the first present key holds even where null
    assert rows["A"]["area"] is None  # zero counts as missing
    assert rows["A"]["crs"] == "EPSG:4326"
    assert rows["A"]["missing_fields"] == ["district", "tehsil", "parcel_type"]
    stats = got.statistics.collect()[0]
    assert (stats["total_records"], stats["valid_records"], stats["invalid_records"]) == (4, 2, 2)
    assert got.rejected.count() == 2
    other = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"ulpin": "UP-456", "district": d}, "geometry": {"type": "Point", "coordinates": [77.0, 28.0]}} for d in ("Agra", "Mathura")]}
    engine.ingest_payload(json.dumps({**other, "features": other["features"][:1]}), "a")
    engine.ingest_payload(json.dumps({**other, "features": other["features"][1:]}), "b")
    done = engine.harmonize(["a", "b"])
    assert [(r["field"], r["values"], r["severity"]) for r in done.conflicts.collect()] == [("district", ["Agra", "Mathura"], "high")]
    assert done.features.collect()[0]["district"] is None
    assert engine.lookup(" up-456 ").count() == 2
    engine.export_source("a", "csv", str(tmp_path / "out"))
    assert "geometry_geojson" in next(Path(tmp_path / "out").glob("*.csv")).read_text().splitlines()[0]
    assert engine.catalog.drop("b")
    with pytest.raises(InvalidInput):
        engine.ingest_payload("[]", "bad")


def test_csv_kml_and_shapefile(spark, tmp_path):
    from landweave.sources import readers

    (tmp_path / "p.csv").write_text("Latitude,LON,parcel_id\n28.0,77.0,P-1\n,77.0,P-2\n")
    rows = readers.read_csv_points(spark, str(tmp_path / "p.csv"), source_crs="EPSG:4326").collect()
    assert [(r["crs"], r["valid"]) for r in rows] == [("EPSG:4326", True), ("EPSG:4326", False)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(InvalidInput):
        readers.read_csv_points(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "k.kml").write_text("<kml><Document><Placemark><name>n1</name><Polygon><outerBoundaryIs><LinearRing><coordinates>77,28 77.1,28 77.1,28.1 77,28</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>")
    k = readers.read_kml(spark, str(tmp_path / "k.kml")).collect()[0]
    assert (k["geometry_type"], k["properties"]["name"], k["crs"]) == ("Polygon", "n1", "EPSG:4326")

    body = struct.pack("<i2d", 1, 77.0, 28.0)
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + struct.pack(">2I", 1, len(body) // 2) + body)
    field = b"village\0\0\0\0C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4xIHH20x", 1, 32 + 32 + 1, 11) + field + b"\x0d" + b" " + b"North".ljust(10))
    (tmp_path / "s.prj").write_text('GEOGCS["WGS 84"]')
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for n in ("s.shp", "s.dbf", "s.prj"):
            z.write(tmp_path / n, n)
    s = readers.read_shapefile(spark, str(tmp_path / "s.zip")).collect()[0]
    assert (s["properties"]["village"], s["crs"], s["valid"]) == ("North", "EPSG:4326", True)


def test_geopackage(spark, tmp_path):
    from landweave.sources import readers

    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.execute("create table gpkg_geometry_columns (table_name, column_name, srs_id)")
    db.execute("create table gpkg_spatial_ref_sys (srs_id, organization, organization_coordsys_id)")
    db.execute("create table t (fid integer, geom blob, village text)")
    db.execute("insert into gpkg_geometry_columns values ('t', 'geom', 4326)")
    db.execute("insert into gpkg_spatial_ref_sys values (4326, 'EPSG', 4326)")
    db.execute("insert into t values (1, ?, 'North')", (b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BIdd", 1, 1, 77.0, 28.0),))
    db.commit()
    db.close()
    r = readers.reader_for("x.gpkg")(spark, str(tmp_path / "g.gpkg")).collect()[0]
    assert (r["properties"]["village"], r["crs"], r["geometry_type"]) == ("North", "EPSG:4326", "Point")


def test_confidence_goldens(spark):
    from landweave.operators import compare

    df = spark.createDataFrame([(0.9, 0.8, None, ["critical"])], "m double, g double, a double, s array<string>")
    r = compare.confidence(df, {"model": "m", "geometric": "g", "attribute": "a"}, "s").collect()[0]
    assert math.isclose(r["base_confidence"], math.exp((0.35 * math.log(0.9) + 0.25 * math.log(0.8)) / 0.6))
    assert (r["conflict_factor"], r["missing_channels"]) == (0.5, ["attribute"])
    bad = spark.createDataFrame([(1.4, ["low"])], "m double, s array<string>")
    with pytest.raises(Exception, match="must lie between"):
        compare.confidence(bad, {"model": "m"}, "s").collect()


def test_gaps_by_batches(spark):
    """Blocks are found in runs of sorted rows, without a call for each, and may go on in the next batch."""
    import pandas as pd

    from landweave.operators import topology

    ring = [("n", 0, 2, 3, 3), ("s", 0, 0, 3, 1), ("w", 0, 1, 1, 2), ("e", 2, 1, 3, 2)]
    shapes = [(f"{b}{n}", f"POLYGON (({b + x} {y}, {b + u} {y}, {b + u} {v}, {b + x} {v}, {b + x} {y}))") for b in (10, 20, 30) for n, x, y, u, v in ring]
    shapes += [("l", '{"type":"Polygon","coordinates":[[[50,0],[53,0],[53,1],[51,1],[51,3],[50,3]]]}'), ("j", "POLYGON ((51 2, 52 2, 52 1, 53 1, 53 3, 51 3, 51 2))"), ("x", None), ("y", "POLYGON EMPTY"), ("z", "no")]
    found = topology.gaps(spark.createDataFrame(shapes, "feature_id string, geometry string"))
    assert "InPandas" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "FlatMapGroups" not in plan
    want = {(f"{b}e", 0, 1.0, tuple(f"{b}{n}" for n in "ensw")) for b in (10, 20, 30)} | {("j", 0, 1.0, ("j", "l"))}
    assert {(r["block"], r["gap"], r["area"], tuple(r["feature_ids"])) for r in found.collect()} == want
    rows = next(topology._outlines(iter([pd.DataFrame(shapes, columns=["id", "geometry"])]))).assign(component=[*"aaaabbbbcccc", "d", "d"])
    assert rows["shape"].notna().sum() == 2
    for at in range(len(rows) + 1):
        parts = list(topology._block_gaps(iter([rows[:at], rows[at:]])))
        assert [r.block for p in parts for r in p.itertuples()] == [*"abcd"]


def test_scorer_after_observed_table(spark):
    """A table counted while it was written leaves state in the session that no task can be sent."""
    from landweave.operators import scoring
    from landweave.session import counted, cut

    rows = cut(spark.createDataFrame([(i, i / 20, float(i > 9)) for i in range(20)], "k int, x double, label double"))
    assert counted(rows) == 20
    got = {r["k"]: r["decision"] for r in scoring.score(scoring.fit_scorer(rows, ["x"]), rows, 0.5).collect()}
    assert got == {i: "match" if i > 9 else "no_match" for i in range(20)}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


def test_queries_over_whole_tables(spark, tmp_path):
    lines = [(4001, 1, 0.06), (4001, 2, 0.06), (1, 5, 0.06)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["tile_id"], r["area"]) for r in reference.mask_polygons(spark, str(tmp_path)).collect()}
    assert got == {(1, 1.0), (9, 2.0)}
    spark.createDataFrame([(7,), (21,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert {(r["block"], r["area"], r["ids"]) for r in reference.gap_cells_whole(spark, str(tmp_path)).collect()} == {(7, 100.0, "e;n;s;w"), (21, 100.0, "e;n;s;w")}


@pytest.mark.parametrize("name", sorted(reference.SQL))
@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = reference.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    cursor = db.execute(reference.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_norm(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
