import json

import numpy as np

from landweave.functions.crs import earth_centred, lonlat_arrays, utm_forward
from landweave.operators.proximity import KdSplits, close_pairs, near_pairs, points_in_regions, regions_containing, with_point_position


def test_utm_round_trip():
    lon, lat = np.array([77.2090, 75.2]), np.array([28.6139, -10.0])
    x, y = utm_forward(lon, lat, 43)
    assert 700_000 < x[0] < 730_000
    assert 3.1e6 < y[0] < 3.2e6
    back = lonlat_arrays(x, y, np.array([32643.0, 32643.0]))
    assert np.allclose(back[0], lon, atol=1e-9)
    assert np.allclose(back[1], lat, atol=1e-9)


def test_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    pts = np.r_[rng.random((400, 3)), np.repeat(rng.random((1, 3)), 60, axis=0)]
    found = {tuple(sorted((int(a), int(b)))) for i, j in close_pairs(pts, 0.08) for a, b in zip(i, j, strict=True)}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    assert found == {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if d[i, j] <= 0.08}


def test_halo_covers_every_pair():
    rng = np.random.default_rng(2)
    pts = rng.random((300, 3))
    index, leaf, home = KdSplits(pts, 4).leaves(pts, 0.05)
    assert (np.bincount(index[home], minlength=300) == 1).all()
    of = {i: set(leaf[index == i]) for i in range(300)}
    own = {i: leaf[(index == i) & home][0] for i in range(300)}
    for i in range(300):
        for j in np.nonzero(np.sqrt(((pts - pts[i]) ** 2).sum(1)) <= 0.05)[0]:
            assert own[i] in of[j]


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    lon, lat = 75 + rng.random(300) * 0.01, 24 + rng.random(300) * 0.01
    rows = [(f"p{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat, strict=True))] + [("same1", 75.0, 24.0), ("same2", 75.0, 24.0), ("same1", 75.0, 24.0), (None, 75.0, 24.0), ("nowhere", None, None)]
    got = {(r["left_key"], r["right_key"]) for r in near_pairs(spark.createDataFrame(rows, "k string, lon double, lat double"), "k", "lon", "lat", 60.0).collect()}
    xyz = earth_centred(lon, lat)
    want = {(f"p{i:03d}", f"p{j:03d}") for i in range(300) for j in range(i + 1, 300) if np.sqrt(((xyz[i] - xyz[j]) ** 2).sum()) <= 60} | {("same1", "same2")}
    assert {p for p in got if p[0][0] == "p" and p[1][0] == "p"} | {("same1", "same2")} == want
    assert ("same1", "same2") in got
    assert near_pairs(spark.createDataFrame([], "k string, lon double, lat double"), "k", "lon", "lat", 60.0).count() == 0


def test_positions(spark):
    rows = [(1, '{"type":"Point","coordinates":[75.5,24.5,300]}', None), (2, "POINT (75.5 24.5)", "EPSG: 4326"), (3, "POINT (500000 2700000)", None), (4, '{"type":"Point","coordinates":[75.5,', "4326"), (5, "POINT EMPTY", "4326"), (6, '{"type":"Polygon","coordinates":[[[1,2],[2,3],[3,1],[1,2]]]}', "4326"), (7, "POINT (500000 2700000)", "urn:ogc:def:crs:EPSG::32643"), (8, None, None), (9, "POINT (1 2)", "EPSG:9999")]
    got = {r["id"]: r["lon"] for r in with_point_position(spark.createDataFrame(rows, "id int, geometry string, crs string"), "geometry", "crs").collect()}
    assert got[1] == got[2] == 75.5
    assert round(got[7], 6) == 75.0
    assert all(got[i] is None for i in (3, 4, 5, 6, 8, 9))


def test_regions(spark):
    holed = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]})
    two = json.dumps({"type": "MultiPolygon", "coordinates": [[[[20, 0], [30, 0], [30, 10], [20, 0]]], [[[3, 3], [7, 3], [7, 7], [3, 7], [3, 3]]]]})
    zones = spark.createDataFrame([("h", holed, "EPSG:4326"), ("m", two, "OGC:CRS84"), ("bad", "{", "EPSG:4326"), ("unknown", holed, "EPSG:1")], "z string, g string, c string")
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 5.0, 5.0), ("c", 28.0, 2.0), ("d", 50.0, 50.0), ("e", None, 1.0)], "k string, lon double, lat double")
    got = {tuple(r) for r in regions_containing(points, "k", "lon", "lat", zones, "z", "g", "c").collect()}
    assert got == {("a", "h"), ("b", "m"), ("c", "m")}
    assert regions_containing(points, "k", "lon", "lat", zones.limit(0), "z", "g", "c").count() == 0


def test_sweep_equals_ray_casting():
    from landweave.functions.geometry import contains

    rng = np.random.default_rng(4)
    angle = np.sort(rng.random(25) * 2 * np.pi)
    ring = np.stack([np.cos(angle), np.sin(angle)], 1) * (0.4 + rng.random((25, 1)))
    ring = np.r_[ring, ring[:1]]
    a, b = ring[:-1], ring[1:]
    swap = (a[:, 0] > b[:, 0])[:, None]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    edges = {"x1": a[:, 0], "y1": a[:, 1], "x2": b[:, 0], "y2": b[:, 1], "region": np.zeros(25, dtype=int)}
    pts = rng.random((500, 2)) * 3 - 1.5
    got = {int(i) for at, _ in points_in_regions(pts[:, 0], pts[:, 1], edges, np.array(["r"])) for i in at}
    assert got == {i for i, p in enumerate(pts) if contains([[ring]], *p)}


def test_regions_in_many_strips(spark, monkeypatch):
    """Strips of few points, and a third of all points at one x: the rows stay those of one strip."""
    from landweave.operators import proximity

    rng = np.random.default_rng(5)
    at = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((400, 2)) * 10)] + [(f"q{i}", 5.0, float(y)) for i, y in enumerate(rng.random(200) * 10)]
    zones = [(f"z{i}", json.dumps({"type": "Polygon", "coordinates": [[[i, 0], [i + 3, 1], [i + 2, 9], [i, 8], [i, 0]]]}), "EPSG:4326") for i in range(7)]
    points, regions = spark.createDataFrame(at, "k string, lon double, lat double"), spark.createDataFrame(zones, "z string, g string, c string")
    one = {tuple(r) for r in regions_containing(points, "k", "lon", "lat", regions, "z", "g", "c").collect()}
    monkeypatch.setattr(proximity, "STRIP_POINTS", 20)
    assert {tuple(r) for r in regions_containing(points, "k", "lon", "lat", regions, "z", "g", "c").collect()} == one
    assert len(one) > 600
