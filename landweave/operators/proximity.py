"""Points near other points, and points in regions, on the WGS84 ellipsoid.

Near: locations become three-dimensional unit vectors; k-d splits (fitted on a bounded sample) part them into
leaves, each with halo copies of the locations within the radius outside it; a k-d tree inside each leaf is
queried by chord radius, and the distance on the ellipsoid decides. Regions: the plane of each coordinate system is
parted into upright strips of about equally many points; edges go to every strip they touch, and a sweep along x
inside each strip counts the edges below every point.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions.crs import earth_centred, epsg_code, from_lonlat, unit_vector, with_lonlat
from landweave.session import counted, cut

#: Locations sampled to place the k-d splits: at least, for each leaf, and at most; every location is then indexed.
SPLIT_SAMPLE, SAMPLE_A_LEAF, MOST_SAMPLE = 50_000, 16, 2_000_000
#: Locations a leaf should hold.
LEAF_ROWS = 20_000
#: Points a strip should hold; a strip with more (many points of one x) is split over several tasks with the same edges.
STRIP_POINTS = 20_000
#: Points compared at once with the edges above and below them.
SWEEP_POINTS = 256
#: Least radius of curvature of the ellipsoid: bounds the chord between unit normals a distance apart.
LEAST_RADIUS = 6_335_439.0
_BUCKET = 48
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def with_point_position(df: DataFrame, geometry: str, crs: str) -> DataFrame:
    """Add ``lon`` and ``lat`` (replacing such columns) of Point texts (GeoJSON or WKT, x,y order, further coordinates ignored).

    A stated CRS holds; a null or blank one counts as EPSG:4326 where the coordinates can be degrees. Null for
    other geometries, empty, cut-off or non-numeric texts, unknown systems and positions off the globe.
    """
    text, system = F.col(geometry), F.col(crs)
    doc = F.from_json(text, "type string, coordinates array<double>")
    wkt = rf"(?i)^\s*(?:SRID=\d+;)?\s*POINT\s*(?:Z|M|ZM)?\s*\(\s*({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*\s*\)\s*$"
    whole = text.rlike(r"(?s)^\s*\{.*\}\s*$") & (doc["type"] == "Point") & (F.size(doc["coordinates"]) >= 2)

    def coordinate(i: int) -> Column:
        return F.when(whole, F.get(doc["coordinates"], F.lit(i))).otherwise(F.regexp_extract(text, wkt, i + 1).try_cast("double"))

    blank = system.isNull() | (F.trim(system) == "")
    return with_lonlat(df.drop("lon", "lat").withColumns({"__x": coordinate(0), "__y": coordinate(1), "__code": F.when(blank, F.lit(4326)).otherwise(epsg_code(system))}), "__x", "__y", "__code")


class KdSplits:
    """Axis-parallel splits of space: node i has children 2i+1 and 2i+2; the last level holds the leaves."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros(2**depth, dtype=np.int64), np.zeros(2**depth)
        groups = {0: sample}
        for node in range(2**depth - 1):
            pts = groups.pop(node)
            if len(pts):
                self.axis[node] = int(np.argmax(pts.max(0) - pts.min(0)))
                self.value[node] = float(np.median(pts[:, self.axis[node]]))
            left = pts[:, self.axis[node]] <= self.value[node]
            groups[2 * node + 1], groups[2 * node + 2] = pts[left], pts[~left]

    def leaves(self, pts: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of point, leaf, whether the leaf is the point's own) for every leaf within ``radius``."""
        index, node, home = np.arange(len(pts)), np.zeros(len(pts), dtype=np.int64), np.ones(len(pts), dtype=bool)
        for _ in range(self.depth):
            gap = pts[index, self.axis[node]] - self.value[node]
            own_left = gap <= 0
            left, right = gap - radius <= 0, gap + radius >= 0
            index, home, node = np.r_[index[left], index[right]], np.r_[home[left] & own_left[left], home[right] & ~own_left[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2]
        return index, node - (2**self.depth - 1), home


def close_pairs(pts: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j in some order, each once) no further apart than ``radius``: dual walk of a k-d tree."""
    n = len(pts)
    if n < 2:
        return
    order = np.arange(n)
    nodes: list[tuple[int, int, np.ndarray, np.ndarray, int]] = []  # start, end, low, high, left child or -1

    def build(lo: int, hi: int) -> int:
        me = len(nodes)
        nodes.append(None)  # type: ignore[arg-type]
        own = pts[order[lo:hi]]
        low, high = own.min(0), own.max(0)
        if hi - lo <= _BUCKET:
            nodes[me] = (lo, hi, low, high, -1)
            return me
        mid = (lo + hi) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(own[:, int(np.argmax(high - low))], mid - lo)]
        build(lo, mid)
        right = build(mid, hi)
        nodes[me] = (lo, hi, low, high, right)
        return me

    build(0, n)
    r2 = radius * radius
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        alo, ahi, amin, amax, aright = nodes[a]
        blo, bhi, bmin, bmax, bright = nodes[b]
        if a == b:
            if aright < 0:
                i, j = np.triu_indices(ahi - alo, 1)
                i, j = order[alo + i], order[alo + j]
                near = ((pts[i] - pts[j]) ** 2).sum(1) <= r2
                if near.any():
                    yield i[near], j[near]
            else:
                stack += [(a + 1, a + 1), (aright, aright), (a + 1, aright)]
            continue
        apart = np.maximum(0, np.maximum(amin - bmax, bmin - amax))
        if apart @ apart > r2:
            continue
        if aright < 0 and bright < 0:
            i, j = order[alo:ahi], order[blo:bhi]
            near = ((pts[i][:, None, :] - pts[j][None, :, :]) ** 2).sum(2) <= r2
            if near.any():
                x, y = np.nonzero(near)
                yield i[x], j[y]
        elif bright < 0 or (aright >= 0 and ahi - alo >= bhi - blo):
            stack += [(a + 1, b), (aright, b)]
        else:
            stack += [(a, b + 1), (a, bright)]


def _distance(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres along the ellipsoid from the straight chord; within a micrometre up to 10 km."""
    chord = np.sqrt(((earth_centred(lon1, lat1) - earth_centred(lon2, lat2)) ** 2).sum(-1))
    return chord * (1 + chord**2 / (24 * 6_371_000.0**2))


def near_pairs(points: DataFrame, key: str, lon: str, lat: str, metres: float) -> DataFrame:
    """(left_key, right_key, distance_m): every pair of different keys at most ``metres`` apart, once, left < right.

    Rows with a null key or position are left out; a key with several positions counts at each and keeps its least
    distance; repeated rows change nothing. Locations shared by many keys are held once in the trees and opened by joins.
    """
    if metres > 10_000:
        raise ValueError("near_pairs measures up to 10 km")
    spark = points.sparkSession
    members = points.select(F.col(key).cast("string").alias("k"), (F.col(lon) + 0.0).alias("lon"), (F.col(lat) + 0.0).alias("lat")).filter("k is not null and lon is not null and lat is not null").distinct()
    members = cut(members)
    spots = members.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    count = spots.count()
    rows = min(LEAF_ROWS, max(1000, count // (4 * spark.sparkContext.defaultParallelism)))
    depth = max(0, int(np.ceil(np.log2(max(1, count) / rows))))
    wanted = min(MOST_SAMPLE, max(SPLIT_SAMPLE, SAMPLE_A_LEAF * 2**depth))
    sample = spots.select("lon", "lat").sample(min(1.0, wanted / max(1, count)), seed=7).toPandas()
    splits = KdSplits(unit_vector(sample["lon"].to_numpy(float), sample["lat"].to_numpy(float)).reshape(-1, 3), depth)
    radius = metres / LEAST_RADIUS * (1 + 1e-9)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index, leaf, home = splits.leaves(unit_vector(pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float)), radius)
            yield pdf.iloc[index].assign(leaf=leaf, home=home)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            pdf = pd.concat(held, ignore_index=True)
            held.clear()
            x, y = pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float)
            home, n, k = pdf["home"].to_numpy(bool), pdf["n"].to_numpy(), pdf["k"].to_numpy()
            for i, j in close_pairs(unit_vector(x, y), radius):
                swap = (x[i] > x[j]) | ((x[i] == x[j]) & (y[i] > y[j]))
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                a, b = a[home[a]], b[home[a]]  # each pair comes out in the leaf that owns its lesser location
                d = _distance(x[a], y[a], x[b], y[b])
                ok = d <= metres
                a, b, d = a[ok], b[ok], d[ok]
                if len(a):
                    yield pd.DataFrame({"alon": x[a], "alat": y[a], "an": n[a], "ak": k[a], "blon": x[b], "blat": y[b], "bn": n[b], "bk": k[b], "d": d})

        for pdf in batches:
            while len(pdf):
                leaf = pdf["leaf"].iloc[0]
                if held and held[0]["leaf"].iloc[0] != leaf:
                    yield from flush()
                end = int(np.searchsorted(pdf["leaf"].to_numpy(), leaf, side="right"))
                held.append(pdf.iloc[:end])
                pdf = pdf.iloc[end:]
        if held:
            yield from flush()

    parts = max(1, min(2**depth, int(spark.conf.get("spark.sql.shuffle.partitions")) * 8))
    placed = spots.mapInPandas(assign, "lon double, lat double, n long, k string, leaf long, home boolean").repartition(parts, "leaf").sortWithinPartitions("leaf")
    pairs = cut(placed.mapInPandas(search, "alon double, alat double, an long, ak string, blon double, blat double, bn long, bk string, d double"))
    single = pairs.filter("an = 1 and bn = 1").select(F.col("ak").alias("a"), F.col("bk").alias("b"), "d")
    shared = spots.filter("n > 1").select(F.col("lon").alias("alon"), F.col("lat").alias("alat"), F.col("lon").alias("blon"), F.col("lat").alias("blat"), F.lit(0.0).alias("d"))
    several = pairs.filter("an > 1 or bn > 1").select("alon", "alat", "blon", "blat", "d").unionByName(shared)
    opened = several.join(members.select(F.col("lon").alias("alon"), F.col("lat").alias("alat"), F.col("k").alias("a")), ["alon", "alat"]).join(members.select(F.col("lon").alias("blon"), F.col("lat").alias("blat"), F.col("k").alias("b")), ["blon", "blat"]).select("a", "b", "d")
    both = single.unionByName(opened).filter("a <> b")
    return both.groupBy(F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key")).agg(F.min("d").alias("distance_m"))


def polygon_rings(geometry: str | None) -> list[np.ndarray] | None:
    """Rings of a GeoJSON Polygon or MultiPolygon text, or None."""
    try:
        doc = json.loads(geometry or "")
        polygons = [doc["coordinates"]] if doc["type"] == "Polygon" else doc["coordinates"] if doc["type"] == "MultiPolygon" else None
        rings = [np.array([p[:2] for p in ring], dtype=float) for polygon in polygons for ring in polygon]
    except (ValueError, TypeError, KeyError, IndexError):
        return None
    return [r for r in rings if len(r) >= 4] or None


def region_edges(regions: DataFrame, key: str, geometry: str, crs: str) -> DataFrame:
    """(code, region, x1, y1, x2, y2): edges of all readable regions that are not upright, from left to right, in the regions' own systems."""
    schema = "code int, region string, x1 double, y1 double, x2 double, y2 double"

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text, code in zip(pdf["k"], pdf["g"], pdf["code"], strict=True):
                for ring in polygon_rings(text) or ():
                    ring = ring if (ring[0] == ring[-1]).all() else np.r_[ring, ring[:1]]
                    a, b = ring[:-1], ring[1:]
                    swap = (a[:, 0] > b[:, 0])[:, None]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    keep = (a[:, 0] < b[:, 0]) & np.isfinite(a).all(1) & np.isfinite(b).all(1)
                    if keep.any():
                        yield pd.DataFrame({"code": int(code), "region": name, "x1": a[keep, 0], "y1": a[keep, 1], "x2": b[keep, 0], "y2": b[keep, 1]})

    known = F.when(F.col(crs).isNull() | (F.trim(F.col(crs)) == ""), 4326).otherwise(epsg_code(F.col(crs)))
    read = regions.select(F.col(key).cast("string").alias("k"), F.col(geometry).alias("g"), known.cast("int").alias("code")).filter("k is not null and g is not null and code is not null")
    return read.mapInPandas(edges, schema)


def points_in_regions(x: np.ndarray, y: np.ndarray, edges: dict[str, np.ndarray], names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of point, region) for every region that holds the point: an odd number of its edges lies below it (so not in a hole).

    ``edges`` are sorted by region (numbered as in ``names``); points are taken in order of x, so few edges meet each block.
    """
    order = np.argsort(x, kind="stable")
    for begin in range(0, len(order), SWEEP_POINTS):
        at = order[begin : begin + SWEEP_POINTS]
        px, py = x[at], y[at]
        met = np.nonzero((edges["x1"] <= px[-1]) & (edges["x2"] > px[0]))[0]
        if not len(met):
            continue
        x1, y1, x2, y2, region = (edges[c][met] for c in ("x1", "y1", "x2", "y2", "region"))
        over = (x1 <= px[:, None]) & (px[:, None] < x2)
        below = over & (y1 + (px[:, None] - x1) * (y2 - y1) / (x2 - x1) < py[:, None])
        starts = np.r_[0, np.nonzero(np.diff(region))[0] + 1]
        odd = np.add.reduceat(below.astype(np.int32), starts, axis=1) % 2 == 1
        p, r = np.nonzero(odd)
        if len(p):
            yield at[p], names[region[starts[r]]]


def regions_containing(points: DataFrame, key: str, lon: str, lat: str, regions: DataFrame, region_key: str, geometry: str, crs: str) -> DataFrame:
    """(point_key, region_key): every region that contains a position of the point, not in a hole.

    Edges are straight in the region's own system, into which the points are projected. Regions that are
    unreadable, empty, of unknown system or without key contain nothing; points without key or position are left out.
    The driver sees the systems that occur, their extent, and the borders of the strips, no region and no point.
    """
    spark = points.sparkSession
    base = points.select(F.col(key).cast("string").alias("k"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")).filter("k is not null and lon is not null and lat is not null")
    edges = cut(region_edges(regions, region_key, geometry, crs))
    systems = {int(r["code"]): (r["low"], r["high"]) for r in edges.groupBy("code").agg(F.min("x1").alias("low"), F.max("x2").alias("high")).collect()}  # a row per coordinate system

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k, x, y = pdf["k"].to_numpy(), pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float)
            for code, (low, high) in systems.items():
                with np.errstate(all="ignore"):
                    px, py = from_lonlat(x, y, code)
                ok = np.isfinite(px) & np.isfinite(py) & (px >= low) & (px < high)
                if ok.any():
                    yield pd.DataFrame({"code": code, "k": k[ok], "x": px[ok], "y": py[ok]})

    placed = cut(base.mapInPandas(project, "code int, k string, x double, y double"))
    count = counted(placed)
    strips = int(min(10_000, max(1, -(-count // STRIP_POINTS), min(4 * spark.sparkContext.defaultParallelism, count // 1000))))
    shares = [i / strips for i in range(1, strips)]
    borders = {int(r["code"]): np.unique(np.array(r["b"] or [], dtype=float)) for r in placed.groupBy("code").agg((F.percentile_approx("x", shares, 10_000) if shares else F.lit(None).cast("array<double>")).alias("b")).collect()}

    def strip_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            strip = np.zeros(len(pdf), dtype=np.int64)
            for code, b in borders.items():
                here = (pdf["code"] == code).to_numpy()
                strip[here] = np.searchsorted(b, pdf["x"].to_numpy()[here], side="right")
            yield pdf.assign(strip=strip)

    def strips_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for code, b in borders.items():
                own = pdf[pdf["code"] == code]
                first = np.searchsorted(b, own["x1"].to_numpy(), side="right")
                many = np.searchsorted(b, own["x2"].to_numpy(), side="right") - first + 1
                out = own.iloc[np.repeat(np.arange(len(own)), many)]
                yield out.assign(strip=np.repeat(first, many) + np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many))

    located = placed.mapInPandas(strip_of, "code int, k string, x double, y double, strip long")
    parts = located.groupBy("code", "strip").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (2 * STRIP_POINTS))).cast("int").alias("parts"))
    parts = F.broadcast(cut(parts))  # a row per strip: at most 10 000 for each system
    ours = located.join(parts, ["code", "strip"]).select("code", "strip", F.pmod(F.xxhash64("k", "x", "y"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "k", "x", "y", F.lit(None).cast("double").alias("x2"), F.lit(None).cast("double").alias("y2"))
    theirs = edges.mapInPandas(strips_of, "code int, region string, x1 double, y1 double, x2 double, y2 double, strip long").join(parts, ["code", "strip"])
    theirs = theirs.select("code", "strip", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("region").alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y"), "x2", "y2")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, edges_here = None, [], None
        for pdf in batches:
            key_of = list(zip(pdf["code"], pdf["strip"], pdf["part"], strict=True))
            starts = [0, *[i for i in range(1, len(key_of)) if key_of[i] != key_of[i - 1]], len(key_of)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if key_of[a] != now:
                    now, held, edges_here = key_of[a], [], None
                rows = pdf.iloc[a:b]
                of_edges = (rows["kind"] == 0).to_numpy()
                if of_edges.any():
                    held.append(rows[of_edges])
                rows = rows[~of_edges]
                if len(rows) and held:
                    if edges_here is None:
                        every = pd.concat(held, ignore_index=True).sort_values("k", kind="stable", ignore_index=True)
                        names, number = np.unique(every["k"].to_numpy(), return_inverse=True)
                        edges_here = ({"x1": every["x"].to_numpy(), "y1": every["y"].to_numpy(), "x2": every["x2"].to_numpy(), "y2": every["y2"].to_numpy(), "region": number}, names)
                    k = rows["k"].to_numpy()
                    for i, r in points_in_regions(rows["x"].to_numpy(), rows["y"].to_numpy(), *edges_here):
                        yield pd.DataFrame({"point_key": k[i], "region_key": r})

    both = theirs.unionByName(ours).repartition("code", "strip", "part").sortWithinPartitions("code", "strip", "part", "kind")
    return both.mapInPandas(sweep, "point_key string, region_key string").distinct()
