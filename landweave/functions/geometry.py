"""Planar geometry kernels in numpy: reading, measures, validity, repair, overlaps, sampling, mask outlines."""

from __future__ import annotations

import json
import re
from typing import Any

import numpy as np

Rings = list[list[np.ndarray]]  # polygons, each an outer ring and its holes


class GeometryError(ValueError):
    """A text that is no geometry."""


def _ring(points: Any) -> np.ndarray:
    a = np.array([p[:2] for p in points], dtype=float).reshape(-1, 2)
    return a if len(a) == 0 or (a[0] == a[-1]).all() else np.r_[a, a[:1]]


def parse(value: str | dict) -> tuple[str, Any]:
    """(type, coordinates) of a WKT text or a GeoJSON geometry or feature; Z values are dropped later."""
    if isinstance(value, dict) or str(value).lstrip().startswith("{"):
        try:
            doc = value if isinstance(value, dict) else json.loads(value)
            if doc.get("type") == "Feature":
                doc = doc["geometry"]
            return doc["type"], doc["coordinates"]
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise GeometryError(f"not a geometry: {e}") from e
    m = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(EMPTY|\(.*\))\s*", str(value), re.S | re.I)
    kinds = {k.upper(): k for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}
    if m is None or m[1].upper() not in kinds:
        raise GeometryError("not a geometry")
    kind = kinds[m[1].upper()]
    if m[2].upper() == "EMPTY":
        return kind, []
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    body = re.sub(rf"({number}(?:\s+{number})+)", lambda p: "[" + ",".join(p[1].split()) + "]", m[2])
    if re.search(r"[A-Za-df-z]", body) or "()" in body.replace(" ", ""):
        raise GeometryError("not a geometry")
    try:
        coordinates = json.loads(body.replace("(", "[").replace(")", "]").replace("+", ""))
    except ValueError as e:
        raise GeometryError("not a geometry") from e
    if kind == "Point":
        return kind, coordinates[0]
    if kind == "MultiPoint" and coordinates and isinstance(coordinates[0][0], list):
        coordinates = [c[0] for c in coordinates]
    return kind, coordinates


def polygons(kind: str, coordinates: Any) -> Rings:
    parts = [coordinates] if kind == "Polygon" else coordinates if kind == "MultiPolygon" else []
    return [[_ring(r) for r in p] for p in parts if p and len(p[0])]


def vertices(kind: str, coordinates: Any) -> np.ndarray:
    """x,y of every vertex; outer rings only for polygons."""
    if not coordinates:
        return np.zeros((0, 2))
    if kind == "Point":
        return np.array([coordinates[:2]], dtype=float)
    if kind in ("LineString", "MultiPoint"):
        return np.array([p[:2] for p in coordinates], dtype=float)
    if kind == "MultiLineString":
        return np.array([p[:2] for line in coordinates for p in line], dtype=float)
    return np.concatenate([p[0] for p in polygons(kind, coordinates)] or [np.zeros((0, 2))])


def signed_area(r: np.ndarray) -> float:
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def area(parts: Rings) -> float:
    return sum(abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]) for p in parts)


def length(parts: Rings) -> float:
    return float(sum(np.hypot(*np.diff(r, axis=0).T).sum() for p in parts for r in p))


def bounds(points: np.ndarray) -> tuple[float, float, float, float] | None:
    return None if len(points) == 0 else (*points.min(0).tolist(), *points.max(0).tolist())


def _crossings(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters along a-b and c-d of every crossing, and whether they cross inside both (pairwise)."""
    r, s, q = b - a, d - c, c - a
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (q[..., 0] * s[..., 1] - q[..., 1] * s[..., 0]) / den
        u = (q[..., 0] * r[..., 1] - q[..., 1] * r[..., 0]) / den
    eps = 1e-12
    return t, u, (den != 0) & (t > eps) & (t < 1 - eps) & (u > eps) & (u < 1 - eps)


def self_crossing(parts: Rings) -> bool:
    """True where two edges of a polygon cross in their interiors."""
    for p in parts:
        a, b = np.concatenate([r[:-1] for r in p]), np.concatenate([r[1:] for r in p])
        if _crossings(a[:, None], b[:, None], a[None], b[None])[2].any():
            return True
    return False


def contains(parts: Rings, x: float, y: float) -> bool:
    inside = False
    for p in parts:
        for r in p:
            (x1, y1), (x2, y2) = r[:-1].T, r[1:].T
            cross = (y1 > y) != (y2 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= bool(np.count_nonzero(cross & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)) % 2)
    return inside


def contains_row(parts: Rings, xs: np.ndarray, y: float) -> np.ndarray:
    """``contains`` for many points of one height."""
    inside = np.zeros(len(xs), dtype=bool)
    for p in parts:
        for r in p:
            (x1, y1), (x2, y2) = r[:-1].T, r[1:].T
            cross = (y1 > y) != (y2 > y)
            x1, y1, x2, y2 = x1[cross], y1[cross], x2[cross], y2[cross]
            inside ^= np.count_nonzero(xs[:, None] < (x2 - x1) * (y - y1) / (y2 - y1) + x1, axis=1) % 2 == 1
    return inside


def validity(kind: str, coordinates: Any) -> tuple[bool, str]:
    """(valid, reason): reasons name self-intersection, too few points, repeated holes outside, or are 'Valid Geometry'."""
    parts = polygons(kind, coordinates)
    if kind not in ("Polygon", "MultiPolygon"):
        pts = vertices(kind, coordinates)
        return (False, "Too few points in geometry component") if kind == "LineString" and 0 < len(np.unique(pts, axis=0)) < 2 else (True, "Valid Geometry")
    for p in parts:
        for r in p:
            if len(r) < 4 or len(np.unique(r, axis=0)) < 3:
                return False, "Too few points in geometry component"
            if signed_area(r) == 0 and not self_crossing([[r]]):
                return False, "Self-intersection"
    if self_crossing(parts):
        return False, "Self-intersection"
    for p in parts:
        for h in p[1:]:
            if not contains([[p[0]]], *h[:-1].mean(0)):
                return False, "Hole lies outside shell"
    return True, "Valid Geometry"


def split_loops(ring: np.ndarray) -> list[np.ndarray]:
    """Simple loops of a ring: cut at every crossing of two edges, then at every point met twice."""
    edges: list[list[tuple[float, tuple[float, float]]]] = [[] for _ in range(len(ring) - 1)]
    a, b = ring[:-1], ring[1:]
    t, u, hit = _crossings(a[:, None], b[:, None], a[None], b[None])
    for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        p = tuple(np.round(a[i] + t[i, j] * (b[i] - a[i]), 9).tolist())
        edges[i].append((t[i, j], p))
        edges[j].append((u[i, j], p))
    walk: list[tuple[float, float]] = []
    for i, start in enumerate(a):
        walk.append(tuple(start.tolist()))
        walk += [p for _, p in sorted(edges[i])]
    loops, stack, at = [], [], {}
    for p in [*walk, walk[0]]:
        if p in at:
            loop = [*stack[at[p] :], p]
            for q in stack[at[p] + 1 :]:
                at.pop(q, None)
            del stack[at[p] + 1 :]
            if len(loop) >= 4:
                loops.append(np.array(loop))
        else:
            at[p] = len(stack)
            stack.append(p)
    return [r for r in loops if abs(signed_area(r)) > 1e-12]


def repair(kind: str, coordinates: Any) -> tuple[str, str, Rings]:
    """(operation, type, polygons): none for a valid geometry; else loops of all rings, nested by containment."""
    if validity(kind, coordinates)[0]:
        return "none", kind, polygons(kind, coordinates)
    loops = [s for p in polygons(kind, coordinates) for r in p if len(r) >= 4 for s in split_loops(r)]
    if not loops:
        raise GeometryError("repair leaves no area")
    loops.sort(key=lambda r: -abs(signed_area(r)))
    out: Rings = []
    for r in loops:
        mid = (r[:-1].mean(0) * 0.5 + r[0] * 0.5).tolist()
        host = next((p for p in out if contains([[p[0]]], *mid) and abs(signed_area(p[0])) > abs(signed_area(r))), None)
        if host is None:
            out.append([r])
        else:
            host.append(r)
    return "make_valid", "Polygon" if len(out) == 1 else "MultiPolygon", out


def _clip_triangles(t1: np.ndarray, t2: np.ndarray) -> float:
    """Area of the overlap of two counter-clockwise triangles (half-plane clipping)."""
    poly = t1
    for i in range(3):
        p, q = t2[i], t2[(i + 1) % 3]
        side = (q[0] - p[0]) * (poly[:, 1] - p[1]) - (q[1] - p[1]) * (poly[:, 0] - p[0])
        nxt, ns = np.roll(poly, -1, axis=0), np.roll(side, -1)
        keep = []
        for a, b, sa, sb in zip(poly, nxt, side, ns, strict=True):
            if sa >= 0:
                keep.append(a)
            if (sa > 0 > sb) or (sa < 0 < sb):
                keep.append(a + (b - a) * (sa / (sa - sb)))
        if len(keep) < 3:
            return 0.0
        poly = np.array(keep)
    x, y = poly[:, 0], poly[:, 1]
    return abs(float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2))


def _fan(parts: Rings) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for p in parts:
        for k, r in enumerate(p):
            way = np.sign(signed_area(r)) * (1 if k == 0 else -1)
            o = r[0]
            for a, b in zip(r[1:-2], r[2:-1], strict=True):
                s = (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
                if s != 0:
                    tri = np.array([o, a, b] if s > 0 else [o, b, a])
                    out.append((way * np.sign(s), tri, tri.min(0), tri.max(0)))
    return out


def intersection_area(a: Rings, b: Rings) -> float:
    """Overlap of two valid polygons with holes: signed fans of triangles, clipped pairwise."""
    total = 0.0
    other = _fan(b)
    for s1, t1, lo1, hi1 in _fan(a):
        for s2, t2, lo2, hi2 in other:
            if (lo1 < hi2).all() and (lo2 < hi1).all():
                total += s1 * s2 * _clip_triangles(t1, t2)
    return max(0.0, total)


def overlap_metrics(a: Rings, b: Rings) -> tuple[float, float, float, float, float]:
    """(intersection, union, intersection over union, share of a, share of b); zero-safe."""
    x, y, inter = area(a), area(b), intersection_area(a, b)
    union = x + y - inter
    return inter, union, inter / union if union > 0 else 0.0, inter / x if x > 0 else 0.0, inter / y if y > 0 else 0.0


def distance(a: Rings, b: Rings) -> float:
    """Least distance of two polygons, 0 where they meet."""
    if intersection_area(a, b) > 0:
        return 0.0

    def to_segments(points: np.ndarray, p: np.ndarray, q: np.ndarray) -> float:
        d = q - p
        t = np.clip(((points[:, None] - p) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
        return float(np.sqrt(((points[:, None] - (p + t[..., None] * d)) ** 2).sum(-1)).min())

    pairs = [(r[:-1], r[1:]) for p in a for r in p], [(r[:-1], r[1:]) for p in b for r in p]
    return min(min(to_segments(x[0], y[0], y[1]), to_segments(y[0], x[0], x[1])) for x in pairs[0] for y in pairs[1])


def normal_text(kind: str, coordinates: Any) -> str:
    """One text for equal geometries: rings start at their least point in one direction, rings and parts sorted."""
    parts = polygons(kind, coordinates)
    if not parts:
        return json.dumps([kind, vertices(kind, coordinates).tolist()])

    def ring(r: np.ndarray) -> list:
        pts = [tuple(p) for p in (r[:-1] if signed_area(r) < 0 else r[:-1][::-1]).tolist()]
        i = pts.index(min(pts))
        return pts[i:] + pts[:i]

    return json.dumps([kind, sorted([[ring(p[0])] + sorted(ring(h) for h in p[1:]) for p in parts])])


def boundary_sample(parts: Rings, n: int = 64) -> np.ndarray:
    """``n`` points at equal steps along the outer ring of the largest part, centred and scaled to radius 1 (float32)."""
    r = max(parts, key=lambda p: abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]))[0]
    steps = np.r_[0, np.cumsum(np.hypot(*np.diff(r, axis=0).T))]
    at = np.linspace(0, steps[-1], n, endpoint=False)
    pts = np.stack([np.interp(at, steps, r[:, 0]), np.interp(at, steps, r[:, 1])], axis=1)
    pts -= pts.mean(0)
    radius = np.hypot(*pts.T).max()
    return (pts / radius if radius > 0 else pts).astype(np.float32)


def mask_polygons(mask: np.ndarray, affine: tuple[float, ...] | None = None, min_pixels: float = 0) -> list[tuple[Rings, float]]:
    """Outlines of the 4-connected areas of a binary mask as (polygon, area), in pixel space or through an affine."""
    mask = np.asarray(mask, dtype=bool)
    rows, cols = mask.shape
    label = np.zeros((rows, cols), dtype=int)
    count = 0
    for i, j in zip(*np.nonzero(mask), strict=True):
        if label[i, j]:
            continue
        count += 1
        stack = [(i, j)]
        label[i, j] = count
        while stack:
            y, x = stack.pop()
            for v, w in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= v < rows and 0 <= w < cols and mask[v, w] and not label[v, w]:
                    label[v, w] = count
                    stack.append((v, w))
    out = []
    for k in range(1, count + 1):
        padded = np.pad(label == k, 1)
        nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for y, x in zip(*np.nonzero(padded), strict=True):
            for dy, dx, a, b in ((-1, 0, (x, y), (x + 1, y)), (0, 1, (x + 1, y), (x + 1, y + 1)), (1, 0, (x + 1, y + 1), (x, y + 1)), (0, -1, (x, y + 1), (x, y))):
                if not padded[y + dy, x + dx]:
                    nxt.setdefault(a, []).append(b)
        rings = []
        while nxt:
            start = min(nxt)
            ring, at, came = [start], start, (1, 0)
            while True:
                choices = nxt[at]
                # at a corner shared by two cells turn so that the outline stays 4-connected
                to = max(choices, key=lambda q: came[0] * (q[1] - at[1]) - came[1] * (q[0] - at[0]))
                choices.remove(to)
                if not choices:
                    del nxt[at]
                came = (to[0] - at[0], to[1] - at[1])
                if len(ring) > 1 and (ring[-1][0] - ring[-2][0]) * came[1] == (ring[-1][1] - ring[-2][1]) * came[0]:
                    ring[-1] = to
                else:
                    ring.append(to)
                at = to
                if at == start:
                    break
            rings.append(np.array(ring, dtype=float) - 1)
        rings.sort(key=lambda r: -abs(signed_area(r)))
        if affine is not None:
            a, b, c, d, e, f = affine
            rings = [np.stack([a * r[:, 0] + b * r[:, 1] + c, d * r[:, 0] + e * r[:, 1] + f], axis=1) for r in rings]
        unit = abs(affine[0] * affine[4] - affine[1] * affine[3]) if affine is not None else 1.0
        size = area([rings])
        if size >= min_pixels * unit and size > 0:
            out.append(([rings], size))
    return out


def to_geojson(parts: Rings) -> str:
    shapes = [[r.tolist() for r in p] for p in parts]
    return json.dumps({"type": "Polygon", "coordinates": shapes[0]} if len(shapes) == 1 else {"type": "MultiPolygon", "coordinates": shapes})
