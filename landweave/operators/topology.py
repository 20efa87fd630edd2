"""Topology of polygon layers: invalid, duplicate, overlapping and enclosing-gap geometries; repairs as proposals only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.functions import geometry as G
from landweave.operators.components import components
from landweave.operators.spatial_join import box_pairs, polygon_overlaps
from landweave.session import cut, shuffled, spread

_REPORT = "feature_id string, geometry string, geometry_type string, valid boolean, empty boolean, reason string, area double, length double, issue_type string, severity string"


def validity_report(features: DataFrame, key: str = "feature_id", geometry: str = "geometry") -> DataFrame:
    """Type, validity, emptiness, reason, area and length of every geometry, and its issue if it has one."""

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["feature_id"], pdf["geometry"], strict=True):
                try:
                    kind, coordinates = G.parse(text)
                    if len(G.vertices(kind, coordinates)) == 0:
                        rows.append((i, text, kind, True, True, None, 0.0, 0.0, "empty_geometry", "medium"))
                        continue
                    ok, reason = G.validity(kind, coordinates)
                    parts = G.polygons(kind, coordinates)
                    issue = None if ok else "self_intersection" if "elf-intersection" in reason else "invalid_geometry"
                    rows.append((i, text, kind, ok, False, reason, G.area(parts), G.length(parts), issue, None if ok else "high"))
                except (ValueError, TypeError, IndexError) as e:
                    rows.append((i, text, None, False, False, str(e), None, None, "unparseable_geometry", "high"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REPORT.split(", ")])

    return features.select(F.col(key).cast("string").alias("feature_id"), F.col(geometry).alias("geometry")).mapInPandas(report, _REPORT)


def repair_proposals(report: DataFrame) -> DataFrame:
    """(feature_id, operation, repaired, area_before, area_after, area_delta, relative_delta, type_changed, applied): input is never changed."""
    schema = "feature_id string, operation string, repaired string, area_before double, area_after double, area_delta double, relative_delta double, type_changed boolean, applied boolean"

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["feature_id"], pdf["geometry"], strict=True):
                kind, coordinates = G.parse(text)
                try:
                    how, new, parts = G.repair(kind, coordinates)
                except (G.GeometryError, ValueError, IndexError):
                    continue
                before, after = G.area(G.polygons(kind, coordinates)), G.area(parts)
                delta = after - before
                rows.append((i, how, G.to_geojson(parts), before, after, delta, delta / before if before else None, new != kind, False))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return report.filter("issue_type in ('self_intersection', 'invalid_geometry')").mapInPandas(propose, schema)


def normal_key(features: DataFrame, key: str, geometry: str) -> DataFrame:
    """(key, geometry_key): equal for geometries that are equal up to start, direction and order of rings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["g"]:
                try:
                    out.append(G.normal_text(*G.parse(text)))
                except (ValueError, TypeError, IndexError):
                    out.append(None)
            yield pd.DataFrame({"k": pdf["k"], "t": out})

    got = features.select(F.col(key).cast("string").alias("k"), F.col(geometry).alias("g")).mapInPandas(run, "k string, t string")
    return got.select(F.col("k").alias("feature_id"), F.sha2("t", 256).alias("geometry_key")).filter("geometry_key is not null")


def duplicates(keys: DataFrame, order: str = "feature_id", by: str = "geometry_key") -> DataFrame:
    """(first_id, duplicate_id): every later feature with the first of equal key."""
    firsts = keys.groupBy(by).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(firsts, by).filter(F.col(order) > F.col("first_id")).select("first_id", F.col(order).alias("duplicate_id"))


_NUMBER = r"(-?(?:0|[1-9]\d*)(?:\.\d+)?)"
#: The common spelling of a polygon of four corners, which is read without the general parser.
_FOUR_CORNERS = re.compile(r"POLYGON ?\(\(" + ", ?".join([f"{_NUMBER} {_NUMBER}"] * 5) + r"\)\)")
_OUTLINE = "id string, minx double, miny double, maxx double, maxy double, shape string"


def _along_box(ax: float, ay: float, bx: float, by: float, cx: float, cy: float, dx: float, dy: float) -> bool:
    """True when a ring of four corners goes along the sides of its box."""
    return (ax == bx and by == cy and cx == dx and dy == ay) or (ay == by and bx == cx and cy == dy and dx == ax)


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Box of every readable geometry, and its text unless the box says all."""
    for pdf in batches:
        rows = []
        for i, text in zip(pdf["id"].tolist(), pdf["geometry"].tolist(), strict=True):
            if isinstance(text, str) and (m := _FOUR_CORNERS.fullmatch(text)):
                *corners, ex, ey = map(float, m.groups())
                ax, ay, _, _, cx, cy, _, _ = corners
                if ex == ax and ey == ay and _along_box(*corners):
                    rows.append((i, min(ax, cx), min(ay, cy), max(ax, cx), max(ay, cy), None))
                    continue
            try:
                kind, coordinates = G.parse(text)
                if (box := G.bounds(G.vertices(kind, coordinates))) is not None:
                    parts = G.polygons(kind, coordinates)
                    plain = len(parts) == 1 and len(parts[0]) == 1 and len(parts[0][0]) == 5 and _along_box(*parts[0][0][:4].ravel().tolist())
                    rows.append((i, *box, None if plain else text))
            except (ValueError, TypeError, IndexError):
                continue
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUTLINE.split(", ")])


def gaps_in_block(ids: list[str], boxes: list[tuple[float, float, float, float]], shapes: list[str | None]) -> list[tuple[int, float, list[str]]]:
    """(gap, area, ids around it) of one block; a shape of None is its box.

    The edges' coordinates make an exact grid; its uncovered cells that do not reach the outside are the gaps, in the
    order of their first cell, row by row.
    """
    if len(ids) < 2:
        return []
    polys = [None if t is None else G.polygons(*G.parse(t)) for t in shapes]
    points = [q for p in polys if p for part in p for r in part for q in r.tolist()]
    flat = [b for b, t in zip(boxes, shapes, strict=True) if t is None]
    xs = sorted({x for b in flat for x in (b[0], b[2])} | {x for x, _ in points})
    ys = sorted({y for b in flat for y in (b[1], b[3])} | {y for _, y in points})
    col, row = {x: j for j, x in enumerate(xs)}, {y: i for i, y in enumerate(ys)}
    wide = len(xs) + 3  # a wall and a free cell on either side of the cells: nothing leaves the grid
    grid = bytearray(wide * (len(ys) + 3))
    grid[:wide] = grid[-wide:] = b"\1" * wide
    for at in range(0, len(grid), wide):
        grid[at] = grid[at + wide - 1] = 1
    for box, p in zip(boxes, polys, strict=True):
        if p is None:
            a, n = col[box[0]], col[box[2]] - col[box[0]]
            for i in range(row[box[1]], row[box[3]]):
                grid[(i + 2) * wide + a + 2 : (i + 2) * wide + a + 2 + n] = b"\1" * n
        elif p:
            outer = np.concatenate([r for part in p for r in part])
            (x0, y0), (x1, y1) = outer.min(0).tolist(), outer.max(0).tolist()
            a, mx = col[x0], (np.array(xs[col[x0] : col[x1]]) + np.array(xs[col[x0] + 1 : col[x1] + 1])) / 2
            for i in range(row[y0], row[y1]):
                inside = G.contains_row(p, mx, (ys[i] + ys[i + 1]) / 2)
                at = (i + 2) * wide + a + 2
                for j in np.nonzero(inside)[0].tolist():
                    grid[at + j] = 1

    def flood(start: int, mark: int) -> list[int]:
        grid[start] = mark
        stack, cells = [start], []
        while stack:
            cells.append(at := stack.pop())
            for to in (at - wide, at - 1, at + 1, at + wide):
                if not grid[to]:
                    grid[to] = mark
                    stack.append(to)
        return cells

    flood(wide + 1, 2)
    out: list[tuple[int, float, list[str]]] = []
    bounds = None
    while (start := grid.find(0)) >= 0:
        cells = sorted(divmod(at, wide) for at in flood(start, 3))
        size = 0.0
        for i, j in cells:
            size += (xs[j - 1] - xs[j - 2]) * (ys[i - 1] - ys[i - 2])
        js = [j for _, j in cells]
        x0, y0, x1, y1 = xs[min(js) - 2], ys[cells[0][0] - 2], xs[max(js) - 1], ys[cells[-1][0] - 1]
        bounds = [(i, *b) for i, b, p in zip(ids, boxes, polys, strict=True) if p is None or p] if bounds is None else bounds
        out.append((len(out), size, sorted(i for i, a, b, c, d in bounds if a <= x1 and x0 <= c and b <= y1 and y0 <= d)))
    return out


def _block_gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gaps of every block of rows that come sorted by block; a block may go on in the next batch."""
    block, ids, boxes, shapes = None, [], [], []

    def done() -> list[tuple]:
        return [(block, *g) for g in gaps_in_block(ids, boxes, shapes)]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["block", "gap", "area", "feature_ids"])

    for pdf in batches:
        rows: list[tuple] = []
        for own, i, a, b, c, d, shape in zip(*[pdf[x].tolist() for x in ("component", "id", "minx", "miny", "maxx", "maxy", "shape")], strict=True):
            if own != block:
                rows += done()
                block, ids, boxes, shapes = own, [], [], []
            ids.append(i)
            boxes.append((a, b, c, d))
            shapes.append(shape)
        yield frame(rows)
    yield frame(done())


def gaps(features: DataFrame, key: str = "feature_id", geometry: str = "geometry") -> DataFrame:
    """(block, gap, area, feature_ids): areas enclosed by axis-parallel polygons that touch, one row each.

    Features are grouped into blocks of touching boxes first, so only neighbours meet in one task (see gaps_in_block).
    Geometries are read once; what is a rectangle goes on as its box.
    """
    boxed = cut(spread(features.select(F.col(key).cast("string").alias("id"), F.col(geometry).alias("geometry"))).mapInPandas(_outlines, _OUTLINE))
    touch = box_pairs(boxed, "id", []).select(F.col("id_a").alias("left_ix"), F.col("id_b").alias("right_ix"))
    blocks = components(boxed, touch)
    together = boxed.join(shuffled(blocks), "id").repartition("component").sortWithinPartitions("component")
    return together.mapInPandas(_block_gaps, "block string, gap int, area double, feature_ids array<string>")


def topology_issues(features: DataFrame, key: str = "feature_id", geometry: str = "geometry", with_gaps: bool = True) -> DataFrame:
    """(check_ix, issue_type, severity, feature_ids, measure): own issues, duplicates, overlaps, gaps, in that order."""
    report = validity_report(features, key, geometry)
    own = report.filter("issue_type is not null").select(F.lit(0).alias("check_ix"), "issue_type", "severity", F.array("feature_id").alias("feature_ids"), F.col("area").alias("measure"))
    good = report.filter("issue_type is null").select("feature_id", "geometry")
    dup = duplicates(normal_key(good, "feature_id", "geometry")).select(F.lit(1).alias("check_ix"), F.lit("duplicate_geometry").alias("issue_type"), F.lit("medium").alias("severity"), F.array("first_id", "duplicate_id").alias("feature_ids"), F.lit(None).cast("double").alias("measure"))
    over = polygon_overlaps(good, "feature_id", "geometry").select(F.lit(2).alias("check_ix"), F.lit("overlap").alias("issue_type"), "severity", F.array("feature_id_a", "feature_id_b").alias("feature_ids"), F.col("intersection_area").alias("measure"))
    out = own.unionByName(dup).unionByName(over)
    if with_gaps:
        found = gaps(good)
        out = out.unionByName(found.select(F.lit(3).alias("check_ix"), F.lit("gap").alias("issue_type"), F.lit("medium").alias("severity"), "feature_ids", F.col("area").alias("measure")))
    return out
