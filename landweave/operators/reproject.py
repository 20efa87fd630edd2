"""Whole geometries between coordinate systems: all vertices of a batch are projected at once, then put back in place."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landweave.functions import geometry as G
from landweave.functions.crs import epsg_code, from_lonlat, lonlat_arrays


def _points(node: Any, out: list) -> None:
    if node and isinstance(node[0], (int, float)):
        out.append(node[:2])
    else:
        for child in node:
            _points(child, out)


def _placed(node: Any, points: Iterator) -> Any:
    if node and isinstance(node[0], (int, float)):
        x, y = next(points)
        return [float(x), float(y), *node[2:]]
    return [_placed(child, points) for child in node]


def reproject(df: DataFrame, geometry: str, crs: Column | str, target: int, out: str = "geometry") -> DataFrame:
    """Set ``out`` to the geometry (GeoJSON or WKT) as GeoJSON text in the system ``target``, with all vertices projected.

    Null where the geometry is null, empty or unreadable, its system unknown, or a vertex has no place in the target;
    a further coordinate is kept as it is. An existing column ``out`` is replaced, all others stay.
    """
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])
    code = epsg_code(F.col(crs) if isinstance(crs, str) else crs).cast("double")
    read = df.withColumns({"__g": F.col(geometry), "__code": code}).select(*[f.name for f in kept], "__g", "__code")

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes: list[tuple[str, Any] | None] = []
            flat: list = []
            counts = np.zeros(len(pdf), dtype=np.int64)
            for i, text in enumerate(pdf["__g"]):
                try:
                    kind, coordinates = G.parse(text)
                    before = len(flat)
                    _points(coordinates, flat)
                    counts[i] = len(flat) - before
                    shapes.append((kind, coordinates) if counts[i] else None)
                except (ValueError, TypeError, IndexError):
                    shapes.append(None)
            xy = np.array(flat, dtype=float).reshape(-1, 2)
            codes = np.repeat(pdf["__code"].to_numpy(float), counts)
            with np.errstate(all="ignore"):
                # what is in the target system already stays as it is, to the last digit
                x, y = from_lonlat(*lonlat_arrays(xy[:, 0], xy[:, 1], codes), target)
                same = codes == target
                x, y = np.where(same, xy[:, 0], x), np.where(same, xy[:, 1], y)
            starts = np.cumsum(counts) - counts
            texts: list[str | None] = []
            for shape, begin, n in zip(shapes, starts, counts, strict=True):
                ok = shape is not None and np.isfinite(x[begin : begin + n]).all() and np.isfinite(y[begin : begin + n]).all()
                texts.append(json.dumps({"type": shape[0], "coordinates": _placed(shape[1], zip(x[begin : begin + n], y[begin : begin + n], strict=True))}) if ok else None)
            yield pdf.drop(columns=["__g", "__code"]).assign(**{out: texts})

    return read.mapInPandas(project, schema)
