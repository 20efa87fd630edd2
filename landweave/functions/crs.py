"""Coordinate systems in closed form: one set of formulas for Spark columns and for numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WGS84 ellipsoid and UTM parameters.
A_AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
K0, FALSE_EAST, FALSE_NORTH_SOUTH = 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)


def _series(*terms: tuple[float, ...]) -> list[float]:
    """Coefficients of the 2j-th harmonics: each tuple holds the factors of n^j, n^(j+1), ..."""
    return [sum(c * _N ** (j + i) for i, c in enumerate(t)) for j, t in enumerate(terms, 1)]


# Krueger series for the transverse Mercator projection, to the sixth order of the third flattening.
_ALPHA = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,))
_BETA = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720), (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,))
_DELTA = _series((2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675), (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945), (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835), (4279 / 630, -332 / 35, -399572 / 14175), (4174 / 315, -144838 / 6237), (601676 / 22275,))
_RECTIFYING = A_AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


class _Numpy:
    sin, cos, sinh, cosh, asin, atan, atan2, atanh, sqrt, log, tan = np.sin, np.cos, np.sinh, np.cosh, np.arcsin, np.arctan, np.arctan2, np.arctanh, np.sqrt, np.log, np.tan


class _Spark:
    sin, cos, sinh, cosh, asin, atan, atan2, atanh, sqrt, log, tan = F.sin, F.cos, F.sinh, F.cosh, F.asin, F.atan, F.atan2, F.atanh, F.sqrt, F.log, F.tan


def _math(x: Any) -> Any:
    return _Spark if isinstance(x, Column) else _Numpy


def mercator_forward(lon: Any, lat: Any) -> tuple[Any, Any]:
    m, r = _math(lon), np.pi / 180
    return lon * (A_AXIS * r), m.atanh(m.sin(lat * r)) * A_AXIS


def mercator_inverse(x: Any, y: Any) -> tuple[Any, Any]:
    m, d = _math(x), 180 / np.pi
    return x * (d / A_AXIS), m.atan(m.sinh(y * (1 / A_AXIS))) * d


def utm_forward(lon: Any, lat: Any, zone: Any, south: bool = False) -> tuple[Any, Any]:
    m, r = _math(lon), np.pi / 180
    dl, s, c = (lon - (zone * 6 - 183)) * r, m.sin(lat * r), 2 * np.sqrt(_N) / (1 + _N)
    t = m.sinh(m.atanh(s) - m.atanh(s * c) * c)
    xi, eta = m.atan2(t, m.cos(dl)), m.atanh(m.sin(dl) / m.sqrt(t * t + 1))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
        y = y + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
    return x * (K0 * _RECTIFYING) + FALSE_EAST, y * (K0 * _RECTIFYING) + (FALSE_NORTH_SOUTH if south else 0.0)


def utm_inverse(x: Any, y: Any, zone: Any, south: bool = False) -> tuple[Any, Any]:
    m, d = _math(x), 180 / np.pi
    eta, xi = (x - FALSE_EAST) * (1 / (K0 * _RECTIFYING)), (y - (FALSE_NORTH_SOUTH if south else 0.0)) * (1 / (K0 * _RECTIFYING))
    e, q = eta, xi
    for j, b in enumerate(_BETA, 1):
        e = e - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
        q = q - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
    chi = m.asin(m.sin(q) / m.cosh(e))
    lat = chi
    for j, a in enumerate(_DELTA, 1):
        lat = lat + m.sin(chi * (2 * j)) * a
    return m.atan2(m.sinh(e), m.cos(q)) * d + (zone * 6 - 183), lat * d


def epsg_code(crs: Column) -> Column:
    """EPSG number of a freely spelled CRS text (CRS84 and WGS 84 count as 4326); null when blank or unknown."""
    c = F.upper(F.regexp_replace(F.trim(crs), r"\s+", " "))
    zone = F.regexp_extract(c, r"UTM ZONE (\d{1,2}) ?([NS])", 1)
    number = F.regexp_extract(c, r"(?:^|[^0-9])(\d{4,5})$", 1)
    return (
        F.when(zone != "", zone.try_cast("int") + F.when(F.regexp_extract(c, r"UTM ZONE (\d{1,2}) ?([NS])", 2) == "S", 32700).otherwise(32600))
        .when(number != "", number.try_cast("int"))
        .when(c.rlike(r"(^|[^A-Z0-9])(OGC:)?CRS ?84$") | c.rlike(r"^WGS[ _-]?(19)?84$"), 4326)
    )


def supported(code: Column) -> Column:
    return code.isin(4326, 3857, 900913) | (code.between(32601, 32660)) | (code.between(32701, 32760))


def lonlat_arrays(x: np.ndarray, y: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """numpy: coordinates with an EPSG code per point to degrees; NaN outside the supported systems or the globe."""
    lon, lat = np.full(len(x), np.nan), np.full(len(x), np.nan)
    for c in np.unique(code[np.isfinite(code)]).astype(int):
        at = code == c
        if c == 4326:
            lon[at], lat[at] = x[at], y[at]
        elif c in (3857, 900913):
            lon[at], lat[at] = mercator_inverse(x[at], y[at])
        elif 32601 <= c <= 32660 or 32701 <= c <= 32760:
            lon[at], lat[at] = utm_inverse(x[at], y[at], c % 100, c > 32700)
    with np.errstate(invalid="ignore"):
        bad = ~((np.abs(lon) <= 180) & (np.abs(lat) <= 90))
    lon[bad] = lat[bad] = np.nan
    return lon, lat


def with_lonlat(df: DataFrame, x: str, y: str, code: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Replace columns ``x``, ``y``, ``code`` by degrees; null where a coordinate or a supported system is missing.

    In numpy, as the sixth-order series as one expression would be copied by the optimiser wherever it is used.
    """
    kept = [c for c in df.columns if c not in (x, y, code, lon, lat)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(lon, T.DoubleType()), T.StructField(lat, T.DoubleType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y, code)]
            with np.errstate(all="ignore"):
                got = lonlat_arrays(*arrays)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *(pa.array(v, pa.float64(), from_pandas=True) for v in got)], names=[*kept, lon, lat])

    return df.mapInArrow(convert, schema)


def from_lonlat(lon: np.ndarray, lat: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """numpy: degrees to the coordinates of a supported EPSG code."""
    if code == 4326:
        return lon, lat
    if code in (3857, 900913):
        return mercator_forward(lon, lat)
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return utm_forward(lon, lat, code % 100, code > 32700)
    raise ValueError(f"unsupported coordinate system EPSG:{code}")


def unit_vector(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=-1)


def earth_centred(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Metres from the Earth's centre, on the WGS84 ellipsoid."""
    u = unit_vector(lon, lat)
    n = A_AXIS / np.sqrt(1 - E2 * u[..., 2] ** 2)
    return np.stack([n * u[..., 0], n * u[..., 1], n * (1 - E2) * u[..., 2]], axis=-1)
