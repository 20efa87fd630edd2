"""Boundary samples, mask outlines, PNG, image folders and model artifacts."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions import geometry as G
from landweave.functions.text import stem_clean


def boundary_samples(features: DataFrame, n: int = 64) -> DataFrame:
    """(feature_id, points): ``n`` normalised boundary points as x, y pairs; polygons without area give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, out = [], []
            for i, text in zip(pdf["feature_id"], pdf["geometry"], strict=True):
                parts = G.polygons(*G.parse(text))
                if parts:
                    ids.append(i)
                    out.append(G.boundary_sample(parts, n).ravel().tolist())
            yield pd.DataFrame({"feature_id": ids, "points": out})

    return features.mapInPandas(run, f"feature_id {dict(features.dtypes)['feature_id']}, points array<float>")


def mask_outlines(cells: DataFrame, threshold: float = 0.5, min_pixels: float = 0, affine: tuple[float, ...] | None = None) -> DataFrame:
    """(tile_id, polygon_ix, geometry, area, space) of the areas at or above the threshold; one task per tile (tiles are of fixed size)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), dtype=bool)
        hit = pdf[pdf["prob"] >= threshold]
        mask[hit["row"].astype(int), hit["col"].astype(int)] = True
        found = G.mask_polygons(mask, affine, min_pixels)
        return pd.DataFrame({"tile_id": pdf["tile_id"].iloc[0], "polygon_ix": range(len(found)), "geometry": [G.to_geojson(p) for p, _ in found], "area": [a for _, a in found], "space": "pixel" if affine is None else "crs"})

    return cells.groupBy("tile_id").applyInPandas(run, "tile_id long, polygon_ix int, geometry string, area double, space string")


def png(values: np.ndarray) -> bytes:
    """Grey 8-bit PNG of a two-dimensional array of values in 0..1."""
    grey = np.clip(np.round(np.asarray(values, dtype=float) * 255), 0, 255).astype(np.uint8)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + r.tobytes() for r in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Array (rows, columns, channels) of an 8-bit PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    pos, body, head = 8, b"", b""
    while pos < len(data):
        (n,) = struct.unpack_from(">I", data, pos)
        kind, content = data[pos + 4 : pos + 8], data[pos + 8 : pos + 8 + n]
        head = content if kind == b"IHDR" else head
        body += content if kind == b"IDAT" else b""
        pos += 12 + n
    width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or interlace or channels is None:
        raise ValueError("unsupported PNG")
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), dtype=np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros(width * channels, dtype=np.int64)
        for x in range(width * channels):
            a, b, c = (out[y, x - channels] if x >= channels else 0), up[x], (up[x - channels] if x >= channels else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x] = (line[x] + (0, a, b, (a + b) // 2, nearest)[kind]) & 255
    return out.reshape(height, width, channels).astype(np.uint8)


def masks_as_png(cells: DataFrame) -> DataFrame:
    """(tile_id, png_base64) of probability masks given as cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1))
        grid[pdf["row"].astype(int), pdf["col"].astype(int)] = pdf["prob"]
        return pd.DataFrame({"tile_id": [pdf["tile_id"].iloc[0]], "png_base64": [base64.b64encode(png(grid)).decode()]})

    return cells.groupBy("tile_id").applyInPandas(run, "tile_id long, png_base64 string")


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels) of the PNG files below a path; decoding runs on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes = [read_png(bytes(c)).shape for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "height": [s[0] for s in shapes], "width": [s[1] for s in shapes], "channels": [s[2] for s in shapes]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, height int, width int, channels int")


def paired_files(spark: SparkSession, images: str, masks: str) -> DataFrame:
    """(id, image, mask): files of two folders joined on their cleaned stems; of equal stems the last path counts."""

    def side(path: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(path).select("path")
        return files.select(stem_clean(F.col("path")).alias("id"), "path").groupBy("id").agg(F.max("path").alias(name))

    return side(images, "image").join(side(masks, "mask"), "id")


def artifacts(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows (model_key, file, sha256) with presence, size and status of each artifact."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("actual"))
    joined = manifest.join(files, "file", "left")
    status = F.when(F.col("size").isNull(), "missing_artifact").when(F.col("sha256").isNotNull() & (F.lower("sha256") != F.col("actual")), "incompatible").otherwise("ready")
    return joined.select("model_key", "file", "size", status.alias("status"))
