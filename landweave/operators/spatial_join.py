"""Candidate and overlap joins over boxes and polygons: grid cells make the theta join an equi-join."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions import geometry as G

BOX = ("minx", "miny", "maxx", "maxy")


def grid_size(df: DataFrame) -> float:
    """Twice the median side of the boxes."""
    side = df.select(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")).alias("s")).agg(F.percentile_approx("s", 0.5, 1000)).first()[0]
    return max(1e-9, 2.0 * (side or 1.0))


def box_pairs(df: DataFrame, key: str, keep: list[str], cell: float | None = None) -> DataFrame:
    """Pairs of rows (key_a < key_b) whose closed boxes meet, each once, with the kept columns of both sides.

    Boxes are spread over the grid cells they touch; a pair comes out only in the cell that holds the upper-left corner
    of its common part, so no deduplication is needed. Rows with a null box meet nothing.
    """
    cell = cell or grid_size(df)
    names = [key, *[k for k in keep if k != key and k not in BOX], *BOX]
    base = df.select(*names).filter(" and ".join(f"{c} is not null" for c in BOX))

    def side(suffix: str) -> DataFrame:
        xs = F.sequence(F.floor(F.col("minx") / cell), F.floor(F.col("maxx") / cell))
        ys = F.sequence(F.floor(F.col("miny") / cell), F.floor(F.col("maxy") / cell))
        return base.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys)).select("cx", "cy", *[F.col(c).alias(f"{c}_{suffix}") for c in names])

    j = side("a").join(side("b"), ["cx", "cy"]).filter(F.col(f"{key}_a") < F.col(f"{key}_b"))
    left, low = F.greatest("minx_a", "minx_b"), F.greatest("miny_a", "miny_b")
    meet = (left <= F.least("maxx_a", "maxx_b")) & (low <= F.least("maxy_a", "maxy_b"))
    return j.filter(meet & (F.floor(left / cell) == F.col("cx")) & (F.floor(low / cell) == F.col("cy"))).drop("cx", "cy")


def box_overlap(pairs: DataFrame) -> DataFrame:
    """Overlap measures of axis-parallel boxes in plain expressions."""
    w = F.least("maxx_a", "maxx_b") - F.greatest("minx_a", "minx_b")
    h = F.least("maxy_a", "maxy_b") - F.greatest("miny_a", "miny_b")

    def size(s: str) -> Column:
        return (F.col(f"maxx_{s}") - F.col(f"minx_{s}")) * (F.col(f"maxy_{s}") - F.col(f"miny_{s}"))

    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = size("a") + size("b") - inter
    return pairs.withColumns({"intersection_area": inter, "union_area": union, "iou": F.coalesce(F.try_divide(inter, union), F.lit(0.0)), "fraction_a": F.coalesce(F.try_divide(inter, size("a")), F.lit(0.0)), "fraction_b": F.coalesce(F.try_divide(inter, size("b")), F.lit(0.0))})


def spatial_candidates(records: DataFrame, key: str = "row_ix", source: str = "source_id", cell: float | None = None, cap: int | None = None) -> DataFrame:
    """Pairs of different sources whose boxes meet; an explicit cap keeps the first pairs in (left, right) order."""
    pairs = box_pairs(records, key, [source], cell).filter(F.col(f"{source}_a") != F.col(f"{source}_b"))
    out = pairs.select(F.col(f"{key}_a").alias("left_ix"), F.col(f"{key}_b").alias("right_ix"))
    return out if cap is None else out.orderBy("left_ix", "right_ix").limit(cap)


_METRICS = "intersection_area double, union_area double, iou double, fraction_a double, fraction_b double"


def polygon_overlaps(df: DataFrame, key: str, geometry: str, tolerance: float = 1e-9) -> DataFrame:
    """(key_a, key_b, measures, severity) of polygons that overlap by more than the tolerance; boxes first, exact areas after."""
    boxed = with_boxes(df, geometry)
    pairs = box_pairs(boxed, key, [geometry])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [G.overlap_metrics(G.polygons(*G.parse(a)), G.polygons(*G.parse(b))) for a, b in zip(pdf[f"{geometry}_a"], pdf[f"{geometry}_b"], strict=True)]
            yield pd.concat([pdf[[f"{key}_a", f"{key}_b"]].reset_index(drop=True), pd.DataFrame(rows, columns=["intersection_area", "union_area", "iou", "fraction_a", "fraction_b"], dtype=float)], axis=1)

    kind = dict(df.dtypes)[key]
    out = pairs.select(f"{key}_a", f"{key}_b", f"{geometry}_a", f"{geometry}_b").mapInPandas(measure, f"{key}_a {kind}, {key}_b {kind}, {_METRICS}")
    return out.filter(F.col("intersection_area") > tolerance).withColumn("severity", F.when(F.col("iou") > 0.1, "high").otherwise("medium"))


def with_boxes(df: DataFrame, geometry: str) -> DataFrame:
    """Add the bounding box of a geometry text; null for empty or unreadable ones."""
    kept = [c for c in df.columns if c not in BOX]

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf[geometry]:
                try:
                    rows.append(G.bounds(G.vertices(*G.parse(text))) if text is not None else None)
                except (ValueError, TypeError, IndexError):
                    rows.append(None)
            yield pdf.assign(**{c: [None if r is None else r[i] for r in rows] for i, c in enumerate(BOX)})

    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in kept) + ", " + ", ".join(f"{c} double" for c in BOX)
    return df.select(*kept).mapInPandas(boxes, schema)
