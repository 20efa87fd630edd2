"""Pairwise matches into groups: minimum labels along edges, pointer jumping, a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.operators.components import least_labels


def consolidate(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(member_id, group_id): every id on an edge with the smallest id connected to it (code-point order).

    Edges with a null end are passed over; repeated, reversed and self edges change nothing beyond putting their ids in
    the result; no edges, no rows; further columns are ignored. Rounds and their bounds: see ``least_labels``.
    """
    ends = edges.select(F.col(left).cast("string").alias("u"), F.col(right).cast("string").alias("v"))
    return least_labels(ends, "u", "v").select(F.col("id").alias("member_id"), F.col("label").alias("group_id"))
