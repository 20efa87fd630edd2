"""Connected components: minimum labels along edges, pointer jumping and contraction, each round a written table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.session import counted, cut, lookup_join, release, seen

#: Contracted edges that one task labels by the same rounds in memory: bounds that task, not the result.
ONE_TASK_EDGES = 250_000


def labels_in_memory(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least node connected to each of ``n`` nodes: minimum labels over the edges, then jumps, until nothing changes."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low = label.copy()
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(low, jumped := low[low]):
            low = jumped
        if np.array_equal(low, label):
            return label
        label = low


def _jump(parents: DataFrame) -> DataFrame:
    """Replace every parent by its parent until all point at a root; the distance to the root halves each time."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        to = F.coalesce("grand", "parent")
        jumped = cut(lookup_join(parents, up, ["parent"], size=counted(parents)).select("id", to.alias("parent"), "deg", (to != F.col("parent")).alias("moved")), moved=F.count_if("moved"))
        release(parents)
        parents = jumped.select("id", "parent", "deg")
        parents._landweave = seen(jumped)
        if not seen(jumped)["moved"]:
            return parents


def least_labels(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(id, label): every id on an edge with the least id connected to it, in the order of the ids' type.

    Each round every id takes the least id among itself and its neighbours, pointer jumping carries that to the
    root of its tree, and the edges are contracted to the roots; a round at least halves the ids that still have an
    edge, and rounds end when no edge between different roots is left. Once at most ONE_TASK_EDGES contracted edges are
    left, one task runs the remaining rounds. Edges with a null end are passed over; repeated, reversed and self edges
    change nothing beyond putting their ids in the result; no edges, no rows.
    """
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u is not null and v is not null")
    kind = both.schema["u"].dataType.simpleString()
    given = cut(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), joined=F.count_if(F.col("u") != F.col("v")))
    live, left_over = given.filter("u <> v"), seen(given)["joined"]
    levels: list[DataFrame] = []
    while left_over and not (levels and left_over <= ONE_TASK_EDGES):
        ways = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = _jump(cut(ways.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")).select("id", F.least("id", "m").alias("parent"), "deg")))
        size = counted(parents)
        level = parents.select("id", "parent")
        level._landweave = seen(parents)
        levels.append(level)
        root = lookup_join(live, parents.select(F.col("id").alias("u"), F.col("parent").alias("ru"), "deg"), ["u"], counts="deg", size=size)
        root = lookup_join(root, parents.select(F.col("id").alias("v"), F.col("parent").alias("rv"), "deg"), ["v"], counts="deg", size=size)
        before, live = live, cut(root.filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        release(before)
        left_over = counted(live)
    if left_over:

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [b for b in batches if len(b)]
            if held:
                pdf = pd.concat(held, ignore_index=True)
                ids, code = np.unique(np.r_[pdf["u"].to_numpy(), pdf["v"].to_numpy()], return_inverse=True)
                label = labels_in_memory(code[: len(pdf)], code[len(pdf) :], len(ids))
                yield pd.DataFrame({"id": ids, "parent": ids[label]})

        levels.append(cut(live.repartition(1).mapInPandas(solve, f"id {kind}, parent {kind}")))

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        last = later.select(F.col("id").alias("parent"), F.col("parent").alias("last"))
        return lookup_join(earlier, last, ["parent"], size=seen(later).get("rows")).select("id", F.coalesce("last", "parent").alias("parent"))

    alone = given.filter("u = v").select(F.col("u").alias("id")).distinct()
    if not levels:
        return alone.select("id", F.col("id").alias("label"))
    groups = reduce(compose, reversed(levels))
    rest = alone.join(levels[0].select("id"), "id", "left_anti")
    return groups.unionByName(rest.select("id", F.col("id").alias("parent"))).select("id", F.col("parent").alias("label"))


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", left: str = "left_ix", right: str = "right_ix") -> DataFrame:
    """(id, component): every node with the least node connected to it; nodes without edges are their own component."""
    labels = least_labels(edges, left, right)
    every = nodes.select(F.col(node).alias("id")).filter("id is not null").distinct()
    return every.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))
