"""Connected components of an edge table by alternating large and small stars.

Each round rewires edges toward smaller ids; the result is one star for each component
with the smallest id at its centre. Every round is written to the shared folder, and the
number of rounds grows with the logarithm of the longest chain. No node's neighbours are
gathered: a round is a minimum for each node and a join on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.shared import written


LEAST_HOT = 256


def _with_least(edges: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """Each edge with ``m`` of its node ``u``. A node with more than ``hot`` edges is dealt to as
    many slices as that takes, and its one row of ``least`` is repeated for each, so a star's
    centre is not one task."""
    slices = F.ceil(F.col("n") / hot).cast("int")
    # ``hot`` is a thousandth of the edges at least, so 2,000 nodes at most have more: the
    # bound of this broadcast.
    centres = F.broadcast(least.filter(F.col("n") > hot).select("u", slices.alias("slices")))
    dealt = edges.join(centres, "u", "left").withColumn(
        "slice", F.pmod(F.xxhash64("v"), F.coalesce("slices", F.lit(1))).cast("int"))
    copies = least.select("u", "m", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    return dealt.join(copies, ["u", "slice"]).select("u", "v", "m")


def _large_star(edges: DataFrame, hot: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest id around the node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.filter("v > u"), least, hot).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hot: int) -> DataFrame:
    """``u`` > ``v`` holds. Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, hot).filter("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """A count and a sum that stay only if the edges stay."""
    row = edges.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has ``u`` and ``v``, longs; loops and repeated edges are harmless.

    Returns ``node`` and ``component`` (the smallest node reachable) for every node that
    has an edge to another one, except the centres themselves.
    """
    now = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "edges")
    mark = _mark(now)
    while mark[0]:
        hot = max(LEAST_HOT, mark[0] // 1000)
        now = written(_small_star(_large_star(now, hot).distinct(), hot).distinct(), "edges")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs connect, at most one for each node."""
    order = np.arange(len(ids))
    while True:
        low = np.minimum(order[i], order[j])
        new = order.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == order).all():
            break
        order = new
    moved = np.flatnonzero(order != np.arange(len(ids)))
    return ids[moved], ids[order[moved]]
