"""Connected components: in one array, and of a distributed list of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpoint


def connected_local(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, for nodes 0 to n-1 and index pairs."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _hooked(edges: DataFrame, both: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them: all larger ones (both) or all smaller ones.

    Minima are pre-aggregated before they are joined back, so that a node with
    very many links is neither collected nor windowed; adaptive execution may
    split its rows in the join.
    """
    if both:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        new = around.join(least, "u").where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        around = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        new = around.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).unionAll(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return new.where("a < b").select("a", "b").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node of the links (a, b), by alternating large and small stars.

    Each round at least halves long paths; lineage is cut by a reliable
    checkpoint a round.  No links give an empty result.
    """
    edges = checkpoint(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = _digest(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = checkpoint(_hooked(_hooked(edges, True), False))
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
