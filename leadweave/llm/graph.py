"""Connected components of links, spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from leadweave.session import discard, settle


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in *links* (``a``, ``b``, numbers of any order): the least node reachable.

    Every round each node hooks onto the least node seen next to it, then each link is replaced by one
    between the roots of its ends and one from the node to its root (large star, then small star; Kiveris
    et al., 2014), so paths shrink by doubling. Minima combine before the shuffle; the joins have one row
    per node on one side, so a node with very many links is split by adaptive execution. Each round is
    written to the shared folder, and the one before is deleted. An empty or null-ended set of links gives no rows.
    """
    up, down = F.greatest("a", "b"), F.least("a", "b")
    edges = settle(links.where("a <> b").select(up.alias("a"), down.alias("b")).distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = settle(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        before, edges = edges, settle(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        discard(before, large)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two links up and no root has one itself."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Within one task: for each of *n* nodes the least node reachable over the links *i*-*j*."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            return root
