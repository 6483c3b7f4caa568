"""Connected components: numpy within a task, alternating stars between tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_at, new_path, remove


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n vertices, joined by the links (a[k], b[k])."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    centre = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(centre, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(
            centre.select(F.col("u").alias("src"), F.col("m").alias("dst"))
        )
    return out.where("src <> dst").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every source has one destination, which is smaller and no source itself: nothing is left to do."""
    from_ = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"))
    if not from_.where("n > 1 or dst > src").isEmpty():
        return False
    return edges.select(F.col("dst").alias("src")).distinct().join(from_.select("src"), "src", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(src long, dst long) -> (id, component): each linked vertex with its smallest reachable one.

    Alternating large and small stars (Kiveris et al. 2014): every round joins on the vertex, keeps at
    most as many edges as before and is written to the shared folder in place of the round before. No edge
    reaches the driver. Links that are stars already, as those of one frame are, take no round.
    """
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "edges")
    edges = cut_at(edges.where("src <> dst").select("src", "dst").distinct(), path)
    while not _are_stars(edges):
        last, path = path, new_path(spark, "edges")
        edges = cut_at(_star(_star(edges, large=True), large=False), path)
        remove(spark, last)
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(
        edges.select(F.col("dst").alias("id"), F.col("dst").alias("component"))
    ).distinct()
