"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.llm.common import cut, release


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each one reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
    return nodes, nodes[root]


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links with the closure of the given ones: each node with its smallest reachable one."""
    if not len(a):
        return a, b
    nodes, roots = local_roots(a, b)
    apart = nodes != roots
    return roots[apart], nodes[apart]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that has a link; root is the smallest node it reaches.

    ``links`` has two long columns ``a, b``. Each round links a node's larger neighbours to its smallest one, then its
    smaller neighbours likewise; partial minima keep a hub of any size apart. Stops when a round changes nothing.
    """
    spark = links.sparkSession
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that a hub's links meet its minimum in a join that can be split or broadcast.
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star_centres")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "stars")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "star_centres")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        release(spark)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
