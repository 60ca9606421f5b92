"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterline.llm.common import fixed

#: Links (two numbers each) that are few enough for one task; with more, all steps are joins.
FEW = 1_000_000


def _minimum(edges: DataFrame) -> DataFrame:
    """``u, v, m``: every edge with the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links, and the least node of each one's component.

    Every root with a smaller neighbour hooks on to the least one, then paths are halved; as each
    component hooks or is hooked to, their number halves at least with every round.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _few_components(links: DataFrame) -> DataFrame:
    """``components`` of FEW links at most: one task and one shuffle."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(b["u"].to_numpy(np.int64), b["v"].to_numpy(np.int64)) for b in batches]
        if rows:
            nodes, roots = least_nodes(*(np.concatenate(x) for x in zip(*rows)))
            yield pd.DataFrame({"node": nodes, "root": roots})

    return fixed(links.repartition(1).mapInPandas(found, "node long, root long"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node; the root is its component's least node.

    ``links`` has columns ``u, v``; order, repeats and loops don't matter. Each round links every
    node's larger neighbours, then its smaller ones, to the least of them. All steps are grouped
    minima and joins, and each round's edges are written to the shared folder. The number of rounds
    grows with the logarithm of the longest path. Up to FEW links (counted) that would be many small
    jobs; they make one.
    """
    links = links.where("u != v").select("u", "v")
    if links.count() <= FEW:
        return _few_components(links)
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = None
    while True:
        turned = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum(turned).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _minimum(large)
        edges = fixed(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        )
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
