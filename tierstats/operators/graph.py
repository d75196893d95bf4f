"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstats.sources.shared import discard, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any direction, repeats allowed -> (node, root): root is the smallest node reachable.

    Only nodes with an edge to another node are returned. Rounds go on until no edge changes and grow with the logarithm
    of the longest chain; each ends in a written table. A node with very many edges is joined to one row, so its edges
    spread.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = staged(e, "cc"), None
    while (now := e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: between two plain exchanges Spark splits the partition of a node with very many edges
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "cc-large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        near = large.join(least.hint("merge"), "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        for done in (e, low, large, least):
            discard(spark, done)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b as links from each value to the smallest of its component: fewer, and nothing gets lost."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new, low = label.copy(), np.minimum(label[i], label[j])
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
