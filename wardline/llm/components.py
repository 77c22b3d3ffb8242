"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import checkpointed


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' component, for the links ``a[i] - b[i]`` held by one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links`` (``a``, ``b``) but the roots; the root is the smallest node.

    Every step keeps components and pulls nodes towards their smallest neighbour, until only stars are left, after about
    log(n) steps. Nodes stay in tables; a node with very many links is split by Spark's skew join. Links of a node with
    itself, and with null, count for nothing.
    """
    stars = checkpointed(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        mark = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = stars.union(stars.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
