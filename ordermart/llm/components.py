"""Connected components of a distributed edge list, and the small local form
that a task uses to hand on a star instead of all pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``u, v``.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a
    minimum by key, combined map-side, and a join with a side that has one row
    a key, so a node with a third of all edges is never gathered. Each round is
    written to the shared folder; it ends when a round changes nothing.
    Null ends and loops are left out.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
    now = written(now.distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = tuple(state)
        least = now.groupBy("hi").agg(F.min("lo").alias("least"))
        # Large star: whoever is above a node goes to the node's smallest neighbour.
        up = least.select(F.col("hi").alias("at"), "least")
        now = now.join(up, now["lo"] == up["at"], "left").select("hi", F.coalesce("least", "lo").alias("lo")).distinct()
        now = written(now)
        # Small star: a node and all below it go to the smallest of them.
        least = now.groupBy("hi").agg(F.min("lo").alias("least"))
        below = now.join(least, "hi").filter("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        now = written(below.unionAll(least.withColumnRenamed("least", "lo")).distinct())


def local_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 .. n-1 the smallest node reachable over the links u-v."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(jumped := label[label], label):
            label = jumped
