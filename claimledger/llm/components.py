"""Connected components by alternating large and small stars.

Every round is a few joins and aggregates on the edges; their number never
grows, and each round is written to the shared folder, so a lost executor
repeats one round at most.  A hub's edges are summed before the shuffle
(min), and its answer comes to them by broadcast (join_by_key).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import join_by_key, materialize


def _edges(df: DataFrame) -> DataFrame:
    return df.where("lo < hi").distinct()


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of ids -> (node, component), the component's smallest
    id; nodes without an edge to another node are not in the result."""
    e = materialize(_edges(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))))
    mark = _mark(e)
    while mark[0]:
        # large star: larger neighbours of a node move to the smallest of its neighbourhood
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(e.select("hi", "lo"))
        least = (both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("m < u")
                 .select(F.col("u").cast("string").alias("key"), "m", "n"))
        large = join_by_key(e.withColumn("key", F.col("lo").cast("string")), least, "key", ["m"], "n", 2 * mark[0], ["hi"])
        large = large.select(F.coalesce("m", "lo").alias("lo"), "hi")
        large = materialize(_edges(large))
        # small star: smaller neighbours of a node, and the node, move to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("m", "lo", "hi")
        small = (small.where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                 .unionAll(least.select(F.col("m").alias("lo"), "hi")))
        e = materialize(_edges(small))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return (e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            .unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct())


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index per index of 0..n-1 over links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if (before == label).all():
            break
    return label
