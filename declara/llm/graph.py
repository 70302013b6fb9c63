"""Connected components of edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declara.session import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one batch replaced by a star per component: as many edges as nodes at most, same components."""
    if not len(a):
        return a, b
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (smallest node reachable) of every node that has an edge; columns u and v in.

    Alternating stars: every node sends its larger neighbours, then its smaller ones, to the smallest of its
    neighbourhood, until nothing changes.  A round is two groupings; long chains shrink by half or more per
    round.  Each round is written to the shared folder, so nothing is computed twice and lost executors cost one
    round at most.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.select(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first())

    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = (both.join(low, both["u"] == low["c"]).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = large.join(small, large["u"] == small["c"])
        now = stored(joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"),
                                   F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct(), "edges")
        after = mark(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
