"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import cut, drop_cut, spread_join


def local_forest(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Component labels (smallest member) of 0..n-1 under the links a[i]-b[i], vectorised:
    hooks the larger root under the smaller one and halves paths until nothing moves."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        ra, rb = labels[a], labels[b]
        keep = ra != rb
        if not keep.any():
            break
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), the component being its smallest node.

    Alternates large-star and small-star steps, each a combined minimum by node and an equi-join
    with it: no group is collected, a hub's edges stay where they are (spread_join), and every round is
    cut from its lineage in the shared folder. Nodes are longs; null ends and loops are ignored.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = mark(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, "u", "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, "u", "n", state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), state[0])
        drop_cut(now)
        now, before, state = after, state, mark(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
