"""Connected components by large-star and small-star rounds, and union-find inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import written

MAX_ROUNDS = 60


class Forest:
    """Union-find over 0..n-1; union tells whether it joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, i: int, j: int) -> bool:
        a, b = self.root[i], self.root[j]
        if a == b:
            return False
        self.root[self.root == max(a, b)] = min(a, b)
        return True


def _all_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = edges.select("a", F.lit(1).alias("tail"), F.lit(0).alias("head")).union(edges.select("b", F.lit(0), F.lit(1)))
    roles = ends.groupBy("a").agg(F.sum("tail").alias("tails"), F.max("head").alias("head"))
    return roles.agg(F.count_if((F.col("tails") > 1) | ((F.col("tails") > 0) & (F.col("head") > 0)))).first()[0] == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in edges (a long, b long): component is the smallest id reachable.

    Each round reads written edges and writes at most as many; minima are pre-aggregated, so a hub with a
    large share of all edges is no hot group, and the joins on hubs can be split.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(MAX_ROUNDS):
        if _all_stars(edges):
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(small, name, replaces=edges)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
