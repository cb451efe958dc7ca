"""Distributed union-find over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle, spread_join


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of `edges` (columns a, b) reaches.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and
    Beyond" (2014), until the edges are stars around the smallest nodes.  Each step hangs neighbours on a node's
    smallest neighbour, so hot nodes are pre-aggregated by min() and no neighbour list is ever built; the edges of a hot node
    are dealt over salts to learn that neighbour.  Every round is written to the shared folder.  Null ends and loops are dropped; nodes without an edge do not come back.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    now = settle(pairs)
    before, total = None, now.count()
    while True:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where("v > u"), least, "u", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u (larger end) and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        new = settle(small)
        # both steps keep the components; once nothing changes the edges are stars
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        drop_settled(now)
        now, total = new, mark["n"]
        if mark == before or not mark["n"]:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").cast(kind).alias("node"), F.col("v").alias("root")).distinct())


def spanning(pairs) -> list[tuple]:
    """(id, smallest id of its tree) for every id that a pair touches and that is not its own root."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]
