"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import stored


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node reachable.

    edges: (a, b), longs; nulls and loops are ignored. A round links each node to the least neighbour known (first all
    its neighbours, then only the lesser ones), so paths shrink to stars; a count and a checksum per round go to the
    driver. Nodes of many edges stay splittable: both sides of each join are read from storage.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = stored(both.groupBy("hi").agg(F.min("lo").alias("m")))
        # larger neighbours of a node move to the least one around it
        large = stored(both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.least("m", "hi").alias("lo")).where("hi <> lo").distinct())
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")))
        # lesser ones too, and the node itself
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = stored(small.union(least.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct())
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())
        if mark == state or mark[0] == 0:
            roots = now.select(F.col("lo").alias("node")).distinct()
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        state = mark
    raise RuntimeError("components did not settle")
