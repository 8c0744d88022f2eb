"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.lineage import cut


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): for each node of ``edges`` (a bigint, b bigint) the least
    node it is connected to.

    Alternates two star steps on the edge table: every node's larger neighbours, then
    its smaller ones, are tied to the least node in sight, until the edges are stars.
    This takes about log(n) rounds on paths too. Self-loops and null ends are ignored;
    a node that only occurs in these is not in the result.
    """
    e = cut(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(most):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small step: edges now point to smaller nodes
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = cut(small.select("x.a", "x.b").where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**40)))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", F.col("b").alias("c")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
