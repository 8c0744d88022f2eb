"""Joins whose hot keys are spread over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def pairs_by_key(rows: DataFrame, key: str, ident: str, block: int = 2000, keep: str = "true") -> DataFrame:
    """All distinct pairs ``(a, b)``, a < b, of ``ident`` that share a ``key`` and meet
    the SQL predicate ``keep`` over (a, b), which is asked before pairs are shuffled.

    Every bucket is split into ``g = ceil(size / block)`` blocks: the left copy of a
    row goes to one block, the right copy to all ``g``, so that no task sees more
    than ``block`` left rows of one bucket and no pair is lost. Buckets of one row
    are dropped before the join, since they hold no pair. Null keys and null
    idents join nothing. The join is sort-merge by hint: rows compress so well that
    they would be broadcast. Sizes come from the same shuffle as the rows.
    """
    rows = rows.select(F.col(key).alias("_k"), F.col(ident).alias("_i")).where("_k is not null and _i is not null")
    sized = rows.withColumn("_n", F.count("*").over(W.partitionBy("_k"))).where("_n > 1")
    sized = sized.withColumn("_g", F.ceil(F.col("_n") / block).cast("int"))
    left = sized.select("_k", F.col("_i").alias("a"), F.pmod(F.xxhash64("_i"), F.col("_g")).cast("int").alias("_s"))
    right = sized.select("_k", F.col("_i").alias("b"), F.explode(F.expr("sequence(0, _g - 1)")).alias("_s"))
    return left.join(right.hint("merge"), ["_k", "_s"]).where("a < b").where(keep).select("a", "b").distinct()


def meet_by_key(left: DataFrame, right: DataFrame, key: str, block: int = 2000) -> DataFrame:
    """All distinct pairs ``(a, b)`` of left (key, a) and right (key, b) that share a key.

    Both sides of a bucket are split into blocks of about ``block`` rows, and every left
    block meets every right one, so that no task sees more than ``block`` rows a side of
    one bucket and no pair is lost. Null keys join nothing.
    """
    sides, sizes = {"a": left.select(key, "a"), "b": right.select(key, "b")}, None
    for s, d in sides.items():
        n = d.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias(f"_g{s}"))
        sizes = n if sizes is None else sizes.join(n, key)
    for s, other in (("a", "b"), ("b", "a")):
        mine, every = F.pmod(F.xxhash64(s), F.col(f"_g{s}")).cast("int"), F.explode(F.expr(f"sequence(0, _g{other} - 1)"))
        sides[s] = sides[s].join(sizes, key).select(key, s, mine.alias(f"_s{s}"), every.alias(f"_s{other}"))
    return sides["a"].join(sides["b"], [key, "_sa", "_sb"]).select("a", "b").distinct()


def spread(df: DataFrame, rows: int, per_task: int = 20_000) -> DataFrame:
    """``df`` in partitions of about equal numbers of rows, at least one for each core
    where there are some hundred rows for it. Adaptive execution leaves such partitions
    alone, while it joins small ones by bytes before slow Python."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-rows // per_task), min(cores, rows // 200)))
