"""Running totals over groups of any size, no group ever meeting in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.plans.lineage import cut


def _local(batches: Iterator[pd.DataFrame], group: list[str], measure: str) -> Iterator[pd.DataFrame]:
    """Adds the total up to and including each row within this sorted partition."""
    carry: dict[tuple, int] = {}
    part = TaskContext.get().partitionId()
    for pdf in batches:
        if not len(pdf):
            continue
        by = pdf.groupby(group, sort=False, dropna=False)
        codes = by.ngroup().to_numpy()
        local = by[measure].cumsum().to_numpy().astype("int64")
        first, last = codes[0], codes[-1]
        key = lambda i: tuple("\0null" if pd.isna(x) else x for x in pdf[group].iloc[i])
        head = carry.get(key(0), 0)
        if head:
            local = local + head * (codes == first)
        carry = {key(-1): int(local[-1])} if last is not None else {}
        yield pdf.assign(_part=part, _local=local)


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], measure: str, out: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """``df`` plus bigint ``out``: the sum of ``measure`` over the rows of the same
    ``group`` up to and including this one, in the order of ``order``.

    The rows are range-partitioned by (group, order), so a hot group spans as many
    partitions as it needs; each partition sums its own rows, and the partitions'
    totals, a row for each partition and group in it, are summed and joined back.
    ``order`` should be a total order: with ties, which row comes first is fixed only
    within one run. Null groups are one group; null measures count 0. The rows are
    written once to the shared folder, so pass narrow columns.
    """
    group, order = list(group), list(order)
    df = df.withColumn("_m", F.coalesce(F.col(measure).cast("bigint"), F.lit(0)))
    count = df.count()
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    placed = cut(
        df.repartitionByRange(max(1, -(-count // rows_per_task)), *group, *order)
        .sortWithinPartitions(*group, *order)
        .mapInPandas(lambda it: _local(it, group, "_m"), schema)
    )
    totals = placed.groupBy("_part", *group).agg(F.sum("_m").alias("_t"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    names = [f"_g{i}" for i in range(len(group))]
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    totals = totals.select(F.col("_part").alias("_p"), "_before", *[F.col(g).alias(n) for g, n in zip(group, names, strict=True)])
    same = F.col("_part") == F.col("_p")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    joined = placed.join(totals, same)
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_m", "_part", "_local", "_p", "_before", *names)
