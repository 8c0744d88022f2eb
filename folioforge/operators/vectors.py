"""Exact nearest neighbours by squared L2 distance, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: Queries that are compared with a pass over the rows; a bound on what is sent out.
BLOCK = 4096
#: Exact distances that are taken at once; a bound on memory, however many are tied.
PAIRS = 100_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def _nearest(batches: Iterator[pa.RecordBatch], qids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of this partition's rows for every query, kept as rows pass."""
    best: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # of equal vectors only the k least ids can be among the k nearest
        x, ids = _matrix(batch.column("vec"), q.shape[1]) + 0.0, batch.column("id").to_numpy()
        same = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)[1]
        order = np.lexsort((ids, same))
        first = np.searchsorted(same[order], same[order])
        mine = np.sort(order[np.arange(len(order)) - first < k])
        x, ids = x[mine], ids[mine]
        for s in range(0, len(q), 512):
            part = q[s : s + 512]
            size = (part**2).sum(1)[:, None] + (x**2).sum(1)[None]
            near = size - 2 * part @ x.T
            # all that may tie with the k-th once rounded, then exact distances for them
            n = min(k, len(ids)) - 1
            most = np.partition(near, n, axis=1)[:, n] + 2e-6 + 1e-12 * size.max(axis=1)
            some, what = np.nonzero(~(near > most[:, None]))
            for at in range(0, len(some), PAIRS):
                i, j = some[at : at + PAIRS], what[at : at + PAIRS]
                exact = ((part[i] - x[j]) ** 2).sum(axis=1)
                best.append(_cut(pa.table({"qid": qids[s + i], "id": ids[j], "distance": np.round(exact, 6)}), k))
        if len(best) > 16:
            best = [_cut(pa.concat_tables(best), k)]
    if best:
        yield from _cut(pa.concat_tables(best), k).combine_chunks().to_batches()


def _cut(t: pa.Table, k: int) -> pa.Table:
    qid, idv, d = (t[c].to_numpy() for c in ("qid", "id", "distance"))
    order = np.lexsort((idv, d, qid))
    qs = qid[order]
    starts = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]])
    rank = np.arange(len(qs)) - np.repeat(starts, np.diff(np.r_[starts, len(qs)]))
    return t.take(pa.array(order[rank < k]))


def knn(queries: DataFrame, rows: DataFrame, k: int, dim: int) -> DataFrame:
    """(qid, id, distance, rank): the k rows (id, vec) nearest to each query (qid, vec)
    by squared L2 distance rounded to six digits, ties by id; rank from 0.

    Vectors of another length, and nulls, take no part; fewer than k rows give fewer.
    Queries are sent out in blocks of ``BLOCK``, each a pass over the rows; what a
    partition returns is k rows for each query.
    """
    queries = queries.where(F.size("vec") == dim).select("qid", "vec").withColumn("part", F.lit(0))
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    rows = rows.where(F.size("vec") == dim).select("id", "vec")
    found = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).orderBy("qid").toArrow()
        if not len(mine):
            continue
        ids, q = mine["qid"].to_numpy(), _matrix(mine["vec"].combine_chunks(), dim)
        near = rows.mapInArrow(lambda it, ids=ids, q=q: _nearest(it, ids, q, k), "qid bigint, id bigint, distance double")
        found = near if found is None else found.union(near)
    if found is None:
        return rows.sparkSession.createDataFrame([], "qid bigint, id bigint, distance double, rank int")
    order = W.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def nearest_groups(queries: DataFrame, rows: DataFrame, k: int, dim: int) -> DataFrame:
    """(qid, grp, distance): the k groups with the nearest row, from the 3 k nearest
    rows (id, grp, vec)."""
    near = knn(queries, rows, 3 * k, dim).join(rows.select("id", "grp"), "id").groupBy("qid", "grp").agg(F.min("distance").alias("distance"))
    order = W.partitionBy("qid").orderBy("distance", "grp")
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def cosine(a: str, b: str) -> F.Column:
    """Cosine similarity of two array columns, rounded to six digits."""
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"
    norm = lambda c: f"sqrt(aggregate({c}, 0D, (s, x) -> s + cast(x as double) * x))"
    return F.expr(f"round(try_divide({dot}, {norm(a)} * {norm(b)}), 6)")


def fitness(vec: F.Column, dim: int) -> F.Column:
    """fits, or why a vector cannot be added: missing or size."""
    return F.when(vec.isNull(), "missing").when(F.size(vec) != dim, "size").otherwise("fits")


def rerank(pairs: DataFrame, dim: int) -> DataFrame:
    """``pairs`` (qvec, vec, ...) with their squared L2 distance, rounded to six digits;
    1e9 where either vector is missing or of another length."""
    apart = F.aggregate(F.zip_with("qvec", "vec", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    fit = (F.size("qvec") == dim) & (F.size("vec") == dim)
    return pairs.withColumn("distance", F.coalesce(F.when(fit, F.round(apart, 6)), F.lit(1e9)))
