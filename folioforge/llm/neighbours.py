"""Problem 1: the k most similar vectors of other groups for every vector.

Method: a forest of hash-prefix trees. A tree hashes a vector to a string of 60
sign bits; a tree is the array of all rows sorted by that string, equal strings by a
hash of tree and id, so that trees show different ones of them. Rows under one node of
the tree, those with a common prefix, stand together. Descent: in every tree the rows of
other groups under each node above a row are counted, from its longest prefix up.
Ascent: all trees go up in step, level by level, until together they hold ``enough``
rows of other groups; that level is the row's depth. Then every tree gives the rows of
other groups under the row's node of that depth, at most ``window`` on either side of
its place, the nearest in the order. Rows gathered are compared on vectors quantised to
one byte a number, with the error of each; all that may be among the k best are merged
and checked on the full vectors.

Scale: the sorted arrays are range partitions of one shuffle of T small records a
row (key, id, group, 66 bytes: the quantised vector and its error), for the descent
without the vectors. Keys are made from the quantised vectors where they are needed, and
the counts of a row travel as one value. A range partition's
bounds include the hash of the id, so equal hash strings are split too; what the descent
does not see beyond them only makes a row ascend further. Rows at the partitions' bounds
are gathered once more, from both sides. Rows with bit-equal vectors are one class and
travel once; a class keeps the ten smallest ids with at most five of one group,
from which the five smallest ids outside any group can always be read.

Defined results: rows with a null id, a null, short, long, all-zero or non-finite
vector, or is_valid other than true are no rows. Repeated rows count once. Equal
similarities are ordered by id. A null group is a group of its own for each row.
Tables without usable rows give an empty result. Only the named columns are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from folioforge.plans.lineage import cut
from folioforge.sources.tables import table

BITS = 60
#: Levels of a tree at which the ascent may stop: lengths of common prefixes, the longest first.
LEVELS = tuple(range(BITS, -1, -4))
#: Positions of one tree that are compared at once.
BLOCK = 256


@dataclass(frozen=True)
class Forest:
    """trees: number of sorted arrays; enough: rows of other groups that the trees hold
    together when the ascent stops; window: rows gathered at most on either side of a
    row's place in each; sample: rows on which the centre is fitted (a bound)."""

    trees: int = 10
    window: int = 128
    enough: int = 1280
    sample: int = 8192
    seed: int = 7
    rows_per_task: int = 40_000


def usable(rows: DataFrame, dim: int) -> DataFrame:
    """(id, grp, vec): valid rows with a vector of ``dim`` numbers."""
    return rows.where(F.col("id").isNotNull() & F.col("valid") & (F.size("vec") == dim)).select("id", "grp", "vec")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(flat), dim)


def _planes(forest: Forest, dim: int) -> np.ndarray:
    """Random orthogonal directions for each tree, (dim, trees * BITS)."""
    rng = np.random.default_rng(forest.seed)
    made = []
    for _ in range(forest.trees):
        blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-BITS // dim))]
        made.append(np.concatenate(blocks, axis=1)[:, :BITS])
    return np.concatenate(made, axis=1).astype(np.float32)


def _centre(rows: DataFrame, total: int, forest: Forest, dim: int) -> np.ndarray:
    """Mean direction of a bounded sample: about ``forest.sample`` rows, taken by
    the hash of their ids, so that a retry takes the same."""
    every = max(1, total // forest.sample)
    got = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vec").toArrow()
    if not len(got):
        return np.zeros(dim, np.float32)
    m = _matrix(got["vec"], dim)
    m = m[np.isfinite(m).all(axis=1)]
    norm = np.linalg.norm(m, axis=1)
    m = m[norm > 0] / norm[norm > 0, None]
    return m.mean(axis=0).astype(np.float32) if len(m) else np.zeros(dim, np.float32)


def _packed(q: np.ndarray, off: np.ndarray) -> pa.Array:
    """Quantised rows, each followed by its error in two bytes, rounded up: as one value,
    since every tree carries it through a shuffle."""
    half = off.astype(np.float16)
    half = np.where(half < off, np.nextafter(half, np.float16(np.inf)), half)
    both = np.ascontiguousarray(np.concatenate([q.view(np.uint8), half[:, None].view(np.uint8)], axis=1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(both.shape[1]), len(both), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(quantised rows, their errors) of ``_packed``."""
    packed = column.combine_chunks()
    both = np.frombuffer(packed.buffers()[2], dtype=np.uint8, count=len(packed) * (dim + 2), offset=packed.offset * (dim + 2)).reshape(-1, dim + 2)
    return both[:, :dim].view(np.int8), np.ascontiguousarray(both[:, dim:]).view(np.float16)[:, 0].astype(np.float32)


def _quantise(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        m = _matrix(batch.column("vec"), dim)
        norm = np.linalg.norm(m, axis=1)
        keep = np.isfinite(m).all(axis=1) & (norm > 0) & np.isfinite(norm)
        batch, m = batch.filter(pa.array(keep)), m[keep] / norm[keep, None]
        top = np.abs(m).max(axis=1, keepdims=True)
        q = np.rint(m / top * 127).astype(np.int8)
        # what quantising moves the unit vector by, with room for float32 products
        off = np.linalg.norm(m - q / np.linalg.norm(q.astype(np.float32), axis=1, keepdims=True), axis=1) + 1e-5
        yield pa.record_batch([*(batch.column(c) for c in ("id", "grp", "h1", "h2")), _packed(q, off)], names=["id", "grp", "h1", "h2", "q"])


def _hash(batches: Iterator[pa.RecordBatch], planes: np.ndarray, centre: np.ndarray, trees: int, dim: int) -> Iterator[pa.RecordBatch]:
    """The rows with their keys in each tree, from the quantised vectors: keys are as long
    as these, so that they are made again rather than shuffled."""
    weights = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).astype(np.float64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        m = _unpacked(pa.chunked_array([batch.column("q")]), dim)[0].astype(np.float32)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        bits = ((m - centre) @ planes > 0).reshape(n, trees, BITS)
        # two exact halves of 30 bits, since float64 products carry 53
        half = BITS // 2
        high = bits[:, :, :half].astype(np.float64) @ weights[half:]
        low = bits[:, :, half:].astype(np.float64) @ weights[half:]
        keys = (high.astype(np.int64) << half) | low.astype(np.int64)
        yield batch.append_column("keys", pa.ListArray.from_arrays(np.arange(0, n * trees + 1, trees, dtype=np.int32), pa.array(keys.reshape(-1))))


def _bounds(at: np.ndarray, asked: np.ndarray, grp: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For askers at the places ``at`` among rows of the groups ``grp``, the ranges that
    hold ``window`` rows of groups other than ``asked`` on either side, or all there are."""
    n = len(grp)
    code = np.unique(np.concatenate([grp, asked]), return_inverse=True)[1].astype(np.int64) * (n + 1)
    mine, asks = code[:n], code[n:]
    order = np.argsort(mine, kind="stable")
    first = np.searchsorted(mine[order], mine[order])
    places = mine[order] + order
    strangers = places - (np.arange(n) - first)  # rows of other groups before each row
    start, end = np.searchsorted(mine[order], asks), np.searchsorted(mine[order], asks, side="right")
    before = at - (np.searchsorted(places, asks + at) - start)

    def place(rank: np.ndarray) -> np.ndarray:
        return rank + np.searchsorted(strangers, asks + rank, side="right") - start

    left, right = before - window, before + window - 1
    a = np.where(left < 0, 0, place(np.maximum(left, 0)))
    b = np.where(right >= n - (end - start), n, place(np.minimum(right, n - 1)) + 1)
    return a, b


def _descend(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.RecordBatch]:
    """One range partition of one or more trees, each in order: for its asking rows the
    number of shown rows of other groups that share each of LEVELS of their prefix; more
    than ``enough`` are as good as ``enough``, and such numbers pack better."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    trees, keys, cids, grps = (t[c].to_numpy() for c in ("tree", "key", "cid", "grp"))
    asks, shown = (t[c].to_numpy(zero_copy_only=False) for c in ("asks", "shown"))

    def per_run(fresh: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each place the weight of its run; ``fresh`` marks the places where one begins."""
        run = np.cumsum(fresh) - 1
        return np.bincount(run, weight)[run]

    for tree in np.unique(trees):
        lo, hi = np.searchsorted(trees, [tree, tree + 1])
        key, grp, seen = keys[lo:hi], grps[lo:hi], shown[lo:hi].astype(np.float64)
        order = np.argsort(grp, kind="stable")  # by group, then place: equal prefixes stay together
        other = np.r_[True, grp[order][1:] != grp[order][:-1]]
        columns = []
        for length in LEVELS:
            prefix = key >> (BITS - length)
            every = per_run(np.r_[True, prefix[1:] != prefix[:-1]], seen)
            mine = prefix[order]
            own = np.empty(hi - lo)
            own[order] = per_run(other | np.r_[True, mine[1:] != mine[:-1]], seen[order])
            columns.append(np.minimum(every - own, enough).astype(np.int16 if enough < 2**15 else np.int32))
        who = asks[lo:hi]
        numbers = np.stack([c[who] for c in columns], axis=1)
        yield pa.record_batch(
            [
                pa.array(cids[lo:hi][who]),
                pa.array(np.where(shown[lo:hi], 0, grp)[who]),
                pa.array(shown[lo:hi][who]),
                pa.ListArray.from_arrays(np.arange(0, numbers.size + 1, len(LEVELS), dtype=np.int32), pa.array(numbers.reshape(-1))),
            ],
            names=["cid", "view", "shown", "n"],
        )


def _gather(ask: np.ndarray, a: np.ndarray, b: np.ndarray, z: np.ndarray, off: np.ndarray, grp: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, least: float, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the rows ``ask``, those of other groups and classes in the ranges ``a`` to
    ``b`` of the rows ``c`` that may be among the best ``k`` and reach ``least``, by the
    bounds of their similarity: (row, rows found, quantised similarities)."""
    for s in range(0, len(ask), BLOCK):
        e = min(s + BLOCK, len(ask))
        low, high = a[s:e].min(), b[s:e].max()
        if high - low > 16 * (BLOCK + 2 * window):  # sparse askers: their ranges lie far apart
            pieces = [(i, i + 1, a[i], b[i]) for i in range(s, e)]
        else:
            pieces = [(s, e, low, high)]
        for x0, x1, low, high in pieces:
            r, near = ask[x0:x1], c[low:high]
            sim = z[r] @ z[near].T
            sim[(grp[r, None] == grp[None, near]) | (cid[r, None] == cid[None, near])] = -4
            floor = np.full(len(r), max(least, -1.5), np.float32)
            if least <= -1 and len(near) > k:
                floor = np.maximum(floor, -np.partition(off[None, near] - sim, k - 1, axis=1)[:, k - 1] - off[r])
            some, what = np.nonzero(sim + off[None, near] >= (floor - off[r])[:, None])
            if not len(some):
                continue
            starts = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
            for x, y in zip(starts, np.r_[starts[1:], len(some)], strict=True):
                cols = what[x:y]
                v = sim[some[x], cols]
                if len(cols) > k:
                    o = off[near[cols]]
                    ok = v + o >= -np.partition(o - v, k - 1)[k - 1] - 2 * off[r[some[x]]]
                    cols, v = cols[ok], v[ok]
                yield r[some[x]], near[cols], v


def _search(z: np.ndarray, off: np.ndarray, grp: np.ndarray, cid: np.ndarray, asks: np.ndarray, shown: np.ndarray, key: np.ndarray, depth: np.ndarray, k: int, least: float, window: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """What the asking rows of a sorted array find among those shown under their node of
    ``depth``. A range holds up to ``window`` rows of other groups on either side, however
    many of its own stand there."""
    own, c = np.flatnonzero(asks), np.flatnonzero(shown)
    rest = BITS - depth.astype(np.int64)  # bits below the node
    node = (key >> rest) << rest

    def under(rows: np.ndarray, among: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.searchsorted(key[among], node[rows])
        end = np.searchsorted(key[among], node[rows] + (np.int64(1) << rest[rows]))
        return np.maximum(a, start), np.maximum(np.minimum(b, end), np.maximum(a, start))

    a, b = under(own, c, *_bounds(np.searchsorted(c, own), grp[own], grp[c], window))
    wide = b - a > 4 * window  # own rows fill these: they are left out before the products
    found = list(_gather(own[~wide], a[~wide], b[~wide], z, off, grp, cid, c, k, least, window))
    crowd = own[wide]
    crowd = crowd[np.argsort(grp[crowd], kind="stable")]
    for mine in np.split(crowd, np.flatnonzero(np.diff(grp[crowd])) + 1):
        if len(mine):
            others = c[grp[c] != grp[mine[0]]]
            at = np.searchsorted(others, mine)
            a, b = under(mine, others, np.maximum(at - window, 0), np.minimum(at + window, len(others)))
            found += _gather(mine, a, b, z, off, grp, cid, others, k, least, window)
    return found


def _ascend(batches: Iterator[pa.RecordBatch], k: int, least: float, window: int, dim: int) -> Iterator[pa.RecordBatch]:
    """One range partition of one or more trees, each in order: the bounds of the
    similarity to what its asking rows may have among their best ``k``."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    trees, cids, grps, keys, depths = (t[c].to_numpy() for c in ("tree", "cid", "grp", "key", "depth"))
    asks, shown = (t[c].to_numpy(zero_copy_only=False) for c in ("asks", "shown"))
    q, offs = _unpacked(t["q"], dim)
    for tree in np.unique(trees):
        lo, hi = np.searchsorted(trees, [tree, tree + 1])
        z = q[lo:hi].astype(np.float32)
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        cid, grp, off = cids[lo:hi], grps[lo:hi], offs[lo:hi]
        found = _search(z, off, grp, cid, asks[lo:hi], shown[lo:hi], keys[lo:hi], depths[lo:hi], k, least, window)
        for s in range(0, len(found), 20_000):
            part = found[s : s + 20_000]
            n = np.fromiter((len(x[1]) for x in part), np.int64, len(part))
            of = np.repeat(np.fromiter((x[0] for x in part), np.int64, len(part)), n)
            to, sim = np.concatenate([x[1] for x in part]), np.concatenate([x[2] for x in part])
            yield pa.record_batch(
                [
                    pa.array(cid[of]),
                    pa.array(grp[of]),
                    pa.array(cid[to]),
                    pa.array((sim - off[of] - off[to]).astype(np.float32)),
                    pa.array((sim + off[of] + off[to]).astype(np.float32)),
                ],
                names=["cid", "view", "near", "low", "high"],
            )


def _edge(grp: np.ndarray, shown: np.ndarray, window: int) -> int:
    """How many rows from the start hold ``window`` shown rows outside any one group."""
    n = 2 * window
    while n < len(grp):
        some = grp[:n][shown[:n]]
        if len(some) and len(some) - np.unique(some, return_counts=True)[1].max() >= window:
            break
        n *= 2
    return min(n, len(grp))


def _edges(batches: Iterator[pa.RecordBatch], window: int, many: int) -> Iterator[pa.RecordBatch]:
    """The first and last rows of a range partition, for the seams with the partitions
    before and after it: ``tree`` tells seam and tree, ``pos`` the place in the order."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t, here = pa.Table.from_batches(got).combine_chunks(), TaskContext.get().partitionId()
    tree, grp = t["tree"].to_numpy(), t["grp"].to_numpy()
    shown = t["shown"].to_numpy(zero_copy_only=False)
    first, last = np.searchsorted(tree, tree[0], side="right"), np.searchsorted(tree, tree[-1])
    start = np.arange(_edge(grp[:first], shown[:first], window))
    end = np.arange(len(tree) - _edge(grp[last:][::-1], shown[last:][::-1], window), len(tree))
    for seam, rows in ((here, start), (here + 1, end)):
        part = t.take(pa.array(rows)).drop_columns(["tree"])
        part = part.append_column("tree", pa.array(seam * many + tree[rows].astype(np.int64))).append_column("pos", pa.array(here * 2**32 + rows))
        yield from part.combine_chunks().to_batches()


def _exact(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (_matrix(b.column(c), dim).astype(np.float64) for c in ("vec", "near_vec"))
            sim = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.record_batch([b.column("cid"), b.column("near"), pa.array(sim)], names=["cid", "near", "similarity"])


def most_similar(rows: DataFrame, k: int = 5, *, dim: int = 64, min_similarity: float = -1.0, asks: str = "true", forest: Forest = Forest()) -> DataFrame:
    """(id, near_id, similarity, place): for each usable row that meets the SQL
    predicate ``asks`` over (id, grp), its ``k`` most similar usable rows of other
    groups with at least ``min_similarity``, found through the forest.

    ``rows`` needs id bigint, grp bigint, vec array<float>, valid boolean.
    """
    if k > 5:
        raise ValueError("a class keeps members for k up to 5")
    rows = rows.select("id", "grp", "vec", "valid")
    total = rows.where("valid").count()
    rows = usable(rows, dim)
    rows = rows.withColumn("grp", F.coalesce("grp", -1 - F.col("id")))
    hashed = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    planes, centre, trees = _planes(forest, dim), _centre(rows, total, forest, dim), forest.trees
    signed = hashed.mapInArrow(
        lambda it: _quantise(it, dim),
        "id bigint, grp bigint, h1 bigint, h2 bigint, q binary",
    )
    # asking is a row's property; a class asks if one of its rows does
    ask = F.expr(asks)
    classes = cut(
        signed.groupBy("h1", "h2").agg(
            F.min("id").alias("cid"), F.max("id").alias("last"), F.min("grp").alias("g0"), F.max("grp").alias("g1"),
            F.first("q").alias("q"), F.bool_or(F.coalesce(ask, F.lit(False))).alias("asks"),
        )
    )
    size = classes.count()
    several = classes.where("cid <> last").select("h1", "h2", "cid")
    # few rows are left of the pass over all, which is not made again for each use
    copies = cut(hashed.select("h1", "h2", "id", "grp").join(several, ["h1", "h2"]).select("cid", "id", "grp").distinct())
    # a class of several groups asks once more for each group that has fewer than k of
    # the class outside itself (nine groups at most), past that group's rows
    shares = copies.groupBy("cid", "grp").agg(F.count("*").alias("m"), F.bool_or(F.coalesce(ask, F.lit(False))).alias("asks"))
    sizes = copies.groupBy("cid").agg(F.count("*").alias("n"))
    views = shares.join(sizes, "cid").where(F.col("asks") & (F.col("n") > F.col("m")) & (F.col("n") - F.col("m") < k)).select("cid", "grp")
    shared = F.lit(-(2**62)) - F.col("cid")
    rows_of = classes.select("cid", "asks", "q", F.lit(True).alias("shown"), F.when(F.col("g0") == F.col("g1"), F.col("g0")).otherwise(shared).alias("grp"))
    # only classes of several rows have views, so that the others stay out of this join's shuffle
    views_of = classes.where("cid <> last").select("cid", F.lit(True).alias("asks"), "q", F.lit(False).alias("shown")).join(views, "cid")
    entries = rows_of.unionByName(views_of)
    tree, state = F.posexplode("keys").alias("tree", "key"), ["cid", "asks", "shown", "grp"]
    window, found = forest.window, "cid bigint, view bigint, near bigint, low float, high float"
    # equal keys stand in another order in each tree, so that each shows other rows
    order, ranges = ["tree", "key", F.xxhash64("tree", "cid")], max(1, -(-size * trees // forest.rows_per_task))
    in_order = lambda d: d.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the descent in every tree, then the level at which the trees together hold enough
    hashed_in = lambda d, more: d.mapInArrow(lambda it: _hash(it, planes, centre, trees, dim), f"cid bigint, asks boolean, shown boolean, grp bigint, q binary, {more}keys array<bigint>")
    number = "smallint" if forest.enough < 2**15 else "int"
    counts = in_order(hashed_in(entries.select(*state, "q"), "").select(tree, *state)).mapInArrow(lambda it: _descend(it, forest.enough), f"cid bigint, view bigint, shown boolean, n array<{number}>")
    # rows of one class and view stand in different partitions: there is nothing to sum before the shuffle
    whose = ["cid", "view", "shown"]
    held = counts.repartition(*whose).groupBy(*whose).agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{x}") for i, x in enumerate(LEVELS)])
    stop = F.coalesce(*[F.when(F.col(f"n{x}") >= forest.enough, x) for x in LEVELS], F.lit(0))
    entries = entries.withColumn("view", F.when(F.col("shown"), 0).otherwise(F.col("grp")))
    entries = entries.join(held.select(*whose, stop.cast("tinyint").alias("depth")), whose, "left").fillna(0, ["depth"])
    arrays = in_order(hashed_in(entries.select(*state, "q", "depth"), "depth tinyint, ").select(tree, *state, "q", "depth"))
    near = arrays.mapInArrow(lambda it: _ascend(it, k, min_similarity, window, dim), found)
    if ranges > 1:
        edges = arrays.mapInArrow(lambda it: _edges(it, window, trees), "key bigint, cid bigint, asks boolean, shown boolean, grp bigint, q binary, depth tinyint, tree bigint, pos bigint")
        seams = edges.repartition("tree").sortWithinPartitions("tree", "pos")
        near = near.unionByName(seams.mapInArrow(lambda it: _ascend(it, k, min_similarity, window, dim), found))
    near = near.repartition("cid").groupBy("cid", "view", "near").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    whole = W.partitionBy("cid", "view").orderBy(F.desc("low")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = near.withColumn("kth", F.nth_value("low", k).over(whole)).where(F.col("kth").isNull() | (F.col("high") >= F.col("kth")))
    # a pair that either side proposes is checked once, and counts for both
    near = cut(near.select(F.least("cid", "near").alias("cid"), F.greatest("cid", "near").alias("near")).distinct())

    # the exact check, on the vectors of rows that have candidates only
    wanted = near.select("cid").union(near.select(F.col("near").alias("cid"))).distinct()
    vectors = rows.select(F.col("id").alias("cid"), "vec").join(wanted, "cid", "left_semi").dropDuplicates(["cid"])
    scored = (
        near.join(vectors, "cid").join(vectors.select(F.col("cid").alias("near"), F.col("vec").alias("near_vec")), "near")
        .mapInArrow(lambda it: _exact(it, dim), "cid bigint, near bigint, similarity double")
    )

    # rows of classes: single ones stand for themselves, others keep a bounded list
    heads = (
        copies.withColumn("r", F.row_number().over(W.partitionBy("cid", "grp").orderBy("id"))).where(F.col("r") <= 5)
        .withColumn("m", F.row_number().over(W.partitionBy("cid").orderBy("id"))).where("m <= 10").select("cid", "id", "grp")
    )
    single = classes.where("cid = last").select("cid", F.col("cid").alias("id"), F.col("g0").alias("grp"))
    ways = F.array(F.struct("cid", "near"), F.struct(F.col("near").alias("cid"), F.col("cid").alias("near")))
    scored = scored.select(F.explode(ways).alias("x"), "similarity").select("x.cid", "x.near", "similarity")
    scored = scored.unionByName(several.select("cid", F.col("cid").alias("near"), F.lit(1.0).alias("similarity")))
    askers = single.union(copies).where(ask).select("cid", "id", "grp")
    members = single.union(heads).select(F.col("cid").alias("near"), F.col("id").alias("near_id"), F.col("grp").alias("near_grp"))
    reach = scored.where(F.col("similarity") >= min_similarity)
    pairs = reach.join(members, "near").join(askers, "cid").where("grp <> near_grp and id <> near_id")
    best = W.partitionBy("id").orderBy(F.desc("similarity"), "near_id")
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("id", "near_id", "similarity", "place")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "paper_chunks").select(
        "id", F.col("paper_id").alias("grp"), F.col("embedding_vector").alias("vec"), F.col("is_valid").alias("valid")
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of cosine similarity 0.90 or more, one among the other's best five."""
    best = most_similar(_chunks(spark, folder), 5, min_similarity=0.90)
    return best.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()


def p1_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar rows for every row whose id is divisible by 100,
    whatever the similarity; far neighbours need wider ranges than near ones."""
    wide = Forest(trees=16, window=4096, enough=65_536, rows_per_task=80_000)
    return most_similar(_chunks(spark, folder), 5, asks="id % 100 = 0", forest=wide)


QUERIES = {"p1_found": p1_found, "p1_topk": p1_topk}

SQL: dict[str, str] = {
    "p1_found": """
with u as (
  select distinct id, paper_id, embedding_vector::double[64] as v from paper_chunks
  where is_valid and len(embedding_vector) = 64 and len(list_filter(embedding_vector, lambda x: x <> 0)) > 0),
s as (
  select a.id, b.id as near_id, array_cosine_similarity(a.v, b.v) as sim
  from u a join u b on a.paper_id <> b.paper_id),
r as (
  select id, near_id, sim, row_number() over (partition by id order by sim desc, near_id) as place
  from s where sim >= 0.90)
select distinct least(id, near_id) as id_a, greatest(id, near_id) as id_b from r where place <= 5
""",
}
