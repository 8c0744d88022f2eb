"""Problem 1: papers that fill their rows' windows with themselves."""

import numpy as np
import pyarrow as pa

from folioforge.llm import neighbours

VEC = "id bigint, grp bigint, vec array<float>, valid boolean"


def recall(spark, x, grp, some, forest=neighbours.Forest()):
    """Share of the true best five of the rows ``some`` that is found."""
    rows = [(i, int(g), [float(v) for v in r], True) for i, (g, r) in enumerate(zip(grp, x, strict=True))]
    got = {(r.id, r.near_id) for r in neighbours.most_similar(spark.createDataFrame(rows, VEC), 5, dim=x.shape[1], min_similarity=0.9, forest=forest).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = set()
    for i in some:
        s = np.where(grp == grp[i], -2, u @ u[i])
        want |= {(i, int(j)) for j in np.argsort(-s, kind="stable")[:5] if s[j] >= 0.9}
    assert len(want) > 4 * len(some)
    return len(got & want) / len(want)


def crowd(alike=700, others=30, n=9000, dim=16):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, dim))
    x[: alike + others] = rng.standard_normal(dim) + 0.1 * rng.standard_normal((alike + others, dim))
    grp = np.r_[np.full(alike, 1), np.arange(2, 2 + n - alike)]
    mix = rng.permutation(n)
    return x[mix].astype(np.float32), grp[mix]


def test_a_paper_below_a_tenth_of_the_rows_does_not_hide_its_neighbours(spark):
    x, grp = crowd()
    assert recall(spark, x, grp, np.flatnonzero(grp == 1)[:200], neighbours.Forest(trees=3, window=32)) >= 0.98


def test_a_copy_in_another_paper_leaves_the_crowd_its_neighbours(spark):
    x, grp = crowd()
    mine = np.flatnonzero(grp == 1)[:40]
    far = np.flatnonzero(grp > 100)[: len(mine)]
    x[far] = x[mine]  # one copy each in a paper of its own: classes of two groups
    assert recall(spark, x, grp, mine) >= 0.98


def test_near_copies_with_equal_keys(spark):
    """Every tree shows other rows of equal keys, and one-byte ties are not cut."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[:900] = (x[0] + 0.001 * rng.standard_normal((900, 16))).astype(np.float32)
    assert recall(spark, x, np.arange(3000), np.arange(0, 900, 5), neighbours.Forest(window=16)) >= 0.95


def test_twins_at_the_bounds_of_range_partitions(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1000, 32))
    rows = [(2 * i + j, 2 * i + j, [float(v) * (1 + 1e-3 * j) for v in r], True) for i, r in enumerate(x) for j in (0, 1)]
    forest = neighbours.Forest(trees=1, window=1, rows_per_task=43)
    got = neighbours.most_similar(spark.createDataFrame(rows, VEC), 1, dim=32, min_similarity=0.99, forest=forest).collect()
    assert {(r.id, r.near_id) for r in got} == {(i, i ^ 1) for i in range(2000)}


def test_errors_of_quantising_are_packed_and_never_rounded_down():
    rng = np.random.default_rng(8)
    q = rng.integers(-127, 128, (500, 16)).astype(np.int8)
    off = np.r_[1e-5, 0.0, 0.3, 10.0 ** rng.uniform(-6, 0, 497)].astype(np.float32)
    got_q, got_off = neighbours._unpacked(pa.chunked_array([neighbours._packed(q, off)]).slice(3), 16)
    assert (got_q == q[3:]).all() and (got_off >= off[3:]).all() and (got_off <= off[3:] * 1.01 + 1e-6).all()


def test_rows_without_copies_are_shuffled_a_few_times_only(spark):
    """The trees' arrays, counts and one join; neither their keys nor a join of all rows for copies."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        store = context.statusStore()
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rng, n = np.random.default_rng(9), 6000
    x = rng.standard_normal((n, 64))
    rows = spark.createDataFrame([(i, i, [float(v) for v in r], True) for i, r in enumerate(x)], VEC)
    before, forest = written(), neighbours.Forest(trees=2, window=16, rows_per_task=2000)
    neighbours.most_similar(rows, 5, min_similarity=0.9, forest=forest).collect()
    assert 0 < written() - before < 850 * n  # 735 and, with keys and copies' joins of all rows, 988
