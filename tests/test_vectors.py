"""Nearest neighbours: ties beyond k."""

import numpy as np
import pyarrow as pa

from folioforge.operators import vectors as V


def test_ties_beyond_k_go_to_the_least_ids():
    rng = np.random.default_rng(0)
    ids = rng.permutation(5000).astype(np.int64)
    axes = np.eye(8)[rng.integers(0, 8, 5000)] * rng.choice([-1.0, 1.0], (5000, 1))  # equally near, not all equal
    for x in (np.ones((5000, 8)), axes):
        vec = pa.ListArray.from_arrays(np.arange(0, 5000 * 8 + 1, 8, dtype=np.int32), pa.array(x.ravel()))
        batch = pa.record_batch([pa.array(ids), vec], names=["id", "vec"])
        for batches in ([batch], [batch[:1700], batch[1700:]]):
            found = pa.Table.from_batches(V._nearest(iter(batches), np.array([7]), np.zeros((1, 8)), 24))
            assert found["id"].to_pylist() == list(range(24))


def test_knn_names_the_least_ids_of_copies(spark):
    rows = spark.createDataFrame([(i * 37 % 401, [1.0, 2.0]) for i in range(401)], "id bigint, vec array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "qid bigint, vec array<double>")
    assert sorted((r["rank"], r.id) for r in V.knn(q, rows, 3, 2).collect()) == [(0, 0), (1, 1), (2, 2)]
