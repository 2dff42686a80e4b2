"""Exact neighbours through pivots against brute force, with ties and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import retrieval as R

SCHEMA = "base_id long, embedding array<double>"


def _clustered(rng, n, dims=16, groups=40):
    centres = rng.normal(size=(groups, dims)) * 4
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.15


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_neighbours_equal_brute_force(spark, metric):
    rng = np.random.default_rng(2)
    x = _clustered(rng, 3000)
    x[100:140] = x[100]  # ties
    x[200:220] = 2 * x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [None] * 16), (9004, [float("nan")] * 16), (9005, [float("inf")] * 16), (9006, [1.0] * 5), (9007, [2.0] * 5)]
    base = spark.createDataFrame(rows + odd, SCHEMA)
    asked = base.filter("base_id % 50 = 0 or base_id > 9000").withColumnRenamed("base_id", "query_id")
    got = {}
    for r in R.knn_join(asked, base, 3, metric, but_itself=True, chunk=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.base_id, r.distance))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 3000, 50):
        d = 1 - u @ u[q] if metric == "cosine" else ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        own = sorted(got.pop(q))
        assert [r for r, _, _ in own] == [1, 2, 3]
        assert np.allclose([z for _, _, z in own], np.sort(d)[:3], atol=1e-9)
        assert all(abs(d[b] - z) < 1e-9 for _, b, z in own)
    assert {q: [b for _, b, _ in v] for q, v in got.items()} == {9006: [9007], 9007: [9006]}
    tied = sorted((r["rank"], r.base_id) for r in R.knn_join(asked.filter("query_id = 100"), base, 3, metric, but_itself=True).collect())
    assert tied == [(1, 101), (2, 102), (3, 103)]
    assert R.knn_join(asked.limit(0), base, 3, metric).count() == 0 and R.knn_join(asked, base.limit(0), 3, metric).count() == 0


def test_grouped_vectors_leave_most_parts_out(spark):
    rng = np.random.default_rng(3)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_clustered(rng, 8000))], SCHEMA)
    asked = base.filter("base_id % 50 = 0").withColumnRenamed("base_id", "query_id")
    seen = R.knn_visits(asked, base, 3).agg(F.sum("visited"), F.sum("parts"), F.count(F.lit(1))).first()
    assert seen[2] == 160 and seen[0] <= 0.2 * seen[1]


def test_similar_events_at_the_operators_own_limit(spark):
    """Neighbours at cosine 0.8 and above are found, those just below are not."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = set()
    for k in range(40):
        a = x[k] / np.linalg.norm(x[k])
        b = rng.normal(size=32)
        b -= a * (a @ b)
        c = [0.95, 0.801, 0.799, 0.6][k % 4]
        rows.append((5000 + k, (a * c + b / np.linalg.norm(b) * (1 - c * c) ** 0.5).tolist()))
        if c >= 0.8:
            want.add((k, 5000 + k))
    base = spark.createDataFrame(rows, SCHEMA)
    asked = base.filter("base_id < 40").withColumnRenamed("base_id", "query_id")
    assert {(r.query_id, r.base_id) for r in R.similar_events(asked, base, but_itself=True).collect()} == want
