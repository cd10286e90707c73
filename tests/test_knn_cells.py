import numpy as np
import pytest

from strataspark.operators import knn_cells
from strataspark.operators.knn_cells import knn_join_cells


def brute(vectors, queries, k, exclude_self=False):
    out = set()
    for q, x in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, v in vectors if not (exclude_self and i == q))
        out |= {(q, i, round(d, 9), r + 1) for r, (d, i) in enumerate(near[:k])}
    return out


def as_set(df):
    return {(x.query_id, x.id, round(x.distance, 9), x["rank"]) for x in df.collect()}


def test_clustered_vectors_need_few_pairs(spark, monkeypatch):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 6)) * 20
    vectors = [(f"v{i:04d}", (centres[i % 12] + r.normal(size=6)).tolist()) for i in range(1500)]
    vectors += [(f"w{i:03d}", vectors[0][1]) for i in range(150)]  # one vector very often
    queries = [(f"v{i:04d}", vectors[i][1]) for i in range(0, 1500, 15)] + [("far", [500.0] * 6), ("w000", vectors[0][1])]
    monkeypatch.setattr(knn_cells, "MEET", 16)
    v, q = spark.createDataFrame(vectors, "id string, embedding array<double>").repartition(3), spark.createDataFrame(queries, "query_id string, embedding array<double>")
    for exclude, k in ((False, 7), (True, 3)):
        out, report = knn_join_cells(v, q, k, exclude, pivots=24, chunk_bytes=48 * 40)
        assert as_set(out) == brute(vectors, queries, k, exclude)
        x = report.first()
        assert x.pairs == 1650 * 102 and x.computed < 0.5 * x.pairs


@pytest.mark.parametrize("k", [1, 50])
def test_odd_vectors_and_small_tables(spark, k):
    vectors = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.0, 2.0])]
    queries = [(1, [0.0, 0.1]), (2, None), (3, [0.0, float("inf")]), (9, [5.0, 5.0])]
    v, q = spark.createDataFrame(vectors, "id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, embedding array<double>")
    out, report = knn_join_cells(v, q, k)
    assert as_set(out) == brute([x for x in vectors if x[0] in (1, 2, 3, 8)], [queries[0], queries[3]], k) and report.first().pairs == 8
    assert knn_join_cells(v.limit(0), q, k)[0].count() == 0 and knn_join_cells(v, q.limit(0), k)[0].count() == 0
