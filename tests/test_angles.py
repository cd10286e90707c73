import random

import numpy as np
import pytest

from strataspark import queries
from strataspark.operators import angles, cluster
from tests.test_store import T, greedy_by_hand

KIND = "id long, embedding array<float>"


def clustered(seed, centres, each, spread, size=8):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, size))
    return [[float(np.float32(x)) for x in middle[i % centres] + spread * r.normal(size=size)] for i in range(centres * each)]


def by_hand(vectors, threshold):
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = (x @ x.T).astype(np.float32)
    i, j = np.nonzero(np.triu(s >= np.float32(threshold), 1))
    return {(int(a), int(b)) for a, b in zip(i, j, strict=True)}


def spelled(links):
    """All pairs of the links; none comes twice."""
    pairs = [(r.a, r.b) for r in links.pairs.collect()]
    of = {}
    for r in links.members.collect():
        of.setdefault(r.chunk, []).append(r.id)
    for r in links.full.collect():
        pairs += [(min(a, b), max(a, b)) for a in of[r.a] for b in of[r.b] if r.a != r.b or a < b]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


@pytest.mark.parametrize(("threshold", "spread"), [(0.9, 0.1), (0.6, 0.5), (-0.2, 0.3)])
def test_links_are_all_pairs(spark, threshold, spread):
    vectors = clustered(5, 12, 40, spread)
    df = spark.createDataFrame(list(enumerate(vectors)), KIND)
    want = by_hand(vectors, threshold)
    links = angles.cosine_links(df, threshold, chunk_rows=16, pivots=24)
    assert spelled(links) == want and len(want) > 1000
    counts = np.bincount(np.array(list(want)).ravel(), minlength=len(vectors))
    assert {r.id: r.links for r in angles.link_counts(links).collect()} == {i: n for i, n in enumerate(counts.tolist()) if n}
    report = links.report.first()
    assert report.pairs == 480 * 479 // 2 and report.given == len(want) - links.pairs.count()
    if threshold == 0.9:  # what lies apart is skipped, what lies close is given
        assert report.computed < 0.2 * report.pairs and report.given > 0.3 * len(want)
    got = {(r.a, r.b): r.cosine for r in angles.cosine_pairs(df, threshold, chunk_rows=16, pivots=24).collect()}
    assert set(got) == want and all(v >= threshold - 1e-6 for v in got.values())


def test_a_dense_group_has_few_rows(spark):
    vectors = clustered(2, 1, 600, 0.02)
    df = spark.createDataFrame(list(enumerate(vectors)), KIND)
    links = angles.cosine_links(df, 0.8, chunk_rows=50, pivots=8)
    assert links.pairs.count() == 0 and links.full.count() <= 12 * 13 // 2 and links.report.first().computed == 0
    assert spelled(links) == by_hand(vectors, 0.8)


def test_odd_vectors(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [3.0, 0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, KIND)
    for pivots in (None, 1, 5):
        assert {(r.a, r.b) for r in angles.cosine_pairs(df, 0.99, 1, pivots).collect()} == {(3, 4), (5, 6)}
    links = angles.cosine_links(df.where("id < 3"), 0.5)
    assert links.pairs.count() == links.full.count() == links.members.count() == 0 and links.report.first().pairs == 0
    named = df.selectExpr("concat('n', id) AS id", "embedding", "id AS chunk", "'x' AS a")
    assert {(r.a, r.b) for r in angles.cosine_pairs(named, 1.0).collect()} == {("n3", "n4"), ("n5", "n6")}


def test_greedy_clusters_with_full_chunks(spark):
    r = random.Random(1)
    tight, loose = clustered(3, 3, 30, 0.05, 5), clustered(4, 3, 20, 0.5, 5)
    vectors = tight + loose
    rows = [(i, T(2024, 1, 1, r.randrange(20)), v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, embedding array<float>")
    links = angles.cosine_links(df, 0.75, 6, 12)
    assert links.full.count() > 5 and links.pairs.count() > 5
    got = {(x.id, x.cluster, x.pos) for x in cluster.greedy_clusters(df, 0.75, 2, group_nodes=12, chunk_rows=6, pivots=12).collect()}
    assert got == greedy_by_hand(rows, 0.75, 2) and len({x[1] for x in got}) > 3


def test_queries_compare_cosines_as_doubles(spark, tmp_path):
    vectors = [[1.0, 0.0], [980.0, 4801.0], [0.0, 2.0]]  # the first two: 0.19999999583, as a float 0.2
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(r.id, r.links) for r in queries.cosine_link_counts(spark, str(tmp_path)).collect()} == {("1", 1), ("2", 1)}
    rows = df.withColumnRenamed("vec_id", "id")
    assert {(r.a, r.b) for r in angles.cosine_pairs(rows, 0.2).collect()} == {(0, 1), (1, 2)}
    assert {(r.a, r.b) for r in angles.cosine_pairs(rows, 0.2, kind="double").collect()} == {(1, 2)}


@pytest.mark.parametrize("chunks", [1, 3])
def test_tiles_of_chunks(spark, monkeypatch, chunks):
    monkeypatch.setattr(angles, "TILE_CHUNKS", chunks)
    r = random.Random(6)
    vectors = [[r.gauss(0, 1) for _ in range(4 + i % 2)] for i in range(160)]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>")
    got = {(x.a, x.b) for x in angles.cosine_pairs(df, 0.6, 8, 6, kind="double").collect()}
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for v in vectors]
    assert got == {(i, j) for i in range(160) for j in range(i + 1, 160) if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.6} != set()
