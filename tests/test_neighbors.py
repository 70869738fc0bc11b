"""Exact neighbour search against brute force, with many small cells so the
pruning and blocking paths run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from threadlens.operators.components import connected_components
from threadlens.operators.density import density_clusters
from threadlens.operators.neighbors import NeighborIndex, core_distance, knn, radius_pairs, reachability_forest

SMALL = dict(block_size=16, cell_target=40, max_pivots=32)


def _brute(X):
    d = X[:, None, :] - X[None, :, :]
    D = np.sqrt((d * d).sum(-1))
    np.fill_diagonal(D, np.inf)
    return D


def _planted(spark, n_per=30, centers=4, noise=15, seed=3):
    rng = np.random.default_rng(seed)
    pts = [rng.normal(c * 5.0, 0.3, size=(n_per, 8)) for c in range(centers)]
    pts.append(rng.uniform(-10, 30, size=(noise, 8)))
    X = np.vstack(pts).astype(np.float32)
    rows = [(i, [float(v) for v in X[i]]) for i in range(len(X))]
    return X.astype(np.float64), spark.createDataFrame(rows, "id long, vec array<float>")


@pytest.mark.parametrize("source", ["planted", "embeddings"])
def test_knn_matches_brute_force(spark, source):
    if source == "planted":
        X, df = _planted(spark)
    else:
        df = spark.read.parquet(f"{SF_MID}/embeddings.parquet").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).filter("id < 200")
        rows = sorted(df.collect(), key=lambda r: r["id"])
        X = np.array([r["vec"] for r in rows], dtype=np.float32).astype(np.float64)
    k = 5
    got = {(r["id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in knn(df, k, **SMALL).collect()}
    D = _brute(X)
    for i in range(len(X)):
        order = sorted(range(len(X)), key=lambda j: (D[i, j], j))[:k]
        for rank, j in enumerate(order, 1):
            nid, dist = got[(i, rank)]
            assert abs(dist - D[i, j]) < 1e-9
            assert nid == j or abs(D[i, nid] - D[i, j]) < 1e-12
    assert len(got) == len(X) * k


def test_radius_pairs_match_brute_force(spark):
    X, df = _planted(spark)
    r = 1.2
    got = {(a, b) for a, b in radius_pairs(df, r, **SMALL).select("id", "neighbor_id").collect()}
    D = _brute(X)
    want = {(i, j) for i in range(len(X)) for j in range(len(X)) if D[i, j] <= r}
    assert got == want


def test_connected_components(spark):
    v = spark.createDataFrame([(i,) for i in range(10)], "id long")
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (8, 7)], "src long, dst long")
    got = dict(connected_components(v, e).collect())
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7}


def test_connected_components_long_chain(spark):
    n = 200
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    got = dict(connected_components(v, e).collect())
    assert set(got.values()) == {0}


def test_density_clusters_recover_planted(spark):
    X, df = _planted(spark)
    labels = dict(density_clusters(df, eps=1.5, min_samples=5, min_cluster_size=5, **SMALL).collect())
    for c in range(4):
        members = {labels[i] for i in range(c * 30, (c + 1) * 30)}
        assert len(members) == 1 and -1 not in members
    assert len({labels[c * 30] for c in range(4)}) == 4
    noise = [labels[i] for i in range(120, 135)]
    assert sum(1 for x in noise if x == -1) >= 12


def test_density_hierarchy_recovers_planted(spark):
    from threadlens.operators.density import density_hierarchy

    X, df = _planted(spark)
    labels = dict(density_hierarchy(df, min_samples=5, min_cluster_size=5, **SMALL).select("id", "cluster").collect())
    found = [{labels[i] for i in range(c * 30, (c + 1) * 30)} for c in range(4)]
    main = [max(s, key=lambda x: sum(1 for i in range(c * 30, (c + 1) * 30) if labels[i] == x))
            for c, s in enumerate(found)]
    assert -1 not in main and len(set(main)) == 4
    for c in range(4):
        assert sum(1 for i in range(c * 30, (c + 1) * 30) if labels[i] == main[c]) >= 25


def test_knn_many_tiny_cells(spark):
    X, df = _planted(spark)
    k = 3
    got = {(r["id"], r["rank"]): r["distance"]
           for r in knn(df, k, block_size=4, cell_target=3, max_pivots=64).collect()}
    D = _brute(X)
    for i in range(len(X)):
        want = sorted(D[i])[:k]
        assert [round(got[(i, r)], 9) for r in range(1, k + 1)] == [round(w, 9) for w in want]


def test_edge_cases(spark):
    X, df = _planted(spark)
    # a level below every core distance: everything is noise
    labels = dict(density_clusters(df, eps=1e-6, min_samples=5, min_cluster_size=5, **SMALL).collect())
    assert set(labels.values()) == {-1} and len(labels) == len(X)
    # fewer points than k: every other point, no more
    few = df.filter("id < 3")
    got = knn(few, 5, **SMALL).collect()
    assert sorted((r.id, r.neighbor_id) for r in got) == [(a, b) for a in range(3) for b in range(3) if a != b]
    # identical vectors: distance 0, ties by id
    dup = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, vec array<float>")
    rows = knn(dup, 2).filter("id = 0").orderBy("rank").collect()
    assert [(r.neighbor_id, r.distance) for r in rows] == [(1, 0.0), (2, 0.0)]


def test_components_of_a_long_path_take_few_rounds(spark):
    """10,000 vertices in a row with ids in random order: rounds grow with the logarithm."""
    ids = np.random.default_rng(1).permutation(10_000).tolist()
    e = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    rounds = []
    got = connected_components(spark.range(10_002), e, rounds=rounds)
    assert {r["component"]: r["count"] for r in got.groupBy("component").count().collect()} == {
        0: 10_000, 10_000: 1, 10_001: 1}
    assert rounds[0] <= 30


def test_components_of_struct_ids(spark):
    e = spark.createDataFrame([((1, 0), (3, 0)), ((3, 0), (2, 0)), ((1, 1), (2, 1))],
                              "src struct<id:long,l:int>, dst struct<id:long,l:int>")
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    got = {tuple(r["id"]): tuple(r["component"]) for r in connected_components(v, e).collect()}
    assert got == {(1, 0): (1, 0), (2, 0): (1, 0), (3, 0): (1, 0), (1, 1): (1, 1), (2, 1): (1, 1)}


def _links(df, eps, **kw):
    idx = NeighborIndex(df, 5, **kw)
    core = core_distance(idx, 5)
    return reachability_forest(idx, core, eps)


def test_an_outlier_makes_no_pairs(spark):
    """2,000 points in four blobs and one far away, searched up to the far
    point's distance: forests of the groups, not the 4 million pairs."""
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(c * 5.0, 0.3, size=(500, 4)) for c in range(4)] + [np.full((1, 4), 500.0)])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vec array<float>")
    links = _links(df, 2000.0).collect()
    assert len(links) <= 20 * len(X)
    comps = connected_components(df.select("id"), spark.createDataFrame(links), src="a", dst="b")
    assert comps.select("component").distinct().count() == 1


def test_forest_has_the_components_of_all_pairs(spark):
    X, df = _planted(spark)
    D = _brute(X)
    core = np.sort(D, axis=1)[:, 4]
    reach = np.maximum(D, np.maximum(core[:, None], core[None, :]))
    links = [(r["a"], r["b"], r["weight"]) for r in _links(df, 50.0, **SMALL).collect()]

    def parts(edges):
        label = list(range(len(X)))

        def root(i):
            while label[i] != i:
                i = label[i]
            return i

        for a, b in edges:
            label[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(len(X))]

    for eps in (0.8, 1.2, 3.0, 8.0, 50.0):
        want = parts((i, j) for i in range(len(X)) for j in range(i) if reach[i, j] <= eps)
        assert parts((a, b) for a, b, w in links if w <= eps) == want


def test_repeated_vectors_cost_no_more(spark):
    """2,000 equal vectors: at most k candidates for each query and block."""
    from threadlens.operators import neighbors as N

    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(2000)], "id long, vec array<float>")
    idx = N.NeighborIndex(df, 5)
    tagged, cells = idx._plan(None, None)
    cand = tagged.groupBy("cell", "block", "chunk").applyInPandas(N._group_pairs(5, None, cells.tol), N.PAIR_SCHEMA)
    assert cand.count() <= 2000 * 5 * int(cells.blocks.max())
    rows = knn(df, 5).filter("id in (0, 1999)").orderBy("id", "rank").collect()
    assert [r["neighbor_id"] for r in rows] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_wide_vectors(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 3072)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vec array<float>")
    D = _brute(X.astype(np.float64))
    got = {(r["id"], r["rank"]): r["neighbor_id"] for r in knn(df, 2, block_size=16, cell_target=10).collect()}
    for i in range(60):
        assert [got[i, 1], got[i, 2]] == sorted(range(60), key=lambda j: D[i, j])[:2]
