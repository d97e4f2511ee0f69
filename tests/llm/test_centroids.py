import hashlib
import math

import numpy as np
import pytest

from tidewright.llm import centroids, queries


def brute(rows, k, rounds, dims, scale=256):
    """{row number: (cluster, distance)} and the last centroids, by a plain loop over Python integers."""
    kept = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[1] is None else r[1]}".encode()).hexdigest(), r[2]))
    c = [x for _, _, x in first[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))

    def assign():
        return {n: min((square(x, m), j) for j, m in enumerate(c))[::-1] for n, _, x in kept}

    for _ in range(rounds):
        found = assign()
        for j in range(len(c)):
            own = [x for n, _, x in kept if found[n][0] == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return kept, assign(), c


def held(rows, k, rounds, dims):
    kept, found, c = brute(rows, k, rounds, dims)
    per = {}
    for j, d in found.values():
        per[j] = per.get(j, 0) + d
    total = sum(per.values())
    return sorted([(i, j, d, per[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for n, i, _ in kept for j, d in [found[n]]], key=repr)


def odd_vectors(rng, n, dims):
    rows = [(i, (rng.standard_normal(dims) * rng.choice([0.01, 1, 20])).round(3).tolist()) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(40)]  # one vector holds a large share
    rows += [(0, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] + [1.0] * (dims - 1)), (904, [float("nan")] * dims), (905, [float("-inf")] + [0.0] * (dims - 1)), (906, [0.0] * dims), (907, [-0.001] * dims)]
    return rows


@pytest.mark.parametrize("k,rounds,dims", [(7, 4, 6), (3, 0, 5), (200, 2, 4), (1, 2, 1)])
def test_against_a_plain_loop(spark, k, rounds, dims):
    rows = odd_vectors(np.random.default_rng(k), 60, dims)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = centroids.Clustering(table, k=k, rounds=rounds, dims=dims).report()
    assert sorted([tuple(r) for r in got.collect()], key=repr) == held(rows, k, rounds, dims)


def test_equal_distances_go_to_the_smaller_number():
    c = np.array([[2, 0], [0, 2], [0, 0], [2, 0], [1, 1]], np.int64)
    x = np.array([[1, 0], [0, 1], [2, 0], [3, 3], [1, 1]], np.int64)
    for order in ([0, 1], [1, 0]):
        cluster, distance, _ = centroids.nearest(x, c, np.array(order))
        want = [min((int(((v - m) ** 2).sum()), j) for j, m in enumerate(c)) for v in x]
        assert list(zip(distance.tolist(), cluster.tolist())) == want


def test_partial_distances_save_work_and_lose_nothing():
    rng = np.random.default_rng(2)
    middles = rng.integers(-3000, 3000, (40, 64))
    x = middles[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 64))
    order = np.argsort(-x.var(axis=0), kind="stable")
    cluster, distance, work = centroids.nearest(x, middles, order)
    whole = ((x[:, None] - middles[None]) ** 2).sum(axis=2)
    assert (cluster == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert work < 0.5 * whole.size * 64


def test_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.Clustering(none).report().count() == 0
    named = spark.createDataFrame([("b", [1.0, 2.0], 5, 0.5), ("a", [3.0, 4.0], 6, 0.5)], "id string, v array<float>, cluster int, distance double")
    got = centroids.Clustering(named, "id", "v", k=1, rounds=1, dims=2).report().collect()
    assert {(r.vec_id, r.cluster, r.distance) for r in got} == {("a", 0, 2 * 256**2), ("b", 0, 2 * 256**2)}
    large = spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.Clustering(large, dims=1)


def test_query_on_the_given_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op13_centroid_clusters(spark, sf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == held(rows, 40, 5, 64)
