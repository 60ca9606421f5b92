"""Centroid clustering against plain Python, and the tree against all distances."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterline.llm import centroids as c


def brute_nearest(vectors, centers):
    return [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(centers)) for v in vectors]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 20), st.integers(1, 4), st.integers(1, 6), st.integers(0, 1 << 30))
def test_tree_search_is_brute_force(k, width, spread, seed):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-spread, spread + 1, (k, width))  # many ties and equal centroids
    vectors = rng.integers(-2 * spread, 2 * spread + 1, (40, width))
    number, best, _ = c.nearest(vectors, centers, c.build_tree(centers))
    assert list(zip(best.tolist(), number.tolist())) == brute_nearest(vectors, centers)


def test_large_components_stay_exact_and_larger_ones_are_refused():
    import pyarrow as pa

    big = c.LARGEST
    centers = np.array([[big] * 64, [-big] * 64, [big - 1] + [big] * 63])
    vectors = np.array([[-big] * 64, [big] * 64])
    number, best, _ = c.nearest(vectors, centers, c.build_tree(centers, 1))
    assert number.tolist() == [1, 0] and best.tolist() == [0, 0]
    assert c.squared(centers[:1], centers[1:2])[0] == 64 * (2 * big) ** 2
    with pytest.raises(ValueError):
        c.scaled(pa.array([[float(big)]]), 1, 64)


def test_most_distances_are_pruned_among_spread_centroids():
    rng = np.random.default_rng(3)
    centers = rng.integers(-10_000, 10_000, (256, 2))
    vectors = centers[rng.integers(0, 256, 2000)] + rng.integers(-50, 50, (2000, 2))
    number, best, work = c.nearest(vectors, centers, c.build_tree(centers))
    assert list(zip(best.tolist(), number.tolist())) == brute_nearest(vectors, centers)
    assert work < 2000 * 256 / 4


def brute(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    for _ in range(rounds):
        near = brute_nearest([v for _, v in kept], centers)
        for m in range(len(centers)):
            mine = [v for (_, v), (_, x) in zip(kept, near) if x == m]
            if mine:
                centers[m] = [sum(x) // len(mine) for x in zip(*mine)]
    near = brute_nearest([v for _, v in kept], centers)
    out = []
    for (i, _), (d, m) in zip(kept, near):
        digest = hashlib.sha256(",".join(map(str, centers[m])).encode()).hexdigest()
        out.append((i, m, d, sum(x for x, y in near if y == m), sum(x for x, _ in near), digest))
    return sorted(out, key=str)


def test_clusters_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 64)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # a group of copies
    rows += [(7, rows[7][1]), (None, rows[8][1]), (300, [0.0] * 64), (301, [-0.0] * 64)]
    rows += [(400, None), (401, [0.1] * 63), (402, [0.1] * 65), (403, [None] + [0.1] * 63), (404, [float("nan")] + [0.1] * 63), (405, [float("-inf")] + [0.1] * 63), (406, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, cluster string, ID int").repartition(5)
    got = sorted((tuple(r) for r in c.with_inertia(c.cluster(df)).collect()), key=str)
    assert got == brute(rows, 16, 3)


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id bigint, embedding array<double>")
    assert sorted((r.vec_id, r.distance) for r in c.with_inertia(c.cluster(one)).collect()) == [(1, 0), (2, 0)]
    none = c.with_inertia(c.cluster(one.where("vec_id > 5")))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
