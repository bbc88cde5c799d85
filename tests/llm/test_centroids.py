import hashlib
import math

import numpy as np
import pytest

from textlabels.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>"


def slow(rows, dim=64, k=40, rounds=5):
    """k-means in plain Python over (id, vector)."""
    kept = [(i, [math.floor(256 * x) for x in np.array(v, np.float32).astype(float).tolist()]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    points = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(points)):
            mine = [v for (_, v), o in zip(kept, of) if o == c]
            if mine:
                points[c] = [sum(x) // len(mine) for x in zip(*mine)]
    ends = [(i, *near(v)) for i, v in kept]
    each = {c: sum(d for _, d, o in ends if o == c) for _, _, c in ends}
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted((-1 if i is None else i, c, d, each[c], sum(each.values()), sha[c]) for i, d, c in ends)


def fast(df, **k):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in C.cluster(df, "vec_id", "embedding", **k).collect())


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 64))
    rows = [(i, (centres[i % 6] + spread * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(300)]
    assert fast(spark.createDataFrame(rows, SCHEMA).repartition(5)) == slow(rows)


def test_awkward_rows(spark):
    v = [0.5] * 64
    rows = [(1, v), (1, v), (None, v), (2, None), (3, []), (4, [0.5] * 63), (5, [None] + [0.5] * 63), (6, [math.nan] + v[1:]),
            (7, [math.inf] + v[1:]), (8, [-0.001] + v[1:]), (9, [0.0] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as id", "1 as v", "2 as cluster", "3 as distance")
    assert fast(df) == slow(rows) and len(slow(rows)) == 5
    assert C.cluster(df.where("false"), "vec_id", "embedding").collect() == []
    assert C.cluster(df.where("vec_id = 2"), "vec_id", "embedding").count() == 0
    with pytest.raises(Exception, match="do not fit a long"):
        C.cluster(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA), "vec_id", "embedding").collect()


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(12)]          # 12 centroids on 3 places
    got = fast(spark.createDataFrame(rows, SCHEMA), k=12)
    assert got == slow(rows, k=12) and len({r[1] for r in got}) == 3


@pytest.mark.parametrize("largest", [3, 1 << 26])
def test_the_tree_finds_the_nearest(largest):
    rng = np.random.default_rng(largest)
    points = rng.integers(-largest, largest + 1, (60, 5))
    points[40:] = points[:20]
    vectors = rng.integers(-largest, largest + 1, (500, 5))
    number, distance = C.nearest(vectors, points, C.build_tree(points))
    every = C.squared(vectors, points)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_the_walk_leaves_out_most_of_the_tree(monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.integers(-1000, 1000, (200, 2))
    met, plain = [], C.squared
    tree = C.build_tree(points)
    monkeypatch.setattr(C, "squared", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    C.nearest(rng.integers(-1000, 1000, (100, 2)), points, tree)
    assert sum(met) < 0.3 * 100 * 200
