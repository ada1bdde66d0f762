import hashlib
import math
import random

import numpy as np
import pytest

from opsframe.llm import centroids as ce

ROWS = "vec_id long, embedding array<float>, V string, apex int"


def brute(rows, k, rounds, dimensions):
    """The rule in Python's whole numbers, all distances measured."""
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v, *_ in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    for step in range(rounds + 1):
        near = []
        for _, v in kept:
            near.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)))
        if step < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, at) in zip(kept, near) if at == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own)]
    whole = [sum(d for d, at in near if at == j) for j in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, whole[j], sum(whole), names[j]) for (i, _), (d, j) in zip(kept, near)]


def same(spark, rows, **how):
    frame = spark.createDataFrame(rows, ROWS).repartition(3)
    got = sorted(map(tuple, ce.cluster(frame, **how).collect()), key=str)
    want = brute([(r[0], r[1]) for r in map(tuple, frame.collect())], how["k"], how["rounds"], how["dimensions"])
    assert got == sorted(want, key=str)
    return got


def test_equal_to_brute_force(spark):
    rng = random.Random(3)
    middle = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(middle)], "x", 1) for i in range(300)]
    assert len(same(spark, rows, k=9, rounds=4, dimensions=8)) == 300


def test_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)], None, 2) for i in range(60)]
    rows += rows[:5] * 3  # repeated rows
    rows += [(5, [0.25, 0.25, 0.25, 0.25], "other vector of one id", 2), (None, [0.1] * 4, "", 0), (None, [0.1] * 4, "", 0)]
    bad = [[1.0] * 3, [1.0] * 5, [], None, [1.0, None, 0.0, 0.0], [math.nan, 0.0, 0.0, 0.0], [0.0, 0.0, math.inf, 0.0]]
    rows += [(1000 + i, v, "unusable", 0) for i, v in enumerate(bad)]
    assert len(same(spark, rows, k=7, rounds=3, dimensions=4)) == 78
    same(spark, [(i, [0.5, 0.5, 0.5, 0.5], "", 0) for i in range(9)], k=4, rounds=2, dimensions=4)  # one vector only
    same(spark, [(1, [0.5, 0.5], "", 0), (2, [-0.5, 0.1], "", 0)], k=4, rounds=2, dimensions=2)  # fewer vectors than centroids
    empty = ce.cluster(spark.createDataFrame(rows[-7:], ROWS), dimensions=9)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(40, 64)) * 40
    vectors = np.floor(middle[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 64)) * 8).astype(np.int64)
    simplex = ce.Simplex.over(vectors[:40])
    assert len(simplex.pivots) == ce.PIVOTS
    apexes = simplex.apexes(np.sqrt(ce.squared(vectors, simplex.pivots).astype(float)))
    few = vectors[100:140]
    tops = simplex.apexes(np.sqrt(ce.squared(few, simplex.pivots).astype(float)))
    exact = ce.squared(vectors, few)
    low, high = ce.bounds(apexes, tops)
    true = np.sqrt(exact.astype(float))
    assert (low <= true + 1e-6 * high.max()).all() and (true <= high + 1e-6 * high.max()).all()
    cluster, distance, compared = ce.nearest(vectors, apexes, few, simplex)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert compared < exact.size / 2  # most centroids are ruled out unmeasured


def test_large_components(spark):
    big = [(i, [x, -x], "", 0) for i, x in enumerate([5e5, -5e5, 123456.75, 0.0])]
    same(spark, big, k=2, rounds=2, dimensions=2)
    with pytest.raises(Exception, match="exceeds"):
        ce.cluster(spark.createDataFrame([*big, (9, [1e30, 0.0], "", 0)], ROWS), k=2, dimensions=2).collect()
