from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from voxspark.llm.shallot import Layout, scan_all, shallot, shallot_clusters, squared

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, members long, v string"


def brute_force(rows, clusters=16, rounds=3, components=64, scale=64):
    """The contract in plain loops of Python integers."""
    kept = []
    for number, vector in rows:
        if vector is not None and len(vector) == components and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((number, [math.floor(x * scale) for x in vector]))
    named = [(hashlib.sha256(f"1:{n}".encode()).hexdigest(), v) for n, v in kept if n is not None]
    centers = [v for _, v in sorted(named)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, members in groups.items():
            centers[k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    last = [(n, *nearest(v)) for n, v in kept]
    inertia = {}
    for _, d, k in last:
        inertia[k] = inertia.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((n, k, d, inertia[k], sum(inertia.values()), digest[k]) for n, d, k in last)


def vectors(seed, count, components=64, spread=0.4):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(components)] for _ in range(5)]
    return [[m + draw.gauss(0, spread) for m in draw.choice(middles)] for _ in range(count)]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(n, v, 1, 7, 9, "v") for n, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in shallot_clusters(frame, **options).collect())


def test_clusters_are_those_of_brute_force(spark):
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] * 64)]
    rows = [*enumerate(vectors(1, 300)), *odd, (906, [0.0] * 64), (907, [0.0] * 64), (908, [-0.0] * 64)]
    rows += [(1000 + n, rows[5][1]) for n in range(100)]  # a third of equal vectors
    assert found(spark, rows) == brute_force(rows)


def test_ties_repeated_ids_and_few_vectors(spark):
    corners = [(n, [float(n >> b & 1) for b in range(4)]) for n in range(16)] * 2
    for clusters in (1, 3, 7, 16):
        assert found(spark, corners, clusters=clusters, components=4, scale=2) == brute_force(corners, clusters, 3, 4, 2)
    few = [(4, [1.5] * 4), (9, [-2.5] * 4)]
    assert found(spark, few, components=4, rounds=0) == brute_force(few, 16, 0, 4)
    assert found(spark, [(1, None), (2, [1.0])]) == found(spark, []) == []


def test_rows_without_id_are_clustered_and_large_components_are_told(spark):
    rows = [(1, [0.0] * 4), (2, [4.0] * 4), (None, [3.0] * 4)]
    frame = spark.createDataFrame([(n, v, 1, 7, 9, "v") for n, v in rows], SCHEMA)
    got = {r.vec_id: r.cluster for r in shallot_clusters(frame, clusters=2, components=4).collect()}
    assert got[None] == got[2] != got[1]
    with pytest.raises(Exception, match="no squared distance"):
        found(spark, [(1, [1e30] * 4)], components=4)


def test_bounds_save_distances_and_never_change_the_nearest():
    draw = np.random.default_rng(3)
    points = draw.integers(-60, 60, (2000, 8)) + 200 * draw.integers(0, 4, (2000, 1))
    centers = points[:24].copy()
    layout = Layout.of(centers)
    bounds = scan_all(points, layout)
    for _ in range(6):
        moved = np.array([points[bounds.cluster == k].mean(axis=0) if (bounds.cluster == k).any() else c for k, c in enumerate(centers)]).astype(np.int64)
        layout, centers = Layout.of(moved, centers), moved
        bounds = shallot(points, bounds, layout)
        exact = np.stack([squared(points, c) for c in centers])
        assert (bounds.cluster == exact.argmin(axis=0)).all()
        rest = np.where(np.arange(24)[:, None] == bounds.cluster, np.iinfo(np.int64).max, exact).min(axis=0)
        assert (bounds.lower**2 <= rest * (1 + 1e-9)).all() and (bounds.upper**2 >= exact.min(axis=0) * (1 - 1e-9)).all()
