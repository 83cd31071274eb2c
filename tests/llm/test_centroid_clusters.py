"""Centroid clustering against exact integer brute force, and the bounds it filters by."""

import hashlib
import math
import random

import numpy as np
import pytest

from cartwheel.llm.centroid_clusters import Simplex, bounds, cluster, nearest

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dimensions):
    """[(vec_id, cluster, distance)] and the centroids, in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = [n for _, n in assign()]
        for n in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, at, strict=True) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, assign(), strict=True)], centroids


def _check(make, rows, dimensions=6, k=5):
    df = make([(i, v, None) for i, v in rows], VECTORS).repartition(4)
    got, centroids = cluster(df, clusters=k, dimensions=dimensions)
    stored = [(r["vec_id"], r["embedding"]) for r in df.collect()]  # as floats of 32 bits
    want, wanted = brute(stored, k, 5, dimensions)
    assert centroids == wanted
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


def _points(rnd, n, dimensions=6):
    middle = [[rnd.uniform(-3, 3) for _ in range(dimensions)] for _ in range(4)]
    return [[m + rnd.gauss(0, 0.3) for m in rnd.choice(middle)] for _ in range(n)]


def test_against_brute_force(make):
    rnd = random.Random(1)
    _check(make, list(enumerate(_points(rnd, 300))))


def test_odd_rows(make):
    rnd = random.Random(2)
    rows = list(enumerate(_points(rnd, 40)))
    rows += [(50, None), (51, []), (52, [1.0] * 5), (53, [1.0] * 7), (54, [None] * 6), (55, [math.nan] + [0.0] * 5),
             (56, [math.inf] + [0.0] * 5), (None, [0.5] * 6), (None, [0.25] * 6), (3, rows[3][1]), (4, [-0.0] * 6)]
    want = _check(make, rows)
    assert not {50, 51, 52, 53, 54, 55, 56} & {i for i, _, _ in want} and len(want) == 44


def test_ties_and_copies_go_to_the_smaller_centroid(make):
    rows = [(i, [float(i % 2)] * 6) for i in range(400)]  # two vectors only, so most centroids are equal
    want = _check(make, rows, k=8)
    assert len({n for _, n, _ in want}) == 2


def test_fewer_rows_than_centroids_and_none(make):
    _check(make, list(enumerate(_points(random.Random(3), 3))), k=40)
    got, centroids = cluster(make([], VECTORS), dimensions=6)
    assert got.count() == 0 and centroids == [] and got.columns == ["vec_id", "cluster", "distance"]


def test_too_large_a_component_fails(make):
    with pytest.raises(Exception, match="beyond"):
        cluster(make([(1, [1e30] * 6, None)], VECTORS), dimensions=6)[0].count()


def test_extra_columns_are_ignored(make):
    rows = _points(random.Random(4), 30)
    df = make([(i, v, "x", [1], 2) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, v string, apex array<int>, cluster int")
    assert cluster(df, dimensions=6, clusters=3)[0].count() == 30


@pytest.mark.parametrize("spread", [1, 1000, 200_000])
def test_bounds_hold_and_filter(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (40, 16))
    points = np.vstack([centres[rng.integers(0, 40, 500)] + rng.integers(-spread // 8 - 1, spread // 8 + 2, (500, 16)), centres[:8]])
    simplex = Simplex.over(centres)
    low, high = bounds(simplex.project(points), simplex.project(centres))
    true = ((points[:, None, :] - centres[None]) ** 2).sum(2)
    assert (low <= true).all() and (true <= high).all()
    at, d = nearest(points, simplex.project(points), centres, simplex)
    assert (d == true.min(1)).all() and (at == true.argmin(1)).all()
    assert (low <= high.min(1, keepdims=True)).mean() < 0.8  # some centroids are never compared


def test_flat_pivots_are_left_out():
    line = np.array([[i, 2 * i, 0] for i in range(10)])
    assert len(Simplex.over(line).pivots) == 2
    assert len(Simplex.over(np.zeros((5, 3), np.int64)).pivots) == 1
