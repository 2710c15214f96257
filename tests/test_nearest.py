"""Exact nearest neighbours against all pairs."""

import math
import random

import numpy as np
import pytest

from mendwright.operators import nearest


def brute(queries, rows, threshold):
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    whole = [(i, w) for i, w in rows if i is not None and w and not any(x is None or math.isnan(x) for x in w) and any(w)]
    out = []
    for k, v in queries:
        if (k, v) in whole:
            s, t = min(((-round(cos(v, w), 9), i) for i, w in whole if i != k), default=(2, None))
            if -s >= threshold:
                out.append((k, t, round(-s, 5)))
    return sorted(out)


def sample(seed, n=260, dim=5):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    rows = [(k, [x + r.gauss(0, 0.25) for x in r.choice(centres)]) for k in range(n)]
    rows += [(k, list(rows[3][1])) for k in range(n, n + 60)]  # copies of one vector
    rows += [(n + 61, None), (n + 62, [0.0] * dim), (n + 63, [float("nan")] + [1.0] * (dim - 1)), (n + 64, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim), (9, list(rows[9][1])), (n + 70, [-x for x in rows[3][1]])]
    return rows


@pytest.mark.parametrize("cell_rows,slice_rows", [(2000, 4000), (20, 4000), (20, 7), (400, 30)])
@pytest.mark.parametrize("threshold", [0.2, 0.95])
def test_nearest(spark, cell_rows, slice_rows, threshold):
    rows = sample(4)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, v string, ROW int")
    queries = df.where("vec_id % 3 = 0 or vec_id is null")
    got = nearest.nearest(queries, df, threshold, cell_rows=cell_rows, slice_rows=slice_rows)
    assert sorted(map(tuple, got.collect())) == brute([(k, v) for k, v in rows if k is None or k % 3 == 0], rows, threshold)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame(sample(5, 20), "vec_id long, embedding array<double>")
    assert nearest.nearest(df.limit(0), df).collect() == [] and nearest.nearest(df, df.limit(0)).collect() == []
    odd = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0]), ("d", [])], "vec_id string, embedding array<float>")
    assert sorted(map(tuple, nearest.nearest(odd, odd).where("vec_id < 'c'").collect())) == [("a", "b", 1.0), ("b", "a", 1.0)]


def test_cells_are_left_out():
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    points = np.repeat(centres, 50, 0) + r.normal(scale=0.1, size=(2000, 16))
    unit, pivots = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (points, centres))
    angles = nearest._angles(unit, pivots)
    cell = angles.argmin(1)
    low, high = (np.array([f(angles[cell == c, c]) for c in range(40)]) for f in (np.min, np.max))
    likeness = unit @ unit.T
    np.fill_diagonal(likeness, -2)
    best = likeness.max(1)
    may = nearest.may_hold(angles, low, high, best)
    assert may[np.arange(2000), cell[likeness.argmax(1)]].all() and may.mean() < 0.15
