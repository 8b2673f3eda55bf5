"""The grid of thresholds against a flood fill for each pair."""

import numpy as np
import pytest

from weftline.operators.storage import saver
from weftline.operators.threshold_grid import threshold_grid

from tests.test_operators import plane


def regions(a, low, high):
    left, n = set(zip(*np.nonzero(a >= low))), 0
    while left:
        todo, most = [left.pop()], -np.inf
        while todo:
            y, x = todo.pop()
            most = max(most, a[y, x])
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        n += most >= high
    return n


def test_grid_equals_single_runs(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 12, (15, 150)).astype("float64"), np.zeros((6, 9))
    b[1, 1], b[2, 2], b[4, 7] = 9, 3, 5
    lows, highs = [3, 7, 9, 30], [3, 9, 11]
    p = plane(spark, a).union(plane(spark, b, 2))
    got = {(r.frame, r.low, r.high): r.n for r in threshold_grid(p, lows, highs, saver(spark)).collect()}
    assert got == {(f, float(x), float(y)): regions(z, x, y) for f, z in ((1, a), (2, b)) for x in lows for y in highs if x <= y}


def test_nothing_in_an_empty_table(spark):
    assert threshold_grid(plane(spark, np.zeros((3, 3))).limit(0), [1.0], [2.0], saver(spark)).count() == 0
    assert [r.n for r in threshold_grid(plane(spark, np.zeros((3, 3))), [1.0], [2.0], saver(spark)).collect()] == [0]
