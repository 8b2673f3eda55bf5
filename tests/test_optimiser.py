"""The simplex search on known surfaces, its restart, and thresholds on an image of one line in noise."""

import numpy as np
import pytest

from weftline.operators import images, optimiser
from weftline.operators.storage import saver

from tests.test_operators import plane


def bowl(calls):
    def value(points):
        calls.append(len(points))
        return [(x - 3) ** 2 + 2 * (y + 1) ** 2 + (x - 3) * (y + 1) for x, y in points]
    return value


def test_reaches_the_minimum_of_a_known_surface(spark):
    calls = []
    point, value = optimiser.simplex_search(spark, bowl(calls), (0.0, 0.0), (1.0, -1.0), generations=60)
    assert point == pytest.approx((3, -1), abs=1e-3) and value < 1e-6
    assert calls[0] == 3 and set(calls[1:]) == {6}  # one list a generation


def test_a_restart_goes_on(spark, tmp_path):
    path, first, second, whole = str(tmp_path / "state"), [], [], []
    optimiser.simplex_search(spark, bowl(first), (0.0, 0.0), (1.0, -1.0), path, generations=4)
    got = optimiser.simplex_search(spark, bowl(second), (9.0, 9.0), (1.0, 1.0), path, generations=7)
    assert got == optimiser.simplex_search(spark, bowl(whole), (0.0, 0.0), (1.0, -1.0), generations=7)
    assert len(first) == 5 and len(second) == 3


def test_thresholds_that_keep_the_line_win(spark):
    y, x = np.mgrid[:40, :60]
    a = np.rint(40 * np.exp(-0.5 * ((y - 20.0) / 1.8) ** 2) + np.random.default_rng(2).normal(0, 2, y.shape))
    p = plane(spark, a)
    save = saver(spark)
    ridges = save(images.ridge_points(images.gauss_derivatives(p)), "ridges")
    errors = optimiser.threshold_errors(ridges, save(p, "flat"), save)
    most = images.saliency(ridges).agg({"v": "max"}).first()[0]
    line, swapped, nothing = errors([(0.4 * most, 0.6 * most), (0.6 * most, 0.4 * most), (2 * most, 3 * most)])
    assert line == pytest.approx(swapped) and line < nothing
