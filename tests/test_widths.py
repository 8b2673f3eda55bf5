"""Widths by the facet model against the definition, and on a bar of known width."""

import math

import numpy as np
import pytest

from weftline.operators import images, widths

from tests.test_operators import plane


def lines(spark, points):
    return spark.createDataFrame([(1, 1, k + 1, *p) for k, p in enumerate(points)], "frame int, contour int, point int, x double, y double, angle double")


def passed(ny, nx, most):
    """Pixels along a ray from the middle of pixel (0, 0), by small steps."""
    out = []
    for t in np.arange(0, most, 1e-4):
        at = (math.floor(t * ny + 0.5), math.floor(t * nx + 0.5))
        if at not in out:
            out.append(at)
    return out


@pytest.mark.parametrize("angle", [0.0, 0.3, 1.1, math.pi / 2, -0.7, -1.5, 2.5])
def test_a_ray_passes_the_pixels_on_its_way(spark, angle):
    rows = widths.ray_pixels(lines(spark, [(10.2, 20.4, angle)]), 4.5).collect()
    for side in (-1, 1):
        mine = [(r._y - 20, r._x - 10) for r in sorted((r for r in rows if r._side == side), key=lambda r: r._t)]
        want = passed(side * math.cos(angle), side * math.sin(angle), 4.5)
        assert len(set(mine)) == len(mine) and set(want) <= set(mine) and [m for m in mine if m in want] == want
        assert all(min(math.hypot(y - t * side * math.cos(angle), x - t * side * math.sin(angle)) for t in np.arange(0, 4.6, 0.01)) < 0.75 for y, x in mine)


def test_facets_by_tiles_are_those_of_the_windows(spark):
    p = plane(spark, np.random.default_rng(4).integers(0, 30, (17, 23)).astype("float64"))
    key = lambda r: (r.y, r.x)
    a = sorted(widths.facet_planes(p, tile=8).collect(), key=key)
    b = sorted(images.facet(p).collect(), key=key)
    assert np.allclose([(r.d, r.r, r.c, r.rr / 2, r.rc, r.cc / 2) for r in a], [(r.d, r.dr, r.dc, r.drr, r.drc, r.dcc) for r in b])


def test_a_bar_has_its_width_on_both_sides(spark):
    y, x = np.mgrid[:40, :40]
    p = plane(spark, 100.0 * (np.abs(y - 20) <= 3))  # edges at 16.5 and 23.5
    g = images.ridge_points(images.gauss_derivatives(p)).selectExpr("frame", "y", "x", "gradient as v")
    got = widths.line_widths(lines(spark, [(20.0, 20.0, 0.0), (15.0, 20.0, math.pi), (20.0, 20.0, math.pi / 2), (20.0, 5.0, 0.0), (20.0, 20.0, None), (300.0, 300.0, 0.0)]), g, 6.0).orderBy("point").collect()
    assert got[0].width_l == pytest.approx(3.5, abs=0.1) and got[0].width_r == pytest.approx(3.5, abs=0.1) and got[0].grad_l == pytest.approx(got[0].grad_r, rel=1e-6)
    assert got[1].width_l == pytest.approx(3.5, abs=0.1)
    assert len(got) == 6 and all(r.width_l is None and r.width_r is None for r in got[2:])


def test_the_first_edge_counts(spark):
    y, x = np.mgrid[:40, :60]
    g = plane(spark, 10 * np.exp(-0.5 * (x - 23.2) ** 2) + 50 * np.exp(-0.5 * (x - 27.0) ** 2))
    got = widths.line_widths(lines(spark, [(20.0, 20.0, math.pi / 2)]), g, 9.0).first()
    assert got.width_r == pytest.approx(3.2, abs=0.2) and got.width_l is None and got.grad_r < 20
    assert widths.line_widths(lines(spark, [(20.0, 20.0, 0.1)]).limit(0), g, 9.0).count() == 0


def test_nearest_points_at_any_distance(spark):
    from weftline.operators import spatial
    from weftline.operators.storage import saver

    rng = np.random.default_rng(6)
    left = [(k % 2, i, float(a), float(b)) for i, (k, (a, b)) in enumerate(zip(range(200), np.r_[rng.normal(0, 3, (100, 2)), rng.normal(0, 500, (90, 2)), rng.uniform(-1e6, 1e6, (10, 2))]))]
    right = [(k % 2, i, float(a), float(b)) for i, (k, (a, b)) in enumerate(zip(range(300), np.r_[rng.normal(0, 3, (200, 2)), rng.normal(300, 50, (98, 2)), [[5e5, 5e5], [5e5, 5e5]]]))]
    left += [(0, 500, right[0][2], right[0][3]), (2, 501, 0.0, 0.0), (0, 502, None, 1.0)]
    right += [(0, 900, right[0][2], right[0][3])]
    a, b = spark.createDataFrame(left, "k int, i int, x double, y double"), spark.createDataFrame(right, "k int, j int, x double, y double")
    got = {r.l.i: (r.r.j, r.d) for r in spatial.nearest_any(a, b, ["k", "i"], ["j"], saver(spark), ["k"]).collect()}
    want = {}
    for k, i, x, y in left:
        near = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for m, j, u, v in right if m == k) if x is not None else []
        if near:
            want[i] = (near[0][1], near[0][0])
    assert got == want


def test_fits_of_groups(spark):
    from pyspark.sql import functions as F

    from weftline.operators import group_fits
    from weftline.operators.storage import saver

    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in range(3):
        x, y = rng.uniform(-5, 5, (2, 400))
        w = rng.uniform(0, 2, 400)
        v = 3 + 20 * np.exp(-0.5 * ((x - g / 2) ** 2 + (y + 1) ** 2) / (1.5 + g) ** 2) + rng.normal(0, 0.01, 400)
        rows += [(g, *map(float, r)) for r in zip(x, y, v, w)]
        m = np.stack([x, y, np.ones(400)], 1)
        want[g] = np.linalg.solve(m.T @ (w[:, None] * m), m.T @ (w * v))
    df = spark.createDataFrame(rows + [(0, None, 1.0, 1.0, 1.0), (0, 1.0, 1.0, 1e9, -1.0), (0, 1.0, 1.0, 1e9, None)], "g int, x double, y double, v double, w double").repartition(5)
    for r in group_fits.linear_fit(df, ["g"], F.col("v"), [F.col("x"), F.col("y"), F.lit(1.0)], F.col("w")).collect():
        assert np.allclose(r.a, want[r.g]) and r.n == 400
    one = group_fits.linear_fit(df.where("x is not null and w >= 0"), ["g"], F.col("v"), [F.lit(1.0), F.lit(2.0)]).where("g = 1").first()
    assert one.a[0] == pytest.approx(2 * one.a[1])  # both terms take the same share

    e = lambda a: F.exp(-0.5 * (F.pow(F.col("x") - a[2], 2) + F.pow(F.col("y") - a[3], 2)) / (a[4] * a[4]))
    model = lambda a: a[0] + a[1] * e(a)
    slopes = lambda a: [F.lit(1.0), e(a), a[1] * e(a) * (F.col("x") - a[2]) / (a[4] * a[4]), a[1] * e(a) * (F.col("y") - a[3]) / (a[4] * a[4]), a[1] * e(a) * (F.pow(F.col("x") - a[2], 2) + F.pow(F.col("y") - a[3], 2)) / F.pow(a[4], 3)]
    start = spark.createDataFrame([(g, [1.0, 10.0, 0.3, -0.5, 2.0]) for g in range(4)], "g int, a array<double>")
    fits = {r.g: r for r in group_fits.nonlinear_fit(df.where("x is not null and w >= 0"), ["g"], F.col("v"), model, slopes, start, saver(spark), steps=30).collect()}
    for g in range(3):
        assert np.allclose(np.abs(fits[g].a), [3, 20, g / 2, 1, 1.5 + g], atol=0.05) and fits[g].n == 400
    assert fits[3].a is None
