"""Thresholds, order statistics, reconstruction, nearest points at any distance, fits of groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import images, order_statistics, reconstruction, thresholds
from weftline.operators.storage import saver

from tests.test_operators import plane


def counts(values, bins=256):
    least, most = values.min(), values.max()
    width = (most - least) / bins
    at = np.minimum(bins - 1, np.floor((values - least) / width)).astype(int) if width else np.zeros(len(values), int)
    return np.bincount(at, minlength=bins), least, width


def one(df):
    return df.first().threshold


@pytest.fixture(scope="module")
def two_humps(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(20, 4, 1500), rng.normal(60, 9, 700), np.full(200, 20.0)])
    return v, plane(spark, v.reshape(48, 50))


def test_huang_is_the_least_fuzzy_bin(two_humps):
    v, p = two_humps
    h, least, width = counts(v)
    there = np.flatnonzero(h)
    fuzzy = {}
    for t in there[:-1]:
        b = np.arange(256)
        m = np.where(b <= t, (h * b)[:t + 1].sum() / h[:t + 1].sum(), (h * b)[t + 1:].sum() / h[t + 1:].sum())
        u = 1 / (1 + np.abs(b - m) / (there[-1] - there[0]))
        u = np.clip(u, 1e-12, 1 - 1e-12)
        fuzzy[t] = (h * -(u * np.log(u) + (1 - u) * np.log(1 - u)))[(u > 1e-6) & (u < 1 - 1e-6)].sum()
    assert one(thresholds.huang_threshold(p)) == pytest.approx(least + width * (min(fuzzy, key=fuzzy.get) + 1))


def test_intermeans_lies_in_the_middle(two_humps):
    v, p = two_humps
    h, least, width = counts(v)
    second = np.sort(h)[-2]
    if h.max() > 2 * second:
        h[h.argmax()] = int(second * 1.5)
    b = np.arange(256)
    for t in range(255):
        if h[:t + 1].sum() and h[t + 1:].sum() and t + 1 > (middle := ((h * b)[:t + 1].sum() / h[:t + 1].sum() + (h * b)[t + 1:].sum() / h[t + 1:].sum()) / 2):
            break
    assert one(thresholds.intermeans_threshold(p)) == pytest.approx(least + width * (math.floor(middle + 0.5) + 1))


def test_minimum_error_is_a_fixed_point(two_humps):
    v, p = two_humps
    h, least, width = counts(v)
    b = np.arange(256)
    t = math.floor((h * b).sum() / h.sum())
    for _ in range(thresholds.STEPS):
        n0, n1 = h[:t + 1].sum(), h[t + 1:].sum()
        m0, m1 = (h * b)[:t + 1].sum() / n0, (h * b)[t + 1:].sum() / n1
        v0, v1 = (h * b * b)[:t + 1].sum() / n0 - m0**2, (h * b * b)[t + 1:].sum() / n1 - m1**2
        p0, p1 = n0 / h.sum(), n1 / h.sum()
        w0, w1, w2 = 1 / v0 - 1 / v1, m0 / v0 - m1 / v1, m0**2 / v0 - m1**2 / v1 + math.log(v0 * p1**2 / (v1 * p0**2))
        if w1 * w1 - w0 * w2 < 0:
            break
        new = math.floor((w1 + math.sqrt(w1 * w1 - w0 * w2)) / w0)
        t = new if 0 <= new < 256 else t
    assert one(thresholds.minimum_error_threshold(p)) == pytest.approx(least + width * (t + 1))
    assert 25 < least + width * (t + 1) < 50


@pytest.mark.parametrize("method", [thresholds.huang_threshold, thresholds.intermeans_threshold, thresholds.minimum_error_threshold])
def test_a_flat_image_has_its_own_value_as_threshold(spark, method):
    assert one(method(plane(spark, np.full((20, 20), 7.0)))) == 7.0
    assert method(plane(spark, np.full((20, 20), 7.0)).limit(0)).count() == 0


@pytest.mark.parametrize("values", [np.arange(1000.0), np.full(500, 3.0), np.r_[np.zeros(900), np.arange(100)], np.exp(np.random.default_rng(3).normal(0, 40, 2000)), np.r_[-1.7e308, 1.7e308, np.linspace(-1, 1, 500)], np.r_[np.nextafter(1, 2), np.ones(300)]])
def test_values_at_places_without_a_sort(spark, values):
    n = len(values)
    df = spark.createDataFrame([(k, float(v)) for k in (1, 2) for v in np.random.default_rng(k).permutation(values)] + [(3, 5.0), (4, None)], "k int, v double").repartition(5)
    ranks = {"a": F.lit(0), "b": F.floor(F.col("_n") / 3), "c": F.col("_n") - 1, "d": F.lit(n), "e": F.lit(-1)}
    got = {r.k: r for r in order_statistics.at_ranks(df, ["k"], "v", ranks, saver(spark), parts=8, few=20).collect()}
    s = np.sort(values)
    for k in (1, 2):
        assert (got[k].a, got[k].b, got[k].c, got[k].d, got[k].e) == (s[0], s[n // 3], s[-1], None, None)
    assert (got[3].a, got[3].c) == (5.0, 5.0) and 4 not in got


def test_lines_are_drawn_along_their_longer_axis(spark):
    points = spark.createDataFrame([(1, 1, 1, 0.0, 0.0), (1, 1, 2, 4.0, 2.0), (1, 1, 3, 4.0, -3.0), (1, 2, 1, 9.2, 9.6)], "frame int, contour int, point int, x double, y double")
    got = {(r.contour, r.y, r.x) for r in reconstruction.rasterised(points).collect()}
    assert {(1, 0, 0), (1, 1, 1), (1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 1, 4), (1, 0, 4), (1, -1, 4), (1, -2, 4), (1, -3, 4), (2, 10, 9)} == got


def test_the_right_curve_explains_an_image_better(spark):
    y, x = np.mgrid[:40, :60]
    line = 50 * np.exp(-0.5 * ((y - 20.0) / 1.8) ** 2)
    p = plane(spark, line)
    curve = lambda at: spark.createDataFrame([(1, 1, i, float(i), float(at)) for i in range(60)], "frame int, contour int, point int, x double, y double")
    right, wrong, none = (reconstruction.reconstruction_error(c, p).first().error for c in (curve(20), curve(28), curve(20).limit(0)))
    assert right < 0.5 < none < wrong or right < none and right < wrong
    assert none == pytest.approx(line.mean())


def test_projection_levels(spark):
    p = plane(spark, np.arange(400.0).reshape(20, 20)).union(plane(spark, np.ones((20, 20)), 2))
    got = images.projection_levels(p, saver(spark), 0.0).groupBy("frame").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    assert {(r.lo, r.hi) for r in got} == {(0.0, 255.0)}


def test_increasing_turns_and_ranges(spark):
    from weftline.functions import angles

    rng = np.random.default_rng(9)
    rows = [(float(a), float(b)) for a, b in rng.uniform(-4, 4, (50, 2))] + [(-math.pi / 2, math.pi / 2), (0.3, 0.3)]
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", angles.forward(F.col("a"), F.col("b")).alias("t"), angles.in_range(F.col("a")).alias("i")).collect()
    for r in got:
        assert 0 <= r.t < math.pi and abs(math.sin(r.b - r.a - r.t)) < 1e-9
        assert r.i == (-math.pi / 2 <= r.a < math.pi / 2)
