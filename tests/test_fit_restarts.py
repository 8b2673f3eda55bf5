"""A search that gets stuck starts again: v = a + a b x + c y has the plane as its best fit, also where a has to pass 0."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import group_fits
from weftline.operators.storage import saver


def test_the_best_fit_is_found_beyond_a_zero(spark):
    rng = random.Random(6)
    planes = {k: (rng.uniform(-3, -0.2) if k else 1.4, rng.uniform(-0.05, 0.05), rng.uniform(-0.1, 0.1)) for k in range(10)}
    rows = [(k, x, y, a + b * x + c * y + rng.gauss(0, 1)) for k, (a, b, c) in planes.items() for x in range(0, 64, 3) for y in range(0, 16, 3)]
    p = spark.createDataFrame(rows, "frame int, x int, y int, v double").coalesce(2)
    start = p.select("frame").distinct().withColumn("a", F.array(F.lit(1.0), F.lit(0.1), F.lit(0.0)))
    got = group_fits.nonlinear_fit(p, ["frame"], F.col("v"), lambda a: a[0] + a[0] * a[1] * F.col("x") + a[2] * F.col("y"), lambda a: [1 + a[1] * F.col("x"), a[0] * F.col("x"), F.col("y").cast("double")], start, saver(spark), steps=20, least_gain=1e-11)
    want = {r.frame: r for r in group_fits.linear_fit(p, ["frame"], F.col("v"), [F.lit(1.0), F.col("x"), F.col("y")]).collect()}
    assert got.columns == ["frame", "a", "chi2", "n", "steps"]
    for r in got.collect():
        assert r.chi2 == pytest.approx(want[r.frame].chi2, rel=1e-6) and r.n == want[r.frame].n
        assert np.allclose([r.a[0], r.a[0] * r.a[1], r.a[2]], want[r.frame].a, atol=1e-2)
