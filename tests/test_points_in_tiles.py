"""Points that meet an image in tiles: the same results as pairs of rows give, without the rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import fitting, images, spatial, widths

from tests.test_operators import plane


def placed(spark, n=60):
    rng = random.Random(2)
    rows = [(1, 1, k, rng.uniform(-4, 30), rng.uniform(-4, 26), rng.choice([rng.uniform(-2, 3), 0.0, math.pi / 2, None])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "frame int, contour int, point int, x double, y double, angle double")


def cogrouped(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return "CoGroupsInArrow" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_profiles_of_points_with_the_same_ids_are_their_own(spark):
    image = plane(spark, np.random.default_rng(1).integers(0, 50, (24, 28)).astype("float64"))
    p = spark.createDataFrame([(1, 1, 5.0, 6.0, 0.3), (1, 1, 15.0, 16.0, 0.3)], "frame int, point int, x double, y double, angle double")
    got = sorted(fitting.profiles(p, image, ["frame", "point"]).collect(), key=lambda r: r.x)
    alone = [fitting.profiles(p.where(f"x = {x}"), image, ["frame", "point"]).first().profile for x in (5.0, 15.0)]
    assert [r.profile for r in got] == alone and alone[0] != alone[1]
    assert cogrouped(fitting.profiles(p, image, ["frame", "point"]))


def test_widths_are_those_of_the_pixels_on_the_rays(spark):
    g = plane(spark, np.random.default_rng(7).uniform(0, 9, (22, 26)))
    rows, p = placed(spark)
    rays = widths.ray_pixels(p, 4.5).join(widths.edge_points(g).withColumnsRenamed({"y": "_y", "x": "_x"}), ["frame", "_y", "_x"])
    far = F.abs((F.col("ey") - F.col("y")) * F.col("_ny") + (F.col("ex") - F.col("x")) * F.col("_nx"))
    want = {(r.point, r._side): (r.e.w, r.e.height) for r in rays.groupBy("point", "_side").agg(F.min_by(F.struct(far.alias("w"), "height"), "_t").alias("e")).collect()}
    found = widths.line_widths(p, g, 4.5)
    got = {(r.point, s): v for r in found.collect() for s, v in ((-1, (r.width_l, r.grad_l)), (1, (r.width_r, r.grad_r))) if v[0] is not None}
    assert found.count() == len(rows) and got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert "min_by" not in found._jdf.queryExecution().sparkPlan().toString()


def test_shift_in_an_image_is_that_of_all_pairs(spark):
    a = np.random.default_rng(5).integers(0, 20, (22, 26)).astype("float64")
    rows, p = placed(spark)
    image = plane(spark, a).where("(x + y) % 7 <> 0")
    moved = spatial.mean_shift_image(p, image, ["frame", "contour", "point"], 2)
    assert cogrouped(moved)
    for r in moved.collect():
        x, y, angle = rows[r.point][3:]
        near = [(u, v, a[v, u]) for v in range(22) for u in range(26) if (u + v) % 7 and abs(u - x) <= 6 and abs(v - y) <= 6]
        s = sx = sy = 0.0
        for u, v, value in near if angle is not None else []:
            t = math.remainder(math.atan2(v - y, u - x) - angle, math.pi) / 0.4363323129985824
            w = math.exp(-0.5 * t * t) * math.exp(-0.5 * ((u - x) ** 2 + (v - y) ** 2) / 4) * (value - min(n[2] for n in near))
            s, sx, sy = s + w, sx + w * u, sy + w * v
        assert (r.x, r.y) == (pytest.approx(sx / s), pytest.approx(sy / s)) if s else (r.x, r.y) == (x, y)
    assert moved.columns == p.columns
