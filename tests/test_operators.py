import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import kernels
from weftline.operators import components, curves, fitting, images, linking, spatial, tiles, tracing
from weftline.operators.storage import saver
from weftline.sources import tables


def plane(spark, a, frame=1):
    h, w = a.shape
    rows = [(frame, y, x, float(a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "frame int, y int, x int, v double")


def ridge(h=48, w=64, sigma=2.0, amp=50.0, at=lambda x: 24 + 0.2 * (x - 32)):
    y, x = np.mgrid[:h, :w]
    return amp * np.exp(-0.5 * ((y - at(x)) / sigma) ** 2)


def test_masks():
    assert [len(kernels.gauss_mask(k, 1.8)) // 2 for k in range(3)] == [6, 7, 7]
    assert math.isclose(sum(kernels.gauss_mask(0, 1.8)), 1) and abs(sum(kernels.gauss_mask(1, 1.8))) < 1e-12 and abs(sum(kernels.gauss_mask(2, 1.8))) < 1e-12


def test_bias_table_inverts_the_model():
    b = kernels.bias_table()
    width, ratio, line, strong = kernels.extents(b[20, 10:11, 0], b[20, 10:11, 1])
    assert width[0] == pytest.approx(4.0, abs=1e-6) and ratio[0] == pytest.approx(0.5, abs=1e-6)
    assert line[0] == pytest.approx(b[20, 10, 2]) and strong[0] == pytest.approx(b[20, 10, 3]) and not b[:, 0].any()


def test_tiles_do_not_change_the_derivatives(spark):
    p = plane(spark, np.random.default_rng(1).integers(0, 50, (30, 41)).astype("float64"))
    a, b = (sorted(map(tuple, images.gauss_derivatives(p, tile=t).collect())) for t in (256, 13))
    assert np.allclose(a, b)
    with pytest.raises(Exception, match="reaches"):
        images.gauss_derivatives(plane(spark, np.zeros((5, 30)))).collect()


def test_traced_ridge_lies_on_its_centre(spark):
    p = plane(spark, ridge())
    found = images.classify(images.ridge_points(images.gauss_derivatives(p)), 1.0, 2.0)
    lines = tracing.trace(found).toPandas()
    longest = lines[lines.contour == lines.groupby("contour").size().idxmax()]
    inner = longest[(longest.x > 6) & (longest.x < 58)]
    assert len(inner) > 45 and np.abs(inner.y - (24 + 0.2 * (inner.x - 32))).max() < 0.1
    along = inner.sort_values("point").x.to_numpy()
    assert (np.diff(along) > 0).all() or (np.diff(along) < 0).all()


def test_crossing_ridges_have_a_junction(spark):
    a = ridge(at=lambda x: 24 + 0 * x)
    y, x = np.mgrid[:48, :64]
    a = a + 50 * np.exp(-0.5 * ((x - 30.0) / 2) ** 2) * (y < 24)
    found = images.classify(images.ridge_points(images.gauss_derivatives(plane(spark, a))), 0.5, 1.0)
    assert tracing.trace(found, extend=4.5).select("contour").distinct().count() >= 2
    assert tracing.junctions(found, extend=4.5).count() >= 1


def test_bresenham_steps_touch():
    rng = random.Random(1)
    for _ in range(200):
        a = rng.uniform(0, 2 * math.pi)
        path = tracing.bresenham(math.sin(a), math.cos(a), rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5), 6)
        assert path and (0, 0) in path[:2] and all(abs(p[0] - q[0]) + abs(p[1] - q[1]) <= 2 for p, q in zip(path, path[1:]))


def test_least_squares():
    x = np.array([0.0, 2, 6, 8, 9])
    f = fitting.solve(fitting.MODELS["line"], x, np.array([[5.0, 10, 23, 33, 40]]), np.ones((1, 2)))
    assert np.allclose(f.a[0], np.polyfit(x, [5, 10, 23, 33, 40], 1), atol=1e-6)
    grid = np.arange(-6.0, 7)
    true = np.array([[30.0, 0.7, 1.9, 4.0], [12.0, -1.1, 2.5, 9.0]])
    y = fitting.MODELS["gauss_bg"].value(grid, true)
    got = fitting.solve(fitting.MODELS["gauss_bg"], grid, y, np.array([[25.0, 0, 2, 3], [10.0, 0, 2, 8]]), 30)
    assert np.allclose(got.a, true, atol=1e-4) and (got.chi2 < 1e-6).all()
    for m in [*(m for m in fitting.MODELS.values() if m.name != "plane"), fitting.polynomial(3)]:
        a = np.linspace(1.1, 2.3, m.parameters)[None]
        for k in range(m.parameters):
            d = np.zeros_like(a)
            d[0, k] = 1e-6
            assert np.allclose((m.value(grid, a + d) - m.value(grid, a - d)) / 2e-6, m.slope(grid, a)[:, :, k], atol=1e-4), m.name
    assert (fitting.usable_weights(np.array([[1.0, -1], [2, 3], [0, 0]]), (3, 2)) == [[1, 1], [2, 3], [1, 1]]).all()


def test_fitted_profiles_move_to_the_ridge(spark):
    p = plane(spark, ridge(at=lambda x: 24.4 + 0 * x) + 3)
    points = spark.createDataFrame([(1, i, float(10 + i), 24.0, 0.0) for i in range(10)], "frame int, point int, x double, y double, angle double")
    for r in fitting.fit_profiles(points, p, ["frame", "point"], length=13, fit_mean=True, steps=20).collect():
        assert abs(r.y - 24.4) < 0.05 and abs(r.sd - 2) < 0.1 and r.r2 > 0.99 and abs(r.x - 10 - r.point) < 1e-6


@pytest.mark.parametrize("reach", [0.5, 3.0])
def test_box_join_matches_all_pairs(spark, reach):
    rng = np.random.default_rng(2)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-20, 20, (120, 2)) / 2)]
    df = spark.createDataFrame(a, "i int, x double, y double")
    got = {(r.l.i, r.r.i) for r in spatial.box_join(df, df, reach).collect()}
    assert got == {(p[0], q[0]) for p in a for q in a if abs(p[1] - q[1]) <= reach and abs(p[2] - q[2]) <= reach}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(df, saver(spark)).collect()}
    assert got == {x: root(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def curve(y, lo, hi, step=1.0):
    return np.array([[x, y, 0.0, 1.0] for x in np.arange(lo, hi, step)])


def test_merges():
    p, q = curve(0, 0, 20), curve(1, 12, 30)
    kind, i, j = linking.overlap_kind(p, q)
    out = linking.merged(p, q, i, j)
    assert kind == "extension" and out[0, 0] == 0 and out[-1, 0] == 29 and (np.diff(out[:, 0]) >= 0).all() and out[0, 1] == 0 and out[-1, 1] == 1
    back = linking.merged(p, q[::-1], *linking.overlap_kind(p, q[::-1])[1:])
    assert np.allclose(back[[0, -1]], out[[0, -1]])
    assert linking.overlap_kind(p, p)[0] == "full" and np.allclose(linking.merged(p, p, *linking.overlap_kind(p, p)[1:]), p)
    assert linking.overlap_kind(p, curve(40, 0, 20))[0] == "none"


def test_links_of_frames(spark):
    rows = [(f, c, n + 1, *map(float, r)) for f, c, k in ((1, 1, curve(0, 0, 20)), (1, 2, curve(100, 0, 9)), (2, 1, curve(1, 12, 30)), (3, 1, curve(0.5, 24, 40))) for n, r in enumerate(k)]
    df = spark.createDataFrame(rows, "frame int, contour int, point int, x double, y double, angle double, response double")
    for link in (linking.link_incrementally, linking.link_pairwise):
        out = link(df, [1, 2, 3], saver(spark)).toPandas()
        spans = sorted((g.x.min(), g.x.max()) for _, g in out.groupby("contour"))
        assert spans == [(0, 8), (0, 39)] and set(out.frame) == {1} and sorted(out.contour.unique()) == [1, 2]
    with pytest.raises(ValueError):
        linking.link_pairwise(df, [1], saver(spark))


def test_curve_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 1, 0.5, 1.5, 0.1, 3.0, 9.0)], "frame int, contour int, point int, x double, y double, angle double, response double, extra double")
    tables.write_curves(df, f"{tmp_path}/a")
    assert tables.read_curves(spark, f"{tmp_path}/a").select(df.columns).collect() == df.collect()
    tables.write_curves(df, f"{tmp_path}/b", "csv", titles=True, header=True)
    back = tables.read_curves(spark, f"{tmp_path}/b", "csv", header=True, inferSchema=True)
    assert back.select(df.columns).collect() == df.collect() and back.first().label == "contour_f_1_c_2"
    with pytest.raises(ValueError, match="angle"):
        tables.checked(df.drop("angle"))
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "slice_7.pgm").write_bytes(b"P5\n3 2\n255\n" + bytes([0, 1, 2, 3, 4, 250]))
    got = tables.read_images(spark, f"{tmp_path}/img")
    assert sorted(map(tuple, got.collect())) == [(7, y, x, float([0, 1, 2, 3, 4, 250][3 * y + x])) for y in range(2) for x in range(3)]


def test_image_extras(spark):
    a = np.zeros((40, 40))
    a[10, 10] = 40
    flat = images.without_background(plane(spark, a + 5)).collect()
    assert max(flat, key=lambda r: r.v)[1:3] == (10, 10)
    assert {r.v for r in images.stretch(plane(spark, np.arange(1600.0).reshape(40, 40)), saver(spark), 0.0).where("v in (0, 255)").collect()} == {0.0, 255.0}
    assert images.share_thresholds(plane(spark, a), 1) == (10.0, 30.0)
    r = spark.range(1).select(images.closest_point(*map(F.lit, (0.0, 0.0, 0.0, 2.0, 3.0, 4.0))).alias("p")).first().p
    assert tuple(r) == (0.0, 4.0, 2.0)
    assert tiles.correlate(np.arange(9.0).reshape(3, 3), (1.0, 0.0, -1.0), 0, 1).tolist() == [[-6.0, -6.0, -6.0]]
    one = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0, None)], "frame int, contour int, point int, x double, y double, angle double, width double")
    assert curves.gaps_filled(one, "width").first().width is None


def test_plane_fit_and_singular_systems():
    x = np.array([[i, j] for i in range(4) for j in range(3)], "float64")
    y = np.stack([2 * x[:, 0] - x[:, 1] + 5, np.zeros(12)])
    assert np.allclose(fitting.solve(fitting.MODELS["plane"], x, y, np.ones((2, 3))).a, [[2, -1, 5], [0, 0, 0]], atol=1e-6)
    f = fitting.solve(fitting.MODELS["line"], np.zeros(4), np.ones((2, 4)), np.zeros((2, 2)))  # one place: the slope is free
    assert np.allclose(f.a[:, 1], 1, atol=1e-6)


@pytest.mark.parametrize("sampling", ["nearest", "bilinear", "bicubic"])
def test_profiles_match_plain_sampling(spark, monkeypatch, sampling):
    monkeypatch.setattr(fitting, "POINTS", 7)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 60, (37, 41)).astype("float64")
    points = [(1, i, float(x), float(y), float(t)) for i, (x, y, t) in enumerate(np.column_stack([rng.uniform(-3, 44, 60), rng.uniform(-3, 40, 60), rng.uniform(-3, 3, 60)]))]
    df = spark.createDataFrame(points, "frame int, point int, x double, y double, angle double")
    got = {r.point: r.profile for r in fitting.profiles(df, plane(spark, a), ["frame", "point"], 8, 3, sampling, tile=16).collect()}
    pixel = lambda y, x: a[y, x] if 0 <= y < 37 and 0 <= x < 41 else 0.0
    cubic = lambda d: 1.5 * abs(d) ** 3 - 2.5 * d * d + 1 if abs(d) < 1 else -0.5 * abs(d) ** 3 + 2.5 * d * d - 4 * abs(d) + 2 if abs(d) < 2 else 0.0

    def value(y, x):
        y0, x0 = math.floor(y), math.floor(x)
        if sampling == "nearest":
            return pixel(math.floor(y + 0.5), math.floor(x + 0.5))
        weight = cubic if sampling == "bicubic" else lambda d: max(0.0, 1 - abs(d))
        return sum(weight(y - v) * weight(x - u) * pixel(v, u) for v in range(y0 - 1, y0 + 3) for u in range(x0 - 1, x0 + 3))

    for _, i, x, y, t in points:
        want = [sum(value(y + d * math.cos(t) + e * math.sin(t), x + d * math.sin(t) - e * math.cos(t)) for e in (-1, 0, 1)) / 3 for d in np.arange(8) - 3.5]
        assert np.allclose(got[i], want)


def straight(lo, hi, y=0.0):
    return np.array([[float(x), y, 0.0, 1.0] for x in range(lo, hi)])


def test_a_chain_of_overlaps_becomes_one_curve():
    curves_ = {"1:a": straight(0, 20), "1:b": straight(30, 50), "2:c": straight(12, 38), "2:d": straight(80, 90)}
    out = linking.fold_component(curves_, [("1:a", "2:c"), ("1:b", "2:c")])
    assert sorted((c[0, 0], c[-1, 0], len(c)) for c in out) == [(0, 49, 50), (80, 89, 10)]


def test_linked_frames(spark):
    rows = [(f, c, i + 1, float(x), 0.0 if c < 3 else 50.0, 0.0, 1.0) for f, c, lo, hi in [(1, 1, 0, 20), (1, 2, 30, 50), (2, 1, 12, 38), (3, 1, 45, 60), (3, 3, 0, 9)] for i, x in enumerate(range(lo, hi))]
    points = spark.createDataFrame(rows, "frame int, contour int, point int, x double, y double, angle double, response double")
    for link in (linking.link_incrementally, linking.link_pairwise):
        got = link(points, [1, 2, 3], saver(spark)).groupBy("contour").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("y").alias("y")).collect()
        assert sorted((r.lo, r.hi, r.y) for r in got) == [(0.0, 8.0, 50.0), (0.0, 59.0, 0.0)]


def found_lines(spark, a, low=0.5, high=1.0, extend=0.0):
    ridges = images.classify(images.ridge_points(images.gauss_derivatives(plane(spark, a))), low, high)
    found = tracing.traced(ridges, extend).toPandas()
    return found[found.contour2.isna()], found[found.contour2.notna()]


def test_a_loop_is_one_closed_line(spark):
    y, x = np.mgrid[:64, :64]
    lines_, junctions_ = found_lines(spark, 50 * np.exp(-0.5 * ((np.hypot(y - 32, x - 32) - 18) / 2) ** 2))
    longest = lines_[lines_.contour == lines_.groupby("contour").size().idxmax()]
    assert len(longest) > 90 and np.abs(np.hypot(longest.y - 32, longest.x - 32) - 18).max() < 0.35
    assert longest.line_class.iloc[0] in ("closed", "start_junc", "end_junc", "both_junc", "no_junc") and lines_.contour.nunique() <= 3


def test_a_y_has_a_junction_near_its_fork(spark):
    y, x = np.mgrid[:64, :64]
    arm = lambda d, on: 50 * np.exp(-0.5 * (d / 2) ** 2) * on
    a = np.maximum(arm(y - 32, 1), arm((y - x) / math.sqrt(2), (x > 32) & (y > 32)))
    lines_, junctions_ = found_lines(spark, a, extend=4.5)
    assert lines_.contour.nunique() >= 2 and len(junctions_) >= 1
    assert (np.hypot(junctions_.y - 32, junctions_.x - 32) < 9).any()


@pytest.mark.parametrize("dim", [1.0, 0.5])
def test_bar_width_and_position_after_correction(spark, dim):
    from weftline.operators import lines

    y, _ = np.mgrid[:48, :72]
    a = np.where(np.abs(y - 24) <= 2, 100.0, 0.0)  # a bar of five rows, its middle at 24
    a[27:] = 100.0 * (1 - dim)  # the far side is nearer to the bar's level
    got = lines.curve_table(plane(spark, a), saver(spark), thresholds=(1.0, 2.0)).toPandas()
    inner = got[(got.x > 12) & (got.x < 60) & (np.abs(got.y - 24) < 4)]
    assert len(inner) > 40
    assert np.abs(inner.y - 24).max() < (0.05 if dim == 1 else 0.35)
    assert np.abs(inner.width_l - 2.5).max() < 0.6 and (inner.contrast > 40).all()
    if dim < 1:
        moved = inner.y - inner.correction * np.cos(inner.angle)
        assert np.abs(inner.y - 24).mean() < np.abs(moved - 24).mean()
