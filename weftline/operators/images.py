"""Filters and statistics of images: pixels (frame, y, x, v)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.kernels import RADIUS, gauss_mask
from .order_statistics import at_ranks
from .storage import large
from .tiles import TILE, correlate, map_tiles

SIGMA = 1.8
#: Largest offset of a line point from its pixel's centre.
BOUNDARY = 0.6


def gauss_derivatives(pixels: DataFrame, sigma: float = SIGMA, tile: int = TILE) -> DataFrame:
    """frame, y, x, r, c, rr, rc, cc: derivatives of the smoothed image down the rows and along the columns.

    Three passes along one axis serve five along the other. Borders are mirrored; an image no larger than the mask's radius is an error."""
    masks = [gauss_mask(k, sigma) for k in range(3)]
    halo = math.ceil(RADIUS[2] * sigma)

    def work(p):
        m0, m1, m2 = (correlate(p["v"], m, 0, halo) for m in masks)
        along = lambda a, k: correlate(a, masks[k], 1, halo)
        return {"r": along(m1, 0), "c": along(m0, 1), "rr": along(m2, 0), "rc": along(m1, 1), "cc": along(m0, 2)}

    return map_tiles(pixels, ["v"], halo, work, "r double, c double, rr double, rc double, cc double", tile=tile)


def gauss_blur(pixels: DataFrame, sigma: float, tile: int = TILE) -> DataFrame:
    """frame, y, x, v: the smoothed image. Borders are mirrored once: where a mask reaches beyond the mirror image of a small image, it finds 0."""
    mask = gauss_mask(0, sigma)
    halo = len(mask) // 2
    return map_tiles(pixels, ["v"], halo, lambda p: {"v": correlate(correlate(p["v"], mask, 0, halo), mask, 1, halo)}, "v double", tile=tile, small=True)


def ridge_points(derivatives: DataFrame, bright: bool = True) -> DataFrame:
    """Add response, ny, nx (unit normal: down the rows, along the columns), py, px (sub-pixel position; null where undefined), length of the gradient.

    The normal belongs to the eigenvalue of the Hessian with the larger size, the smaller one if sizes are equal. Its sign is such that nx >= 0
    (ny > 0 where nx is 0)."""
    a, b, c = F.col("rr"), F.col("rc"), F.col("cc")
    mean, half = (a + c) / 2, (a - c) / 2
    root = F.sqrt(half * half + b * b)
    strong = F.when(mean > 0, mean + root).otherwise(mean - root)
    d = derivatives.withColumns({"_l": strong, "gradient": F.sqrt(F.col("r") * F.col("r") + F.col("c") * F.col("c"))})
    # eigenvector of [[a, b], [b, c]] for _l: of the two rows' perpendiculars the longer one
    u1, v1, u2, v2 = b, F.col("_l") - a, F.col("_l") - c, b
    first = (F.abs(F.col("_l") - a)) > F.abs(F.col("_l") - c)
    u, v = F.when(first, u1).otherwise(u2), F.when(first, v1).otherwise(v2)
    d = d.withColumns({"_u": u, "_v": v})
    size = F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v"))
    flat = size == 0  # a multiple of the unit matrix: any axis will do
    sign = F.when((F.col("_v") < 0) | ((F.col("_v") == 0) & (F.col("_u") < 0)), -1.0).otherwise(1.0)
    d = d.withColumns({"ny": F.when(flat, 0.0).otherwise(sign * F.try_divide("_u", size)), "nx": F.when(flat, 1.0).otherwise(sign * F.try_divide("_v", size)), "response": -F.col("_l") if bright else F.col("_l")})
    ny, nx = F.col("ny"), F.col("nx")
    t = -F.try_divide(F.col("r") * ny + F.col("c") * nx, a * ny * ny + 2 * b * ny * nx + c * nx * nx)
    d = d.withColumn("_t", t)
    return d.withColumns({"py": F.col("y") + F.col("_t") * ny, "px": F.col("x") + F.col("_t") * nx}).drop("_l", "_u", "_v", "_t")


def near_centre() -> Column:
    return F.coalesce((F.abs(F.col("px") - F.col("x")) <= BOUNDARY) & (F.abs(F.col("py") - F.col("y")) <= BOUNDARY), F.lit(False))


def classify(ridges: DataFrame, low: float, high: float) -> DataFrame:
    """Add line_class: 2 strong, 1 weak, 0 no line point."""
    value = F.when(F.col("response") >= high, 2).when(F.col("response") >= low, 1).otherwise(0)
    return ridges.withColumn("line_class", F.when(near_centre(), value).otherwise(0))


def saliency(ridges: DataFrame) -> DataFrame:
    """frame, y, x, v: the positive response of line points, elsewhere 0."""
    return ridges.select("frame", "y", "x", F.when(near_centre() & (F.col("response") > 0), F.col("response")).otherwise(0.0).alias("v"))


def share_thresholds(saliency_: DataFrame, frame: int, low: float = 0.25, high: float = 0.75) -> tuple[float, float]:
    """(low, high) as shares of the range of one frame's saliency."""
    least, most = saliency_.where(F.col("frame") == frame).agg(F.min("v"), F.max("v")).first()
    return least + low * (most - least), least + high * (most - least)


def histogram(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """frame, bin (0 .. bins - 1), n, least, width: counts of equal bins over each frame's range."""
    ranges = pixels.groupBy("frame").agg(F.min("v").alias("least"), F.max("v").alias("most")).withColumn("width", (F.col("most") - F.col("least")) / bins)
    at = F.when(F.col("width") == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("least"), F.col("width")))))
    return pixels.join(ranges, "frame").groupBy("frame", "least", "width", at.cast("int").alias("bin")).agg(F.count("*").alias("n")).select("frame", "bin", "n", "least", "width")


def otsu_threshold(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """frame, threshold: the upper edge of the bin that best separates two classes of values (the first one of equals)."""
    h = histogram(pixels, bins)
    below = Window.partitionBy("frame").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("frame")
    n, s = F.col("n"), F.col("n") * F.col("bin")
    h = h.withColumns({"_n": F.sum(n).over(below), "_s": F.sum(s).over(below), "_n2": F.sum(n).over(all_), "_s2": F.sum(s).over(all_)})
    n, s, total, all_s = (F.col(c).cast("double") for c in ("_n", "_s", "_n2", "_s2"))
    gap = s * total - all_s * n
    h = h.withColumn("_gain", F.coalesce(F.try_divide(gap * gap, n * (total - n)), F.lit(-1.0)))
    best = h.groupBy("frame").agg(F.min_by(F.struct("bin", "least", "width"), F.struct(-F.col("_gain"), "bin")).alias("b"))
    return best.select("frame", (F.col("b.least") + F.col("b.width") * (F.col("b.bin") + 1)).alias("threshold"))


def runs(pixels: DataFrame, least: float) -> DataFrame:
    """frame, y, start, stop: longest horizontal runs of values of at least `least`."""
    row = Window.partitionBy("frame", "y").orderBy("x")
    on = pixels.where(F.col("v") >= least).withColumn("_island", F.col("x") - F.row_number().over(row))
    return on.groupBy("frame", "y", "_island").agg(F.min("x").alias("start"), F.max("x").alias("stop")).drop("_island")


def ranked_seeds(pixels: DataFrame, least: float) -> DataFrame:
    """frame, rank, y, x, v: pixels of at least `least` in each frame by size, strongest first, then by row and column."""
    order = Window.partitionBy("frame").orderBy(F.desc(F.abs("v")), "y", "x")
    return pixels.where(F.col("v") >= least).select("frame", F.row_number().over(order).alias("rank"), "y", "x", "v")


def facet(pixels: DataFrame) -> DataFrame:
    """Add d, dr, dc, drr, drc, dcc: the quadratic that best fits a pixel's 3 by 3 neighbourhood (mirrored at the border)."""
    along, down = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    before = lambda c, w: F.coalesce(F.lag(c).over(w), F.lead(c).over(w), F.col(c))
    after = lambda c, w: F.coalesce(F.lead(c).over(w), F.lag(c).over(w), F.col(c))
    p = pixels.withColumns({"_w": before("v", along), "_e": after("v", along)})
    names = {"v": "c", "_w": "w", "_e": "e"}
    p = p.withColumns({f"_n{names[c]}": before(c, down) for c in names} | {f"_s{names[c]}": after(c, down) for c in names})
    nw, n, ne, w, c, e, sw, s, se = (F.col(x) for x in ("_nw", "_nc", "_ne", "_w", "v", "_e", "_sw", "_sc", "_se"))
    return p.withColumns({
        "d": (-nw + 2 * n - ne + 2 * w + 5 * c + 2 * e - sw + 2 * s - se) / 9,
        "dr": (sw + s + se - nw - n - ne) / 6,
        "dc": (ne + e + se - nw - w - sw) / 6,
        "drr": (nw + n + ne - 2 * (w + c + e) + sw + s + se) / 6,
        "drc": (nw - ne - sw + se) / 4,
        "dcc": (nw + w + sw - 2 * (n + c + s) + ne + e + se) / 6,
    }).drop("_w", "_e", "_nw", "_nc", "_ne", "_sw", "_sc", "_se")


def facet_value(py: Column, px: Column) -> Column:
    """The quadratic of facet() at a position near its pixel."""
    u, v = py - F.col("y"), px - F.col("x")
    return F.col("d") + u * F.col("dr") + v * F.col("dc") + u * u * F.col("drr") + u * v * F.col("drc") + v * v * F.col("dcc")


def bilinear(points: DataFrame, pixels: DataFrame, y: str = "py", x: str = "px", out: str = "value") -> DataFrame:
    """Add the image's value between the four pixels around each point (those beyond the border count 0). Points need a `frame`; (frame, y, x) rows
    that are alike share a result. One equi-join by pixel."""
    points = points.withColumns({"_y0": F.floor(y).cast("int"), "_x0": F.floor(x).cast("int")})
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    keys = points.select("frame", y, x, "_y0", "_x0").distinct().withColumn("_k", corners)
    fy, fx = F.col(y) - F.col("_y0"), F.col(x) - F.col("_x0")
    weight = F.when(F.col("_k.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("_k.b") == 1, fx).otherwise(1 - fx)
    keys = keys.select("frame", y, x, (F.col("_y0") + F.col("_k.a")).alias("_py"), (F.col("_x0") + F.col("_k.b")).alias("_px"), weight.alias("_weight"))
    near = keys.join(large(pixels.select(F.col("frame"), F.col("y").alias("_py"), F.col("x").alias("_px"), F.col("v").alias("_v"))), ["frame", "_py", "_px"], "left")
    values = near.groupBy("frame", y, x).agg(F.sum(F.col("_weight") * F.coalesce("_v", F.lit(0.0))).alias(out))
    return points.drop("_y0", "_x0").join(large(values), ["frame", y, x])


def closest_point(ly: Column, lx: Column, dy: Column, dx: Column, py: Column, px: Column) -> Column:
    """(y, x, t) on the line through (ly, lx) along (dy, dx) that is closest to (py, px); t is 0 for a line without direction."""
    t = F.coalesce(F.try_divide((py - ly) * dy + (px - lx) * dx, dy * dy + dx * dx), F.lit(0.0))
    return F.struct((ly + t * dy).alias("y"), (lx + t * dx).alias("x"), t.alias("t"))


def cumulative_projection(pixels: DataFrame) -> DataFrame:
    """frame, y, x, v: sums of each pixel over the frames so far."""
    w = Window.partitionBy("y", "x").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.select("frame", "y", "x", F.sum("v").over(w).alias("v"))


def stretch(pixels: DataFrame, save: Callable[[DataFrame, str], DataFrame], saturated: float = 0.35) -> DataFrame:
    """Values on 0 .. 255; `saturated` percent in all of each frame's pixels clip at the ends, which are the values at the places floor(n s) and n - 1 - floor(n s) for half that share s."""
    cut = F.floor(F.col("_n") * (saturated / 200))
    ends = at_ranks(pixels, ["frame"], "v", {"_lo": cut, "_hi": F.col("_n") - 1 - cut}, save)
    share = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    level = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))) * 255 + 0.5)
    return pixels.join(ends, "frame").select("frame", "y", "x", level.cast("double").alias("v"))


def projection_levels(pixels: DataFrame, save: Callable[[DataFrame, str], DataFrame], saturated: float = 0.35) -> DataFrame:
    """frame, y, x, v: the cumulative projection, stretched to 8 bits frame by frame."""
    return stretch(save(cumulative_projection(pixels), "projection"), save, saturated)


def value_statistics(pixels: DataFrame) -> DataFrame:
    """frame, mode (the least of the most frequent values), sd (of a sample), most."""
    per = pixels.groupBy("frame", "v").agg(F.count("*").alias("n"))
    modes = per.groupBy("frame").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("mode"))
    return pixels.groupBy("frame").agg(F.stddev_samp("v").alias("sd"), F.max("v").alias("most")).join(modes, "frame")


def bin_count(pixels: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """frame, bins: the number of bins by the range between quartiles (the values at places round(n / 4) and round(3 n / 4))."""
    place = lambda q: F.least(F.floor(F.col("_n") * q + 0.5), F.col("_n") - 1)
    q = at_ranks(pixels, ["frame"], "v", {"lo": place(0.25), "hi": place(0.75), "least": F.lit(0), "most": F.col("_n") - 1}, save)
    width = 2 * (F.col("hi") - F.col("lo")) * F.pow(F.col("_n").cast("double"), F.lit(-1 / 3))
    return q.select("frame", F.floor(F.try_divide(F.col("most") - F.col("least"), width) + 0.5).cast("long").alias("bins"))


def saturation_level(pixels: DataFrame, percent: float, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """frame, level: the value above which `percent` of the values lie."""
    at = F.least(F.floor(F.col("_n") * (1 - percent / 100) + 0.5), F.col("_n") - 1)
    return at_ranks(pixels, ["frame"], "v", {"level": at}, save).select("frame", "level")


def without_background(pixels: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """The image less its blur over 5 sigma, rounded to whole numbers, less the most frequent of these values."""
    blurred = gauss_blur(pixels, 5 * sigma).withColumnRenamed("v", "_b")
    flat = pixels.join(large(blurred), ["frame", "y", "x"]).select("frame", "y", "x", F.floor(F.col("v") - F.col("_b") + 0.5).alias("v"))
    return flat.join(value_statistics(flat).select("frame", "mode"), "frame").select("frame", "y", "x", (F.col("v") - F.col("mode")).cast("double").alias("v"))


def mean_absolute_error(pixels: DataFrame, model: DataFrame) -> DataFrame:
    """frame, error: the mean distance of the image's values from the model's (0 where the model has no pixel)."""
    m = model.groupBy("frame", "y", "x").agg(F.sum("v").alias("_m"))
    both = pixels.join(large(m), ["frame", "y", "x"], "left")
    return both.groupBy("frame").agg(F.avg(F.abs(F.col("v") - F.coalesce("_m", F.lit(0.0)))).alias("error"))


def drawn_curves(points: DataFrame, value: Column) -> DataFrame:
    """frame, y, x, v: a value on each pixel that holds points of curves, once for each curve."""
    at = points.select("frame", "contour", F.floor(F.col("y") + 0.5).cast("int").alias("y"), F.floor(F.col("x") + 0.5).cast("int").alias("x"), value.alias("v"))
    return at.groupBy("frame", "contour", "y", "x").agg(F.max("v").alias("v")).groupBy("frame", "y", "x").agg(F.sum("v").alias("v"))
