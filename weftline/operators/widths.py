"""Widths of lines: edges are ridges of the gradient's size by the facet model; points meet those around them in tiles, pixel by pixel along their normals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import ridge_points
from .tiles import TILE, at_points, map_tiles

#: Largest offset of an edge from its pixel's centre.
EDGE_BOUNDARY = 0.5


def facet_planes(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """frame, y, x, d, r, c, rr, rc, cc: value and derivatives of the quadratic that best fits a pixel's 3 by 3 neighbourhood (mirrored at the border), as images.facet() has them, by tiles."""
    def work(p):
        z = p["v"]
        h, w = z.shape[0] - 2, z.shape[1] - 2
        at = lambda i, j: z[i:i + h, j:j + w]
        rows, cols = [at(i, 0) + at(i, 1) + at(i, 2) for i in range(3)], [at(0, j) + at(1, j) + at(2, j) for j in range(3)]
        corners = at(0, 0) + at(0, 2) + at(2, 0) + at(2, 2)
        sides = at(0, 1) + at(1, 0) + at(1, 2) + at(2, 1)
        return {"d": (2 * sides - corners + 5 * at(1, 1)) / 9, "r": (rows[2] - rows[0]) / 6, "c": (cols[2] - cols[0]) / 6, "rr": (rows[0] - 2 * rows[1] + rows[2]) / 3, "cc": (cols[0] - 2 * cols[1] + cols[2]) / 3,
                "rc": (at(0, 0) - at(0, 2) - at(2, 0) + at(2, 2)) / 4}

    return map_tiles(pixels, ["v"], 1, work, "d double, r double, c double, rr double, rc double, cc double", tile=tile)


def edge_points(gradient: DataFrame) -> DataFrame:
    """frame, y, x, ey, ex, height: pixels (frame, y, x, v) on which the quadratic of their neighbourhood has a ridge, where it is and how high."""
    f = ridge_points(facet_planes(gradient))
    u, v = F.col("py") - F.col("y"), F.col("px") - F.col("x")
    on = (F.col("response") > 0) & (F.abs(u) <= EDGE_BOUNDARY) & (F.abs(v) <= EDGE_BOUNDARY)
    height = F.col("d") + u * F.col("r") + v * F.col("c") + (u * u * F.col("rr") + v * v * F.col("cc")) / 2 + u * v * F.col("rc")
    return f.where(on).select("frame", "y", "x", F.col("py").alias("ey"), F.col("px").alias("ex"), height.alias("height"))


def ray_pixels(points: DataFrame, most: float) -> DataFrame:
    """The points, once for each side (-1 and 1) and each pixel that the normal from the middle of the point's own pixel passes within `most`: _side, _y, _x, and _t, where it enters the pixel. line_widths() passes the same pixels."""
    p = points.withColumns({"_ny": F.cos("angle"), "_nx": F.sin("angle")})
    p = p.withColumns({"_ay": F.abs("_ny"), "_ax": F.abs("_nx")})
    rows = F.sequence(F.lit(0), F.floor(F.col("_ay") * most + 0.5).cast("int"))
    p = p.where("angle is not null").withColumn("_i", F.explode(rows))
    enter = F.when(F.col("_i") > 0, F.try_divide(F.col("_i") - 0.5, F.col("_ay"))).otherwise(0.0)
    leave = F.least(F.lit(float(most)), F.try_divide(F.col("_i") + 0.5, F.col("_ay")))
    column = lambda t: F.floor(F.col("_ax") * t + 0.5).cast("int")
    p = p.withColumns({"_in": enter, "_out": leave}).withColumn("_j", F.explode(F.sequence(column(F.col("_in")), F.greatest(column(F.col("_in")), column(F.col("_out"))))))
    p = p.withColumn("_t", F.greatest("_in", F.when(F.col("_j") > 0, F.try_divide(F.col("_j") - 0.5, F.col("_ax"))).otherwise(0.0)))
    p = p.withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1))))
    at = lambda c, n, k: (F.floor(F.col(c) + 0.5) + F.col("_side") * F.signum(n) * F.col(k)).cast("int")
    return p.withColumns({"_y": at("y", "_ny", "_i"), "_x": at("x", "_nx", "_j")}).drop("_ay", "_ax", "_i", "_j", "_in", "_out")


def line_widths(lines: DataFrame, gradient: DataFrame, most: float, ids: list[str] | None = None) -> DataFrame:
    """Add width_l, width_r, grad_l, grad_r: on either side of a point, how far the first edge along the normal lies (as its distance along the normal), and how high it is; null where
    there is none within `most` pixels or the image ends before. `gradient` is the gradient's size (frame, y, x, v); `ids` (frame, contour, point) tell points apart."""
    ids = ids or ["frame", "contour", "point"]
    names = ["width_l", "width_r", "grad_l", "grad_r"]

    def work(y, x, angle, planes, top, left):
        ny, nx = np.cos(angle), np.sin(angle)
        ay, ax = np.abs(ny), np.abs(nx)
        row, column = np.floor(y + 0.5).astype("i8"), np.floor(x + 0.5).astype("i8")
        first, width, height = (np.full((2, len(y)), v) for v in (np.inf, np.nan, np.nan))
        with np.errstate(all="ignore"):
            for i in range(math.floor(most + 0.5) + 1):
                enter = (i - 0.5) / ay if i else np.zeros(len(y))
                leave = np.minimum(most, (i + 0.5) / ay)
                start = np.floor(ax * enter + 0.5)
                stop = np.maximum(start, np.floor(ax * leave + 0.5))
                for j in range(math.floor(most + 0.5) + 1):
                    t = np.maximum(enter, (j - 0.5) / ax) if j else enter
                    met = np.flatnonzero((i <= np.floor(ay * most + 0.5)) & (start <= j) & (j <= stop))
                    for k, side in enumerate((-1, 1)):
                        at = row[met] + side * np.sign(ny[met]).astype("i8") * i - top, column[met] + side * np.sign(nx[met]).astype("i8") * j - left
                        h = planes["height"][at]
                        better = ~np.isnan(h) & (t[met] < first[k, met])
                        m, at = met[better], tuple(p[better] for p in at)
                        first[k, m], height[k, m] = t[m], h[better]
                        width[k, m] = np.abs((planes["ey"][at] - y[m]) * ny[m] + (planes["ex"][at] - x[m]) * nx[m])
        return dict(zip(names, (*width, *height)))

    return at_points(lines, edge_points(gradient), ["ey", "ex", "height"], ids, math.ceil(most) + 2, work, ", ".join(f"{n} double" for n in names))
