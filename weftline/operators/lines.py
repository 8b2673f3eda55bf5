"""From images to a table of curves: ridge points, tracing, junctions, widths, correction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import curves, images, tracing, widths

#: How far widths are looked for and free ends go on, in sigmas.
REACH = 2.5


def split_lines(lines: DataFrame, junctions: DataFrame) -> DataFrame:
    """Lines cut at the junctions that lie on them, with line_class as their new ends are, numbered anew."""
    parts = curves.split_at(lines, junctions.select("frame", F.col("contour1").alias("contour"), "point"))
    whole = Window.partitionBy("frame", "contour")
    start = F.col("line_class").isin("start_junc", "both_junc") & (F.col("part") == F.min("part").over(whole)) | (F.col("part") > 0)
    end = F.col("line_class").isin("end_junc", "both_junc") & (F.col("part") == F.max("part").over(whole)) | (F.col("part") < F.max("part").over(whole))
    kind = F.when(start & end, "both_junc").when(start, "start_junc").when(end, "end_junc").otherwise(F.when(F.col("line_class") == "closed", "closed").otherwise("no_junc"))
    parts = parts.withColumn("line_class", kind)
    numbers = parts.select("frame", "contour", "part").distinct().withColumn("_new", F.row_number().over(Window.partitionBy("frame").orderBy("contour", "part")))
    parts = parts.join(numbers, ["frame", "contour", "part"]).withColumn("contour", F.col("_new")).drop("_new", "part")
    return curves.renumbered(parts)


def curve_table(pixels: DataFrame, save: Callable[[DataFrame, str], DataFrame], sigma: float = images.SIGMA, thresholds: tuple[float, float] | None = None, extend: float | None = None, least: int = 3, bright: bool = True) -> DataFrame:
    """frame, contour, point, x, y, angle, response, line_class, width_l, width_r, grad_l, grad_r, correction, asymmetry, contrast of all lines of the images.

    `thresholds` of the response are shares of the first frame's saliency unless they are given. Lines are traced, free ends go on for `extend` pixels (2.5 sigma by default), lines are cut at
    junctions, normals are turned to one side, lines of under `least` points go, widths are measured within 2.5 sigma, and positions and widths are corrected."""
    ridges = save(images.ridge_points(images.gauss_derivatives(pixels, sigma), bright), "ridges")
    if thresholds is None:
        shown = images.saliency(ridges)
        frame = shown.agg(F.min("frame")).first()[0]
        thresholds = images.share_thresholds(shown, frame) if frame is not None else (0.0, 0.0)
    found = save(tracing.traced(images.classify(ridges, *thresholds), REACH * sigma if extend is None else extend, bright), "traced")
    lines = split_lines(tracing.lines_of(found), tracing.junctions_of(found))
    lines = save(curves.with_min_points(curves.oriented_normals(lines), least), "lines")
    wide = save(widths.line_widths(lines, ridges.select("frame", "y", "x", F.col("gradient").alias("v")), REACH * sigma), "widths")
    return curves.renumbered(curves.corrected_lines(wide, sigma))
