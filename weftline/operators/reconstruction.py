"""How well traced curves explain an image: curves drawn as lines of their own brightness, blurred, and compared with the image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .images import SIGMA, gauss_blur, mean_absolute_error
from .storage import large

#: A fixed value: the mean of a blurred line of one pixel, times sigma, as a part of the line's value.
LINE_SHARE = 0.342


def rasterised(points: DataFrame) -> DataFrame:
    """frame, contour, y, x: the pixels of lines from each point of a curve (frame, contour, point, x, y) to the next, once each; along the longer axis a line has one pixel a column or row."""
    at = lambda c: F.floor(F.col(c) + 0.5).cast("long")
    order = Window.partitionBy("frame", "contour").orderBy("point")
    ends = points.select("frame", "contour", "point", at("x").alias("x0"), at("y").alias("y0"))
    ends = ends.withColumns({"dx": F.coalesce(F.lead("x0").over(order) - F.col("x0"), F.lit(0)), "dy": F.coalesce(F.lead("y0").over(order) - F.col("y0"), F.lit(0))})
    ends = ends.withColumn("n", F.greatest(F.abs("dx"), F.abs("dy"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    place = lambda c, d: (F.col(c) + F.floor(F.coalesce(F.try_divide(2 * F.col("k") * F.col(d) + F.col("n"), 2 * F.col("n")), F.lit(0.0)))).cast("int")
    return ends.select("frame", "contour", place("y0", "dy").alias("y"), place("x0", "dx").alias("x")).distinct()


def drawn_lines(points: DataFrame, pixels: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """frame, y, x, v: each curve's pixels at the image's mean under the curve, times sigma / LINE_SHARE; where curves cross, the one of the largest number counts. Pixels beyond the image are left out."""
    under = rasterised(points).join(large(pixels.select("frame", "y", "x", "v")), ["frame", "y", "x"])
    mean = under.groupBy("frame", "contour").agg((F.avg("v") * sigma / LINE_SHARE).alias("value"))
    top = under.groupBy("frame", "y", "x").agg(F.max("contour").alias("contour"))
    return top.join(large(mean), ["frame", "contour"]).select("frame", "y", "x", F.col("value").alias("v"))


def reconstruction(points: DataFrame, pixels: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """frame, y, x, v: what the curves alone would look like in an image of the size of `pixels`."""
    lines = drawn_lines(points, pixels, sigma).withColumnRenamed("v", "_line")
    whole = pixels.select("frame", "y", "x").join(large(lines), ["frame", "y", "x"], "left").select("frame", "y", "x", F.coalesce("_line", F.lit(0.0)).alias("v"))
    return gauss_blur(whole, sigma)


def reconstruction_error(points: DataFrame, pixels: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """frame, error: the mean distance between the image (without_background()) and its reconstruction."""
    return mean_absolute_error(pixels, reconstruction(points, pixels, sigma))
