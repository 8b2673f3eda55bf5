"""Numbers of lines that pairs of thresholds would give, for all pairs at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import connected_components

#: Columns of an image that runs of pixels are compared in.
CELL = 64


def threshold_grid(saliency: DataFrame, lows: list[float], highs: list[float], save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """frame, low, high, n, for every frame of saliency (frame, y, x, v) and every low and high with low <= high: the regions of pixels of at least `low` (joined along edges and corners) that have a pixel of at
    least `high`, which is what hysteresis keeps.

    Each low threshold makes runs of pixels along the rows. Runs that touch in neighbouring rows are edges, and one search for connected components serves all frames and thresholds; a region is then its largest
    value, which all high thresholds are compared with."""
    lows, highs = sorted(set(map(float, lows))), sorted(set(map(float, highs)))
    level = F.explode(F.array(*(F.lit(x) for x in lows)))
    on = saliency.where(F.col("v") >= lows[0]).select("frame", "y", "x", "v", level.alias("low")).where(F.col("v") >= F.col("low"))
    row = Window.partitionBy("frame", "low", "y").orderBy("x")
    on = on.withColumn("_island", F.col("x") - F.row_number().over(row))
    runs = on.groupBy("frame", "low", "y", "_island").agg(F.min("x").alias("start"), F.max("x").alias("stop"), F.max("v").alias("most")).drop("_island")
    runs = save(runs.withColumn("id", F.monotonically_increasing_id()), "runs")  # once written, a run's number is fixed
    cells = lambda first, last: F.explode(F.sequence(F.floor(first / CELL), F.floor(last / CELL)))
    a = runs.select("frame", "low", (F.col("y") + 1).alias("y"), F.col("id").alias("u"), (F.col("start") - 1).alias("_from"), (F.col("stop") + 1).alias("_to"), cells(F.col("start") - 1, F.col("stop") + 1).alias("_cell"))
    b = runs.select("frame", "low", "y", F.col("id").alias("v"), "start", "stop", cells(F.col("start"), F.col("stop")).alias("_cell"))
    edges = a.join(b, ["frame", "low", "y", "_cell"]).where((F.col("start") <= F.col("_to")) & (F.col("stop") >= F.col("_from"))).select("u", "v")
    parts = connected_components(edges, save).withColumnRenamed("node", "id")
    regions = runs.join(parts, "id", "left").groupBy("frame", "low", F.coalesce("component", "id").alias("_region")).agg(F.max("most").alias("_peak"))
    counts = regions.groupBy("frame", "low").agg(*(F.count(F.when(F.col("_peak") >= h, 1)).alias(f"_{i}") for i, h in enumerate(highs)))
    every = saliency.select("frame").distinct().withColumn("low", level)
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("high"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("n")) for i, h in enumerate(highs))))
    return every.join(counts, ["frame", "low"], "left").select("frame", "low", each.alias("_g")).select("frame", "low", "_g.high", "_g.n").where("low <= high")
