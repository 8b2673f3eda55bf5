"""Search for the pair of thresholds whose lines explain the images best."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images, reconstruction, tracing

Point = tuple[float, ...]
SCHEMA = "generation int, place int, point array<double>, value double"


def simplex_search(spark: SparkSession, objective: Callable[[list[Point]], list[float]], start: Point, step: Point, path: str | None = None, generations: int = 30, expand: float = 2.0, contract: float = 0.5, least_gain: float = 1e-10) -> tuple[Point, float]:
    """The best point found and its value, by multidirectional search: all other corners of the simplex are mirrored in the best one, and then moved out if that is better still, or in towards the best if
    it isn't. All corners that a generation may need are given to `objective` at once, as one list, so that a generation is one set of jobs, whatever it decides.

    It ends after `generations`, or when a generation gains no more than `least_gain` and the simplex is smaller than that. With `path`, a folder that outlives the application, each generation's simplex is written there,
    and a search that is started again goes on from the last one."""
    simplex, generation = None, 0
    if path:
        try:
            rows = spark.read.schema(SCHEMA).parquet(path)
            generation = rows.agg(F.max("generation")).first()[0]
            simplex = [(tuple(r.point), r.value) for r in rows.where(F.col("generation") == generation).orderBy("place").collect()]  # one more than parameters
        except AnalysisException:
            simplex = None
    if not simplex:
        corners = [tuple(start), *(tuple(x + (step[i] if i == k else 0.0) for i, x in enumerate(start)) for k in range(len(start)))]
        simplex, generation = sorted(zip(corners, objective(corners)), key=lambda c: c[1]), 0
        _keep(spark, path, generation, simplex)
    while generation < generations:
        best, others = simplex[0], [p for p, _ in simplex[1:]]
        moved = lambda k: [tuple(b + k * (b - x) for b, x in zip(best[0], p)) for p in others]  # noqa: E731,B023
        trials = [moved(k) for k in (1.0, expand, -contract)]
        values = objective([p for t in trials for p in t])
        n = len(others)
        mirrored, far, near = (list(zip(t, values[i * n:(i + 1) * n])) for i, t in enumerate(trials))
        least = lambda some: min(v for _, v in some)
        if least(mirrored) < best[1]:
            taken = far if least(far) < least(mirrored) else mirrored
        else:
            taken = near
        last, simplex = best[1], sorted([best, *taken], key=lambda c: c[1])
        generation += 1
        _keep(spark, path, generation, simplex)
        size = max(abs(a - b) for p, _ in simplex[1:] for a, b in zip(p, simplex[0][0]))
        if last - simplex[0][1] <= least_gain and size <= least_gain:
            break
    return simplex[0]


def _keep(spark: SparkSession, path: str | None, generation: int, simplex: list[tuple[Point, float]]) -> None:
    if path:
        spark.createDataFrame([(generation, i, [float(x) for x in p], float(v)) for i, (p, v) in enumerate(simplex)], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def threshold_errors(ridges: DataFrame, flat: DataFrame, save: Callable[[DataFrame, str], DataFrame], sigma: float = images.SIGMA, bright: bool = True) -> Callable[[list[Point]], list[float]]:
    """An objective: for each (low, high), in either order and held within the saliency's range, the mean reconstruction error of the lines that these thresholds give. `ridges` as from ridge_points(), `flat` as from
    without_background(); both written tables. All pairs are traced side by side, as frames of their own."""
    shown = images.saliency(ridges).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("frame").alias("frames")).first()
    if shown.frames is None:
        raise ValueError("there are no images")
    each = shown.frames + 1

    def errors(pairs: list[Point]) -> list[float]:
        held = [(max(min(p), shown.least), min(max(p), shown.most)) for p in pairs]
        trials = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in enumerate(held))))
        mine = lambda df: df.withColumn("_t", trials).withColumn("frame", (F.col("_t.k") * each + F.col("frame")).cast("int"))
        value = F.when(F.col("response") >= F.col("_t.hi"), 2).when(F.col("response") >= F.col("_t.lo"), 1).otherwise(0)
        classed = mine(ridges).withColumn("line_class", F.when(images.near_centre(), value).otherwise(0)).drop("_t")
        lines = save(tracing.trace(classed, bright=bright), "trial-lines")
        found = reconstruction.reconstruction_error(lines, save(mine(flat).drop("_t"), "trial-images"), sigma)
        by_trial = {r.k: r.error for r in found.groupBy(F.floor(F.col("frame") / each).alias("k")).agg(F.avg("error").alias("error")).collect()}  # a row for each pair
        return [by_trial[k] for k in range(len(held))]

    return errors
