"""Operators on curve points: rows (frame, contour, point, x, y, angle, response, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.kernels import bias_table
from .storage import large

CURVE = ["frame", "contour"]


def ordered(*more: str) -> Window:
    return Window.partitionBy(*CURVE, *more).orderBy("point")


def curve_islands(rows: DataFrame, order: str) -> DataFrame:
    """Add set_no and curve_no: a new set starts where frame differs from the row before (by `order`), a new curve where frame or contour does.

    Rows are compared with the row before within blocks of `order`, and the blocks' changes are summed up apart, so that no task sorts the whole table."""
    block = F.floor(F.col(order) / 65536)
    rows = rows.withColumn("_b", block)
    w = Window.partitionBy("_b").orderBy(order)
    ends = rows.groupBy("_b").agg(F.max_by(F.struct("frame", "contour"), order).alias("_last"))
    before = ends.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_prior"))  # a row for each block
    rows = rows.join(before, "_b")
    prior = lambda c: F.coalesce(F.lag(c).over(w), F.col(f"_prior.{c}"))
    new_set = ~F.col("frame").eqNullSafe(prior("frame"))
    new_curve = new_set | ~F.col("contour").eqNullSafe(prior("contour"))
    rows = rows.withColumns({"_s": new_set.cast("long"), "_c": new_curve.cast("long")})
    sums = rows.groupBy("_b").agg(F.sum("_s").alias("_ss"), F.sum("_c").alias("_cc"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_b", F.coalesce(F.sum("_ss").over(upto), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_cc").over(upto), F.lit(0)).alias("_c0"))
    inside = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(base, "_b").withColumns({"set_no": F.col("_s0") + F.sum("_s").over(inside), "curve_no": F.col("_c0") + F.sum("_c").over(inside)})
    return rows.drop("_b", "_prior", "_s", "_c", "_s0", "_c0")


def curve_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy(*CURVE).agg(F.count("*").alias("n_points"))


def labelled(points: DataFrame) -> DataFrame:
    return points.withColumn("label", F.concat(F.lit("contour_f_"), F.col("frame"), F.lit("_c_"), F.col("contour")))


def renumbered(points: DataFrame) -> DataFrame:
    """Curves numbered from 1 in each frame, points from 1 in each curve, without gaps."""
    numbers = points.select(*CURVE).distinct().withColumn("_n", F.row_number().over(Window.partitionBy("frame").orderBy("contour")))
    out = points.join(large(numbers), CURVE).withColumn("point", F.row_number().over(ordered()).cast("int")).withColumn("contour", F.col("_n").cast("int"))
    return out.select(*points.columns)


def with_min_points(points: DataFrame, least: int) -> DataFrame:
    """Curves of at least `least` points."""
    n = F.count("*").over(Window.partitionBy(*CURVE))
    return points.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def oriented_normals(points: DataFrame) -> DataFrame:
    """Normals of a curve on one side: where the middle step of a curve and its normal turn the other way, pi is added to all angles (modulo 2 pi)."""
    w = ordered()
    at = F.row_number().over(w)
    n = F.count("*").over(Window.partitionBy(*CURVE))
    p = points.withColumns({"_at": at, "_n": n, "_dx": F.lead("x").over(w) - F.col("x"), "_dy": F.lead("y").over(w) - F.col("y")})
    cross = F.col("_dx") * F.cos("angle") - F.col("_dy") * F.sin("angle")
    middle = F.col("_at") == F.floor((F.col("_n") - 1) / 2) + F.when(F.col("_n") % 2 == 1, F.lit(0)).otherwise(1)
    turn = F.max(F.when(middle & (F.col("_at") < F.col("_n")), cross)).over(Window.partitionBy(*CURVE))
    angle = F.when(turn < 0, F.pmod(F.col("angle") + math.pi, F.lit(2 * math.pi))).otherwise(F.col("angle"))
    return p.withColumn("angle", angle).drop("_at", "_n", "_dx", "_dy")


def split_at(points: DataFrame, junctions: DataFrame) -> DataFrame:
    """Curves cut at the points named by `junctions` (frame, contour, point), which end one part and start the next. Adds part (from 0). Parts of
    a single point are left out if the curve is cut."""
    cuts = junctions.select(*CURVE, "point").distinct().withColumn("_cut", F.lit(1))
    p = points.join(large(cuts), [*CURVE, "point"], "left").withColumn("_cut", F.coalesce("_cut", F.lit(0)))
    p = p.withColumn("_before", F.coalesce(F.sum("_cut").over(ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = F.when(F.col("_cut") == 1, F.array(F.col("_before"), F.col("_before") + 1)).otherwise(F.array(F.col("_before")))
    p = p.withColumn("part", F.explode(parts)).withColumn("part", F.col("part").cast("int"))
    many = F.max("part").over(Window.partitionBy(*CURVE)) > 0
    size = F.count("*").over(Window.partitionBy(*CURVE, "part"))
    return p.withColumns({"_many": many, "_size": size}).where(~F.col("_many") | (F.col("_size") > 1)).drop("_cut", "_before", "_many", "_size")


def gaps_filled(points: DataFrame, *columns: str) -> DataFrame:
    """Missing values of columns from the nearest known ones of the curve: in between by length along the curve, at the ends the nearest known value. A curve without any stays as it is."""
    w = ordered()
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    p = points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("_len", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_len").alias("s"))) for c in columns}
    p = p.withColumns({f"_a_{c}": F.last(k, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c, k in known.items()} | {f"_z_{c}": F.first(k, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for c, k in known.items()})

    def value(c: str) -> Column:
        a, z = F.col(f"_a_{c}"), F.col(f"_z_{c}")
        share = F.coalesce(F.try_divide(F.col("_len") - a.s, z.s - a.s), F.lit(0.0))
        return F.coalesce(F.col(c), a.v + share * (z.v - a.v), a.v, z.v)

    return p.withColumns({c: value(c) for c in columns}).drop("_step", "_len", *(f"_{k}_{c}" for k in "az" for c in columns))


def true_contrast(response: Column, width: Column, correction: Column, asymmetry: Column, sigma: float, bright: bool = True) -> Column:
    """Contrast of the bar behind a response; 0 for bars of under 0.1 pixels."""
    slope = lambda x: -x / sigma**2 * F.exp(-0.5 * (x / sigma) * (x / sigma)) / (math.sqrt(2 * math.pi) * sigma)
    shown = F.abs(slope(correction + width) + (asymmetry - 1) * slope(correction - width))
    c = F.when(width < 0.1, 0.0).otherwise(F.coalesce(F.try_divide(response, shown), F.lit(0.0)))
    return c if bright else -c


def corrected_widths(points: DataFrame, sigma: float = 1.8, step: tuple[float, float] = (0.1, 0.05)) -> DataFrame:
    """Add width, correction, asymmetry of the bar behind the extracted widths width_l, width_r and gradients grad_l, grad_r: all null where one of these is. correction is
    how far the bar's middle lies along the normal, asymmetry is negative where the left side is the weak one.

    By a table of 41 by 21 bars that is worked out from the model on the driver (861 rows) and read at four corners; outside of it all are 0."""
    spark = points.sparkSession
    table = spark.createDataFrame(bias_rows(), "wi int, ri int, w double, h double, correction double")
    total = (F.col("width_l") + F.col("width_r")) * 1.05 / sigma
    strong = F.greatest("grad_l", "grad_r")
    p = points.withColumns({"_w": total, "_r": F.coalesce(F.try_divide(F.least("grad_l", "grad_r"), strong), F.lit(0.0))})
    p = p.withColumns({"_wi": F.floor((F.col("_w") - 2) / step[0] + 1e-9).cast("int"), "_ri": F.floor(F.col("_r") / step[1] + 1e-9).cast("int")})
    inside = (F.col("_w") >= 2) & (F.col("_w") <= 6)
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    keys = p.where(inside).select("_w", "_r", "_wi", "_ri").distinct().withColumn("_k", corner)
    fw, fr = (F.col("_w") - 2) / step[0] - F.col("_wi"), F.col("_r") / step[1] - F.col("_ri")
    weight = F.when(F.col("_k.a") == 1, fw).otherwise(1 - fw) * F.when(F.col("_k.b") == 1, fr).otherwise(1 - fr)
    keys = keys.select("_w", "_r", F.least(F.col("_wi") + F.col("_k.a"), F.lit(40)).alias("wi"), F.least(F.col("_ri") + F.col("_k.b"), F.lit(20)).alias("ri"), weight.alias("_q"))
    found = keys.join(F.broadcast(table), ["wi", "ri"]).groupBy("_w", "_r").agg(*(F.sum(F.col("_q") * F.col(c)).alias(f"_bar_{c}") for c in ("w", "h", "correction")))
    back = sigma / 1.05
    side = F.when(F.col("grad_l") >= F.col("grad_r"), -1.0).otherwise(1.0)
    bar = lambda c: F.when(F.col("_w").isNotNull() & strong.isNotNull(), F.coalesce(F.col(f"_bar_{c}"), F.lit(0.0)))
    out = p.join(large(found), ["_w", "_r"], "left").withColumns({"width": bar("w") * back, "asymmetry": -side * bar("h"), "correction": side * bar("correction") * back})
    return out.drop("_w", "_r", "_wi", "_ri", "_bar_w", "_bar_h", "_bar_correction")


def polylines(points: DataFrame, colours: int = 8) -> DataFrame:
    """frame, contour, colour, n_points, path (ordered array of x, y): one drawable line per curve."""
    path = F.transform(F.sort_array(F.collect_list(F.struct("point", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    return points.groupBy(*CURVE).agg(F.count("*").alias("n_points"), path.alias("path")).withColumn("colour", F.col("contour") % colours)


def mean_widths(points: DataFrame, width: str = "width", good: Column | None = None) -> DataFrame:
    """frame, contour, mean_width over the points that are good (all with a width, by default)."""
    return points.groupBy(*CURVE).agg(F.avg(F.when(F.lit(True) if good is None else good, F.col(width))).alias("mean_width"))


def borders(points: DataFrame, width: Column) -> DataFrame:
    """Add x_left, y_left, x_right, y_right: `width` to either side along the normal (sin a, cos a)."""
    nx, ny = F.sin("angle"), F.cos("angle")
    return points.withColumns({"x_left": F.col("x") - width * nx, "y_left": F.col("y") - width * ny, "x_right": F.col("x") + width * nx, "y_right": F.col("y") + width * ny})


def bias_rows() -> list[tuple[int, int, float, float, float]]:
    """(width step, ratio step, half width, asymmetry, correction) of the bias table."""
    table = bias_table()
    return [(i, j, *map(float, table[i, j, :3])) for i in range(table.shape[0]) for j in range(table.shape[1])]


def corrected_lines(points: DataFrame, sigma: float = 1.8) -> DataFrame:
    """Lines with their bias removed: x and y move along the normal by the correction, width_l and width_r become the bar's half width. Adds correction, asymmetry, contrast
    (of the bar, from the response). Gaps of widths and gradients are filled before, those of the results after. An end that stands on a junction (`line_class`) stays where it is."""
    p = gaps_filled(points, "width_l", "grad_l", "width_r", "grad_r")
    p = gaps_filled(corrected_widths(p, sigma), "width", "correction", "asymmetry")
    w = ordered()
    first, last = F.lag("point").over(w).isNull(), F.lead("point").over(w).isNull()
    fixed = first & F.col("line_class").isin("start_junc", "both_junc") | last & F.col("line_class").isin("end_junc", "both_junc")
    p = p.withColumns({"_fixed": fixed, "width": F.coalesce("width", F.lit(0.0)), "asymmetry": F.coalesce("asymmetry", F.lit(0.0))})
    shift = F.when(F.col("_fixed"), 0.0).otherwise(F.coalesce("correction", F.lit(0.0)))
    p = p.withColumn("correction", shift)
    contrast = true_contrast(F.col("response"), F.col("width"), F.abs("correction"), F.abs("asymmetry"), sigma)
    return p.withColumns({
        "x": F.col("x") + F.col("correction") * F.sin("angle"), "y": F.col("y") + F.col("correction") * F.cos("angle"), "width_l": F.col("width"), "width_r": F.col("width"), "contrast": contrast,
    }).drop("_fixed", "width")
