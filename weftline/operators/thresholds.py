"""Automatic thresholds of images from their histograms, one frame a row. A threshold is the upper edge of a bin. Frames whose pixels all share a bin get the upper edge of that bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .images import histogram

#: Steps after which a threshold that doesn't settle is taken as it is.
STEPS = 64


def _edges(found: DataFrame) -> DataFrame:
    return found.select("frame", (F.col("least") + F.col("width") * (F.col("bin") + 1)).alias("threshold"))


def _with_means(h: DataFrame) -> DataFrame:
    """Add m0 and m1, the mean bins up to a bin and above it (null for the last one), and next, the next bin that has pixels."""
    upto, every = Window.partitionBy("frame").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("frame")
    n, s = F.col("n").cast("double"), F.col("n").cast("double") * F.col("bin")
    h = h.withColumns({"_n": F.sum(n).over(upto), "_s": F.sum(s).over(upto), "_all_n": F.sum(n).over(every), "_all_s": F.sum(s).over(every), "next": F.lead("bin").over(Window.partitionBy("frame").orderBy("bin"))})
    return h.withColumns({"m0": F.col("_s") / F.col("_n"), "m1": F.try_divide(F.col("_all_s") - F.col("_s"), F.col("_all_n") - F.col("_n"))}).drop("_n", "_s", "_all_n", "_all_s")


def huang_threshold(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """frame, threshold: the bin that makes the image least fuzzy. A pixel belongs to its side of the threshold by 1 / (1 + distance from the side's mean / range), and
    the fuzziness is the sum of the entropies of these memberships. Of equals the first one."""
    h = _with_means(histogram(pixels, bins))
    every = Window.partitionBy("frame")
    h = h.withColumns({"_bins": F.collect_list(F.struct("bin", "n")).over(every), "_span": (F.max("bin").over(every) - F.min("bin").over(every)).cast("double")})

    def fuzziness(b: Column) -> Column:
        mean = F.when(b["bin"] <= F.col("bin"), F.col("m0")).otherwise(F.col("m1"))
        u = 1 / (1 + F.abs(b["bin"] - mean) / F.col("_span"))
        return F.when((u > 1e-6) & (u < 1 - 1e-6), b["n"] * (-u * F.ln(u) - (1 - u) * F.ln(1 - u))).otherwise(0.0)

    # a sum over at most `bins` bins for each of at most as many thresholds
    total = F.when(F.col("m1").isNotNull(), F.aggregate("_bins", F.lit(0.0), lambda a, b: a + fuzziness(b)))
    h = h.withColumn("_fuzzy", F.round(total, 9))
    return _edges(h.groupBy("frame").agg(F.min_by(F.struct("bin", "least", "width"), F.struct(F.col("_fuzzy").isNull(), "_fuzzy", "bin")).alias("b")).select("frame", "b.*"))


def intermeans_threshold(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """frame, threshold: the first bin that lies above the middle between the mean bins of its two sides, as a rounded number. A most frequent bin of over twice the next one's pixels counts as
    1.5 times these (rounded down)."""
    h = histogram(pixels, bins)
    order = Window.partitionBy("frame").orderBy(F.desc("n"), "bin")
    h = h.withColumns({"_place": F.row_number().over(order), "_second": F.lead("n").over(order)})
    h = h.withColumn("n", F.when((F.col("_place") == 1) & (F.col("n") > 2 * F.col("_second")), F.floor(F.col("_second") * 1.5)).otherwise(F.col("n")))
    h = _with_means(h).withColumn("_middle", (F.col("m0") + F.col("m1")) / 2)
    fits = F.coalesce(F.col("next") > F.col("_middle"), F.lit(False))
    found = h.groupBy("frame", "least", "width").agg(F.min_by(F.when(fits, F.floor(F.col("_middle") + 0.5)).otherwise(F.col("bin")), F.struct(~fits, "bin")).alias("bin"))
    return _edges(found)


def minimum_error_threshold(pixels: DataFrame, bins: int = 256, steps: int = STEPS) -> DataFrame:
    """frame, threshold: where two normal laws, of the moments of the two sides of the threshold, are equally likely; repeated from the mean bin until it stays, or as it is after
    `steps` steps. It also stays where a side has no pixels or no spread, or the laws don't meet."""
    h = histogram(pixels, bins)
    per = h.groupBy("frame", "least", "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col("n").cast("double")))).alias("_of"))
    per = per.withColumn("_h", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(b.alias("b"), F.coalesce(F.col("_of")[b], F.lit(0.0)).alias("n"))))
    zero = F.array().cast("array<struct<n:double,s:double,q:double>>")

    def add(sums: Column, b: Column) -> Column:
        old = F.coalesce(F.try_element_at(sums, F.lit(-1)), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")))
        return F.concat(sums, F.array(F.struct((old["n"] + b["n"]).alias("n"), (old["s"] + b["n"] * b["b"]).alias("s"), (old["q"] + b["n"] * b["b"] * b["b"]).alias("q"))))

    per = per.withColumn("_sums", F.aggregate("_h", zero, add)).withColumn("_all", F.element_at("_sums", -1))
    whole = F.col("_all")

    def step(t: Column) -> Column:
        low = F.element_at("_sums", t + 1)
        n0, n1 = low["n"], whole["n"] - low["n"]
        m0, m1 = F.try_divide(low["s"], n0), F.try_divide(whole["s"] - low["s"], n1)
        v0, v1 = F.try_divide(low["q"], n0) - m0 * m0, F.try_divide(whole["q"] - low["q"], n1) - m1 * m1
        p, q = n0 / whole["n"], n1 / whole["n"]
        w0 = F.try_divide(F.lit(1.0), v0) - F.try_divide(F.lit(1.0), v1)
        w1 = F.try_divide(m0, v0) - F.try_divide(m1, v1)
        w2 = F.try_divide(m0 * m0, v0) - F.try_divide(m1 * m1, v1) + F.ln(F.try_divide(v0 * q * q, v1 * p * p))
        root = w1 * w1 - w0 * w2
        new = F.floor(F.try_divide(w1 + F.sqrt(root), w0))
        fine = (v0 > 0) & (v1 > 0) & (root >= 0) & (new >= 0) & (new < bins)
        return F.when(F.coalesce(fine, F.lit(False)), new.cast("int")).otherwise(t)

    start = F.floor(whole["s"] / whole["n"]).cast("int")
    per = per.withColumn("bin", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda t, _: step(t)))
    return _edges(per)
