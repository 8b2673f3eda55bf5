"""Least squares over groups of any size: a group's points are only ever added up, never gathered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import large

DAMPING = 1e-3
#: Share of chi2 by which an undamped step seems to lower it, beyond which a search hasn't ended at a best fit.
UNSETTLED = 1e-6


def _sums(slopes: list[Column], rest: Column, weight: Column) -> list[Column]:
    """The upper triangle of the normal matrix, its right side, chi square and the number of points, as partial aggregates."""
    k = len(slopes)
    h = [F.sum(weight * slopes[i] * slopes[j]) for i in range(k) for j in range(i, k)]
    return [F.array(*h).alias("_h"), F.array(*(F.sum(weight * s * rest) for s in slopes)).alias("_g"), F.sum(weight * rest * rest).alias("_chi"), F.count(rest).alias("_n")]


def _matrices(h: pd.Series, k: int) -> np.ndarray:
    out = np.zeros((len(h), k, k))
    upper = np.triu_indices(k)
    if len(h):
        flat = np.array(h.tolist(), "float64").reshape(len(h), -1)
        out[:, upper[0], upper[1]] = flat
        out[:, upper[1], upper[0]] = flat
    return out


def _solved(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solutions of small systems, scaled to a unit diagonal; least squares of least length where one is singular."""
    scale = np.sqrt(np.abs(np.diagonal(h, axis1=1, axis2=2)))
    scale = np.where(scale > 0, scale, 1)
    scaled, right = h / scale[:, :, None] / scale[:, None, :], g / scale
    out = np.zeros_like(g)
    fine = np.isfinite(scaled).all((1, 2)) & np.isfinite(right).all(1)
    out[~fine] = np.nan
    sound = fine.copy()
    sound[fine] = np.linalg.cond(scaled[fine]) < 1e13
    if sound.any():
        out[sound] = np.linalg.solve(scaled[sound], right[sound][..., None])[..., 0]
    for i in np.flatnonzero(fine & ~sound):
        out[i] = np.linalg.lstsq(scaled[i], right[i], rcond=1e-12)[0]
    return out / scale


def _usable(weight: Column | None) -> Column:
    """Points whose weight is null, not a number or negative take no part."""
    if weight is None:
        return F.lit(1.0)
    w = weight.cast("double")
    return F.when((w >= 0) & ~F.isnan(w), w)


def linear_fit(df: DataFrame, keys: list[str], y: Column, terms: list[Column], weight: Column | None = None) -> DataFrame:
    """keys, a, chi2, n, for each group: the parameters a of y = a[0] terms[0] + a[1] terms[1] + ... with the least weighted sum of squares chi2, over the n points whose y, terms and weight are there. With fewer points than
    parameters, or terms that depend on one another, a is the shortest of the best, in units of the inverse sizes of the terms. One shuffle, of sums."""
    k, w = len(terms), _usable(weight)
    fine = y.isNotNull() & w.isNotNull()
    for t in terms:
        fine = fine & t.isNotNull()
    sums = df.where(fine).groupBy(*keys).agg(*_sums([t.cast("double") for t in terms], y.cast("double"), w))

    @F.pandas_udf("a array<double>, chi2 double")
    def solve(h: pd.Series, g: pd.Series, chi: pd.Series) -> pd.DataFrame:
        m, right = _matrices(h, k), np.array(g.tolist(), "float64").reshape(len(g), k)
        a = _solved(m, right)
        rest = chi.to_numpy() - 2 * (a * right).sum(1) + np.einsum("ni,nij,nj->n", a, m, a)
        return pd.DataFrame({"a": list(a), "chi2": np.maximum(rest, 0)})

    return sums.withColumn("_fit", solve("_h", "_g", "_chi")).select(*keys, F.col("_fit.a").alias("a"), F.col("_fit.chi2").alias("chi2"), F.col("_n").alias("n"))


def nonlinear_fit(df: DataFrame, keys: list[str], y: Column, model: Callable[[list[Column]], Column], slopes: Callable[[list[Column]], list[Column]], start: DataFrame, save: Callable[[DataFrame, str], DataFrame],
                  weight: Column | None = None, steps: int = 50, least_gain: float = 1e-9) -> DataFrame:
    """keys, a, chi2, n, steps, for each group of `start` (keys, a: the first parameters): Levenberg-Marquardt over any number of points with any number of coordinates.

    `model` and `slopes` make, of the parameters as Columns, the model's value and its derivatives from the points' own columns. Every step is one job for all groups: it adds up the normal
    matrices at the trial parameters, and what is better than before is kept. A group is done when a better step lowers its chi2 by no more than `least_gain` of it, when damping has grown past 1e12, or after
    `steps` steps; its parameters are then left alone. Where an undamped step still promises to lower chi2 by over UNSETTLED of it, a search hasn't ended at a best fit, but, say, where a factor of others
    would have to pass 0: such groups are searched again from `start` with the sign of each parameter turned, and of all of them, and the best end counts. Groups whose first chi2 isn't a number, or that have no points, get nulls."""
    names = [f.name for f in start.schema.fields]
    if sorted(names) != sorted([*keys, "a"]):
        raise ValueError("start has the keys and a")
    w = _usable(weight)
    width = start.select(F.max(F.size("a"))).first()[0] or 0
    blank = "cast(null as array<double>)"
    fresh = lambda df: save(df.select(*keys, F.col("a").cast("array<double>").alias("_trial"), F.expr(f"{blank} as a"), F.expr(f"{blank} as _bh"), F.expr(f"{blank} as _bg"), F.lit(None).cast("double").alias("chi2"),
                              F.lit(DAMPING).alias("_damping"), F.lit(None).cast("bigint").alias("n"), F.lit(0).alias("steps"), F.lit(False).alias("_done"), F.col("_try"), F.lit(None).cast("double").alias("_gap")), "fits")
    kept = "a array<double>, _bh array<double>, _bg array<double>, chi2 double, _damping double, _trial array<double>, _done boolean, _gap double"

    @F.pandas_udf(kept)
    def turn(a: pd.Series, bh: pd.Series, bg: pd.Series, chi2: pd.Series, damping: pd.Series, trial: pd.Series, h: pd.Series, g: pd.Series, chi: pd.Series) -> pd.DataFrame:
        out = []
        for a0, h0, g0, c0, d, t, h1, g1, c1 in zip(a, bh, bg, chi2, damping, trial, h, g, chi):
            first = a0 is None
            finite = h1 is not None and c1 is not None and np.isfinite(c1) and np.isfinite(np.asarray(h1, float)).all() and np.isfinite(np.asarray(g1, float)).all()
            done = False
            if finite and (first or c1 < c0):
                done = not first and c0 - c1 <= least_gain * c0
                a0, h0, g0, c0, d = t, h1, g1, c1, d / 10
            elif first:
                out.append((None, None, None, None, d, t, True, None))
                continue
            else:
                d *= 10
                done = d > 1e12
            m = _matrices(pd.Series([h0]), width)
            gap = float(np.dot(_solved(m, np.array([g0], float))[0], np.asarray(g0, float)))  # what an undamped step seems to gain
            i = np.arange(width)
            m[0, i, i] *= 1 + d
            step = _solved(m, np.array([g0], float))[0]
            done = done or not np.isfinite(step).all() or c0 == 0
            out.append((a0, h0, g0, c0, d, np.asarray(a0, float) + np.where(np.isfinite(step), step, 0), done, gap / c0 if c0 > 0 else 0.0))
        return pd.DataFrame(out, columns=["a", "_bh", "_bg", "chi2", "_damping", "_trial", "_done", "_gap"])

    p, own = [F.col("_trial")[i] for i in range(width)], [*keys, "_try"]

    def settled(state: DataFrame) -> DataFrame:
        for _ in range(steps + 1):
            active = state.where(~F.col("_done"))
            if active.isEmpty():
                break
            points = df.join(active.select(*own, "_trial"), keys).where(y.isNotNull() & w.isNotNull())
            sums = points.groupBy(*own).agg(*_sums(slopes(p), y.cast("double") - model(p), w))
            new = active.drop("n").join(sums.withColumnRenamed("_n", "n"), own, "left")
            new = new.withColumn("_t", turn("a", "_bh", "_bg", "chi2", "_damping", "_trial", "_h", "_g", "_chi"))
            new = new.select(*keys, "_t._trial", "_t.a", "_t._bh", "_t._bg", "_t.chi2", "_t._damping", "n", (F.col("steps") + 1).alias("steps"), "_t._done", "_try", "_t._gap")
            state = save(new.unionByName(state.where("_done")), "fits")
        return state

    state = settled(fresh(start.withColumn("_try", F.lit(0))))
    unsettled = state.where((F.col("_gap") > UNSETTLED) | F.isnan("_gap"))
    if not unsettled.isEmpty():
        turned = lambda f: F.transform("a", lambda v, i: F.when(f(i), -v).otherwise(v))
        starts = [*(turned(lambda i, k=k: i == k) for k in range(width)), turned(lambda i: i >= 0)]
        again = start.join(large(unsettled.select(*keys)), keys).withColumn("_s", F.explode(F.array(*(F.struct(F.lit(k).alias("_try"), a.alias("a")) for k, a in enumerate(starts, 1)))))
        state = state.unionByName(settled(fresh(again.select(*keys, "_s.a", "_s._try"))))
        state = state.groupBy(*keys).agg(F.min_by(F.struct("a", "chi2", "n", "steps"), F.struct(F.col("chi2").isNull(), "chi2", "_try")).alias("b")).select(*keys, "b.*")
    return state.select(*keys, "a", "chi2", "n", "steps")
