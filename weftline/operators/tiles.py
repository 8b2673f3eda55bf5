"""Numpy work on image neighbourhoods, tile by tile.

Pixels are dealt to tiles by (frame, tile row, tile column); each tile also gets the pixels around it that its stencil needs, so a
task holds one tile at a time, however large the image. One shuffle serves any number of filters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 256
#: Points that are worked on in one task.
POINTS = 50_000


def map_tiles(pixels: DataFrame, columns: list[str], halo: int, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: str, mirror: bool = True, tile: int = TILE, small: bool = False) -> DataFrame:
    """frame, y, x and the columns of `out` (a schema, "name type, ..."; integers or doubles).

    `work` gets an array for each of `columns`, `halo` wider than the tile on every side, and returns arrays of the tile's own size. Beyond the
    image, values are mirrored (the edge itself isn't repeated), or 0 without `mirror`. Missing pixels are 0. With `mirror`, an image must be larger than the halo,
    unless it may be `small`: it is mirrored once at each border then, and what lies beyond its mirror images is 0.
    """
    sizes = pixels.groupBy("frame").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    span = lambda c, most: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile)).cast("int"), F.least(F.floor((F.col(most) - 1) / tile), F.floor((F.col(c) + halo) / tile)).cast("int"))
    dealt = pixels.select("frame", "y", "x", *(F.col(c).cast("double").alias(c) for c in columns)).join(sizes, "frame").withColumn("_ty", F.explode(span("y", "_h"))).withColumn("_tx", F.explode(span("x", "_w")))
    names = [c.split()[0] for c in out.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        h, w, ty, tx, frame = (int(table.column(c)[0].as_py()) for c in ("_h", "_w", "_ty", "_tx", "frame"))
        top, left = ty * tile, tx * tile
        rows, cols = min(tile, h - top), min(tile, w - left)
        if mirror and not small and (h <= halo or w <= halo):
            raise ValueError(f"frame {frame} is {w} by {h} pixels; the filter reaches {halo} pixels")
        y0, y1, x0, x1 = max(0, top - halo), min(h, top + rows + halo), max(0, left - halo), min(w, left + cols + halo)
        pad = ((y0 - top + halo, top + rows + halo - y1), (x0 - left + halo, left + cols + halo - x1))
        y, x = get("y"), get("x")
        planes = {}
        for c in columns:
            plane = np.zeros((y1 - y0, x1 - x0))
            plane[y - y0, x - x0] = table.column(c).fill_null(0).to_numpy()
            if mirror:
                once = tuple((min(before, n - 1), min(after, n - 1)) for (before, after), n in zip(pad, plane.shape))
                plane = np.pad(plane, once, mode="reflect")
                planes[c] = np.pad(plane, [(b - o, a - p) for (b, a), (o, p) in zip(pad, once)])
            else:
                planes[c] = np.pad(plane, pad)
        found = work(planes)
        there = (y >= top) & (y < top + rows) & (x >= left) & (x < left + cols)
        y, x = y[there], x[there]
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        values = [pa.array(found[c.split()[0]][y - top, x - left], kinds[c.split()[1]], from_pandas=True) for c in out.split(", ")]
        return pa.table([pa.array(np.full(len(y), frame, "i4")), pa.array(y.astype("i4")), pa.array(x.astype("i4")), *values], ["frame", "y", "x", *names])

    return dealt.groupBy("frame", "_ty", "_tx").applyInArrow(run, f"frame int, y int, x int, {out}")


def at_points(points: DataFrame, pixels: DataFrame, columns: list[str], ids: list[str], reach: int, work: Callable[..., dict[str, np.ndarray]], out: str, tile: int = TILE, many: int = POINTS, fill: float = np.nan) -> DataFrame:
    """The points (frame, x, y, angle, ...) with the columns of `out` (doubles, or arrays of them) that `work` finds for them in the image around them; null where x, y or angle are missing.

    Points are dealt once, to tiles, with all their columns; each tile gets the pixels that lie up to `reach` around it, and a tile with over `many` points is dealt to several tasks by the hash of `ids`.
    `work` gets y, x, angle and an array for each of `columns` with the top row's and left column's numbers; pixels that aren't there are `fill`."""
    at = lambda c: F.coalesce(F.floor(F.col(c) / tile).cast("int"), F.lit(0))
    key = ["frame", "_ty", "_tx"]
    named = points.withColumns({"_ty": at("y"), "_tx": at("x")})
    parts = named.groupBy(*key).agg(F.ceil(F.count("*") / many).cast("int").alias("_parts"))  # a row for each tile
    named = named.join(F.broadcast(parts), key, "left").withColumn("_part", F.pmod(F.xxhash64(*ids), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile).cast("int"), F.floor((F.col(c) + reach) / tile).cast("int")))
    dealt = pixels.select(F.col("frame").alias("_frame"), F.col("y").alias("_y"), F.col("x").alias("_x"), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns))).withColumn("_ty", span("_y")).withColumn("_tx", span("_x"))
    dealt = dealt.join(F.broadcast(parts.withColumnRenamed("frame", "_frame")), ["_frame", "_ty", "_tx"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    kept, fields = points.columns, [f.split(" ", 1) for f in out.split(", ")]

    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        found = own.select(kept)
        if not own.num_rows:
            for name, kind in fields:
                found = found.append_column(name, pa.array([], pa.list_(pa.float64()) if kind.startswith("array") else pa.float64()))
            return found
        top, left = own.column("_ty")[0].as_py() * tile - reach, own.column("_tx")[0].as_py() * tile - reach
        planes = {}
        for i, c in enumerate(columns):
            planes[c] = np.full((tile + 2 * reach + 2, tile + 2 * reach + 2), fill)
            if near.num_rows:
                planes[c][near.column("_y").to_numpy() - top, near.column("_x").to_numpy() - left] = near.column(f"_v{i}").fill_null(fill).to_numpy()
        y, x, angle = (own.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("y", "x", "angle"))
        fine = np.isfinite(y) & np.isfinite(x) & np.isfinite(angle)
        values = work(y[fine], x[fine], angle[fine], planes, top, left)
        for name, kind in fields:
            v = values[name]
            whole = np.full((own.num_rows, *v.shape[1:]), np.nan)
            whole[fine] = v
            if kind.startswith("array"):
                offsets = pa.array(np.arange(0, whole.size + 1, whole.shape[1], dtype="i4"), mask=np.append(~fine, False))
                found = found.append_column(name, pa.ListArray.from_arrays(offsets, pa.array(whole.ravel())))
            else:
                found = found.append_column(name, pa.array(whole, from_pandas=True))
        return found

    added = [T.StructField(name, T.ArrayType(T.DoubleType()) if kind.startswith("array") else T.DoubleType()) for name, kind in fields]
    return named.groupBy(*key, "_part").cogroup(dealt.groupBy("_frame", "_ty", "_tx", "_part")).applyInArrow(run, T.StructType([*points.schema.fields, *added]))


def correlate(a: np.ndarray, mask: tuple[float, ...], axis: int, halo: int) -> np.ndarray:
    """Sum of mask[j] times the value at offset j - n along an axis; the result is `halo` narrower on both sides of that axis."""
    n, size = len(mask) // 2, a.shape[axis] - 2 * halo
    out = 0
    for j, m in enumerate(mask):
        at = [slice(None)] * 2
        at[axis] = slice(halo + j - n, halo + j - n + size)
        out = out + m * a[tuple(at)]
    return out
