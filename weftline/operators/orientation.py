"""Line and orientation filters over images."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions.kernels import line_offsets
from .tiles import TILE, map_tiles

RADIUS = 10
ANGLES = 20


def _shifted(a: np.ndarray, dx: int, dy: int, halo: int) -> np.ndarray:
    rows, cols = a.shape[0] - 2 * halo, a.shape[1] - 2 * halo
    return a[halo - dy:halo - dy + rows, halo + dx:halo + dx + cols]


def line_filter(pixels: DataFrame, radius: int = RADIUS, angles: int = ANGLES, tile: int = TILE) -> DataFrame:
    """frame, y, x, response, orientation: the largest mean of the values along a line through the pixel, and that line's angle (the first
    of equals). Offsets beyond the image are skipped; both are 0 where no sum is positive. Rows grow downwards, angles are measured upwards."""
    offsets = line_offsets(radius, angles)

    def work(p):
        v = p["v"]
        best, turn = np.zeros(tuple(s - 2 * radius for s in v.shape)), np.zeros(tuple(s - 2 * radius for s in v.shape))
        for k in range(angles):
            total = sum(_shifted(v, dx, dy, radius) for a, _, dx, dy in offsets if a == k)
            better = total > best
            best, turn = np.where(better, total, best), np.where(better, -math.pi / 2 + k * math.pi / angles, turn)
        return {"response": best / (2 * radius + 1), "orientation": turn}

    return map_tiles(pixels, ["v"], radius, work, "response double, orientation double", mirror=False, tile=tile)


def orientation_filter(lines: DataFrame, radius: int = RADIUS, angles: int = ANGLES, tile: int = TILE) -> DataFrame:
    """frame, y, x, v: over the result of line_filter(), the largest sum along a line of the pixel's response by the cosine of twice the gap between
    each neighbour's orientation and the line's; at least 0."""
    offsets = line_offsets(radius, angles)

    def work(p):
        inside, cos2, sin2 = p["_in"], np.cos(2 * p["orientation"]) * p["_in"], np.sin(2 * p["orientation"]) * p["_in"]
        own = p["response"][radius:inside.shape[0] - radius, radius:inside.shape[1] - radius]
        best = np.zeros(own.shape)
        for k in range(angles):
            turn = 2 * (-math.pi / 2 + k * math.pi / angles)
            c = sum(_shifted(cos2, dx, dy, radius) for a, _, dx, dy in offsets if a == k)
            s = sum(_shifted(sin2, dx, dy, radius) for a, _, dx, dy in offsets if a == k)
            best = np.maximum(best, own * (math.cos(turn) * c + math.sin(turn) * s))
        return {"v": best}

    from pyspark.sql import functions as F

    return map_tiles(lines.withColumn("_in", F.lit(1.0)), ["response", "orientation", "_in"], radius, work, "v double", mirror=False, tile=tile)


def orientation_vote(pixels: DataFrame, radius: int = RADIUS, angles: int = ANGLES, compat: bool = False, tile: int = TILE) -> DataFrame:
    """frame, y, x, v: each pixel's line means vote for those of its neighbours along every line, less with distance and with the gap between
    the line's angle and the vote's. A pixel's mean over its angles is taken off first; with `compat`, `angles` times from the first angle only."""
    offsets = line_offsets(radius, angles)
    at = -math.pi / 2 + np.arange(angles) * math.pi / angles
    gap = np.arccos(np.clip(np.abs(np.cos(at[:, None] - at[None])), 0, 1))
    vote = np.exp(-((gap / (1.41 * 0.26)) ** 2))

    def work(p):
        v, inside = p["v"], p["_in"]
        wide = tuple(s - 2 * radius for s in v.shape)
        cube = np.stack([sum(_shifted(v, dx, dy, radius) for a, _, dx, dy in offsets if a == k) for k in range(angles)]) / (2 * radius + 1)
        mean = cube.mean(0)
        if compat:
            cube[0] -= angles * mean
        else:
            cube -= mean
        cube *= inside[radius:inside.shape[0] - radius, radius:inside.shape[1] - radius]
        rows, cols = wide[0] - 2 * radius, wide[1] - 2 * radius
        own = np.maximum(cube[:, radius:radius + rows, radius:radius + cols], 0)
        out = np.zeros((rows, cols))
        for k in range(angles):
            near = np.zeros((angles, rows, cols))
            for a, q, dx, dy in offsets:
                if a == k and q:
                    near += abs(q) ** -0.1 * cube[:, radius - dy:radius - dy + rows, radius + dx:radius + dx + cols]
            out += (vote[k][:, None, None] * own * near).sum(0)
        return {"v": out}

    from pyspark.sql import functions as F

    return map_tiles(pixels.withColumn("_in", F.lit(1.0)), ["v", "_in"], 2 * radius, work, "v double", mirror=False, tile=tile)
