"""Tracing of ridge lines on images, frame by frame.

A frame's lines depend on one another (a pixel belongs to the first line that takes it), so a task traces one frame and holds its planes; frames run in
parallel. One pass gives both lines and junctions: write traced() once, then take lines_of() and junctions_of() from it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


#: Neighbours whose normal turns less than this from the step's are one and the same response.
SAME_RESPONSE = math.pi / 6

LINES = "frame int, contour int, point int, x double, y double, angle double, response double, line_class string"
TRACED = LINES + ", contour2 int"
JUNCTIONS = "frame int, contour1 int, contour2 int, point int, x double, y double"


class Plane:
    """One frame's ridge values as arrays over (row, column)."""

    def __init__(self, pdf: pd.DataFrame):
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        at = (pdf["y"].to_numpy(), pdf["x"].to_numpy())
        self.shape = (h, w)
        for name, fill in (("response", 0.0), ("ny", 0.0), ("nx", 1.0), ("py", np.nan), ("px", np.nan), ("r", 0.0), ("c", 0.0), ("line_class", 0)):
            a = np.full((h, w), fill, "int64" if name == "line_class" else "float64")
            a[at] = pdf[name].fillna(fill).to_numpy()
            setattr(self, name, a)

    def normal(self, y: int, x: int) -> float:
        return math.atan2(self.nx[y, x], self.ny[y, x])

    def facet_response(self, y: int, x: int) -> float:
        """The response at the pixel's line point, by the quadratic that fits its 3 by 3 neighbourhood best (mirrored at the border)."""
        if min(self.shape) < 2:
            return self.response[y, x]
        rows, cols = ([abs(i - 1), i, n - 2 if i + 1 == n else i + 1] for i, n in ((y, self.shape[0]), (x, self.shape[1])))
        z = self.response[np.ix_(rows, cols)]
        u, v = self.py[y, x] - y, self.px[y, x] - x
        by_row, by_col, all_ = z.sum(1), z.sum(0), z.sum()
        flat = (5 * all_ - 3 * (by_row[0] + by_row[2]) - 3 * (by_col[0] + by_col[2])) / 9
        drr, dcc = (all_ - 3 * by_row[1]) / 6, (all_ - 3 * by_col[1]) / 6
        drc = (z[0, 0] - z[0, 2] - z[2, 0] + z[2, 2]) / 4
        return flat + (u * (by_row[2] - by_row[0]) + v * (by_col[2] - by_col[0])) / 6 + u * u * drr + u * v * drc + v * v * dcc

    def inside(self, y: int, x: int) -> bool:
        return 0 <= y < self.shape[0] and 0 <= x < self.shape[1]


def _turn(a: float, b: float) -> float:
    """The unsigned difference of two axes."""
    d = abs(a - b) % math.pi
    return min(d, math.pi - d)


def _suppress(p: Plane, taken: np.ndarray, y: int, x: int, heading: float, label: int) -> list[tuple[int, int, int]]:
    """Pixels on both sides of a line that respond to the same line now belong to it; returns them with their former labels."""
    was = []
    for k in (-2, 2):
        a = (round(heading / (math.pi / 4)) + k) * math.pi / 4
        v, u = y + round(math.sin(a)), x + round(math.cos(a))
        if p.inside(v, u) and p.line_class[v, u] and _turn(math.atan2(p.nx[v, u], -p.ny[v, u]), heading) < SAME_RESPONSE:
            was.append((v, u, taken[v, u]))
            taken[v, u] = label
    return was


def _walk(p: Plane, taken: np.ndarray, y: int, x: int, heading: float, label: int) -> tuple[list[tuple[int, int]], int]:
    """Pixels that follow (y, x) along a heading, and the label that the last of them had before: 0, or that of the line (maybe this one) at which the walk ends."""
    found = []
    while True:
        octant = round(heading / (math.pi / 4))
        best, ty, tx, own = None, p.py[y, x], p.px[y, x], p.normal(y, x)
        for k in (-1, 0, 1):
            a = (octant + k) * math.pi / 4
            v, u = y + round(math.sin(a)), x + round(math.cos(a))
            if not p.inside(v, u) or not p.line_class[v, u]:
                continue
            cost = math.hypot(p.py[v, u] - ty, p.px[v, u] - tx) + _turn(p.normal(v, u), own)
            if best is None or cost < best[0]:
                best = (cost, v, u)
        _suppress(p, taken, y, x, heading, label)
        if best is None:
            return found, 0
        _, y, x = best
        found.append((y, x))
        if taken[y, x]:
            return found, int(taken[y, x])
        taken[y, x] = label
        # the tangent (nx along rows, -ny along columns) nearer to the way it came
        t = math.atan2(p.nx[y, x], -p.ny[y, x])
        heading = t + math.pi if math.cos(t - heading) < 0 else t


def _nearest(line: dict, y: float, x: float) -> tuple[int, float]:
    d = np.hypot(np.array(line["y"]) - y, np.array(line["x"]) - x)
    return int(d.argmin()), float(d.min())


def trace_plane(p: Plane) -> tuple[list[dict], list[tuple[int, int, int, float, float]]]:
    """Lines (dicts of pixels, y, x, angle, response, kind) and junctions (line that has the point, line that ends there, point, y, x), in the order they are found.

    A walk that meets a pixel of another line ends on that line: on the very point, or, where the pixel only responds to the same line, on the nearest point of it. It makes a
    junction unless that point is an end. A walk that meets its own line closes it at its start and makes a junction with itself elsewhere."""
    taken = np.zeros(p.shape, "int64")
    ys, xs = np.nonzero(p.line_class == 2)
    seeds = sorted(zip(-np.abs(p.response[ys, xs]), ys.tolist(), xs.tolist()))
    lines: list[dict] = []
    junctions = []
    for _, y, x in seeds:
        if taken[y, x]:
            continue
        label = len(lines) + 1
        taken[y, x] = label
        tangent = math.atan2(p.nx[y, x], -p.ny[y, x])
        beside = _suppress(p, taken, y, x, tangent, label)
        back, end1 = _walk(p, taken, y, x, tangent + math.pi, label)
        closed = end1 == label and back[-1] == (y, x)
        forth, end2 = ([], 0) if closed else _walk(p, taken, y, x, tangent, label)
        pixels = back[::-1] + [(y, x)] + forth
        if len(pixels) < 2:
            for v, u, before in beside:
                taken[v, u] = before
            taken[y, x] = 0
            continue
        py, px, response = [p.py[a] for a in pixels], [p.px[a] for a in pixels], [p.facet_response(*a) for a in pixels]
        angle = [p.normal(*a) % (2 * math.pi) for a in pixels]
        made: list[bool] = []
        for first, hit in ((True, end1), (False, end2)):
            if not hit or closed:
                continue
            at = 0 if first else len(py)
            end = 0 if first else -1
            if hit == label:
                again = [k for k, a in enumerate(pixels) if a == pixels[end]]
                point = again[-1] if first else again[0]
                if len(again) > 1 and 0 < point < len(pixels) - 1:
                    junctions.append((label, label, point, py[end], px[end]))
                    made.append(first)
                elif len(again) > 1:
                    closed = True
                continue
            other = lines[hit - 1]
            point, far = _nearest(other, py[end], px[end])
            if far >= 1e-5:
                for mine, value in ((py, other["y"][point]), (px, other["x"][point]), (angle, other["angle"][point]), (response, other["response"][point]), (pixels, other["pixels"][point])):
                    mine.insert(at, value)
                if first:  # places on this line move on
                    junctions = [(a, b, n + 1, v, u) if (a, b) == (label, label) else (a, b, n, v, u) for a, b, n, v, u in junctions]
            if 0 < point < len(other["y"]) - 1:
                junctions.append((hit, label, point, other["y"][point], other["x"][point]))
                made.append(first)
        for k in range(1, len(angle)):  # normals on one side along the line
            if math.cos(angle[k] - angle[k - 1]) < 0:
                angle[k] = (angle[k] + math.pi) % (2 * math.pi)
        kind = "closed" if closed else {(): "no_junc", (True,): "start_junc", (False,): "end_junc"}.get(tuple(made), "both_junc")
        lines.append({"pixels": pixels, "y": py, "x": px, "angle": angle, "response": response, "kind": kind})
    return lines, junctions


def bresenham(ny: float, nx: float, py: float, px: float, length: float) -> list[tuple[int, int]]:
    """Pixel offsets (from the pixel that holds the sub-pixel origin (py, px), |.| <= 0.5) that a half line hits, in order."""
    out, steps = [], math.ceil(length * max(abs(ny), abs(nx))) + 1
    major_x = abs(nx) >= abs(ny)
    a, b, pa, pb = (nx, ny, px, py) if major_x else (ny, nx, py, px)
    if abs(a) < 1e-12:
        return [(0, 0)]
    s, slope = (1 if a > 0 else -1), b / abs(a)
    last = 0
    for k in range(steps):
        at = pb + slope * (k - s * pa) if k else pb
        cell = math.floor(at + 0.5 + 1e-8)
        if cell != last:  # the line leaves its row of cells on the way: the corner cell belongs to it
            out.append((last, s * k) if major_x else (s * k, last))
        cur = (cell, s * k) if major_x else (s * k, cell)
        if not out or out[-1] != cur:
            out.append(cur)
        last = cell
    return out


def extend_ends(p: Plane, lines: list[dict], junctions: list, most: float, bright: bool = True) -> None:
    """Free ends go on along their tangent, uphill, for up to `most` pixels until they meet a pixel of another line, which then gets a junction."""
    owner = {}
    for k, line in enumerate(lines):
        for n, a in enumerate(line["pixels"]):
            owner.setdefault(a, (k, n))
    for k, line in enumerate(lines):
        for first in (True, False):
            if line["kind"] in ("closed", "both_junc", "start_junc" if first else "end_junc") or len(line["y"]) < 2:
                continue
            e = 0 if first else -1
            y, x = line["y"][e], line["x"][e]
            n = 1 if first else -2
            dy, dx = y - line["y"][n], x - line["x"][n]
            size = math.hypot(dy, dx)
            if not size:
                continue
            dy, dx = dy / size, dx / size
            cy, cx = math.floor(y + 0.5), math.floor(x + 0.5)
            path = []
            for oy, ox in bresenham(dy, dx, y - cy, x - cx, most):
                a = (cy + oy, cx + ox)
                t = (a[0] - y) * dy + (a[1] - x) * dx
                if t <= 0.5:
                    continue
                if not p.inside(*a) or t > most:
                    break
                slope = p.r[a] * dy + p.c[a] * dx
                if (slope <= 0) if bright else (slope >= 0):
                    break
                if a in owner and owner[a][0] != k:
                    other, m = owner[a]
                    if math.hypot(lines[other]["y"][m] - (y + t * dy), lines[other]["x"][m] - (x + t * dx)) > 3:
                        break
                    new = [(y + s * dy, x + s * dx, b) for s, b in path] + [(lines[other]["y"][m], lines[other]["x"][m], a)]
                    for ny, nx, b in new:
                        at = 0 if first else len(line["y"])
                        line["y"].insert(at, ny), line["x"].insert(at, nx), line["pixels"].insert(at, b)
                        line["angle"].insert(at, line["angle"][0 if first else -1]), line["response"].insert(at, p.response[b])
                    junctions.append((other + 1, k + 1, m, lines[other]["y"][m], lines[other]["x"][m]))
                    line["kind"] = {"no_junc": "start_junc" if first else "end_junc"}.get(line["kind"], "both_junc")
                    break
                path.append((t, a))


def traced(ridges: DataFrame, extend: float = 0.0, bright: bool = True) -> DataFrame:
    """TRACED: lines and junctions of each frame of classify()'s result. `extend` is the longest way to go on from free ends, in pixels."""
    columns = ["frame", "y", "x", "response", "ny", "nx", "py", "px", "r", "c", "line_class"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, frame = Plane(pdf), int(pdf["frame"].iloc[0])
        lines, found = trace_plane(p)
        if extend:
            extend_ends(p, lines, found, extend, bright)
        rows = [(frame, k + 1, n + 1, x, y, a, v, line["kind"], None) for k, line in enumerate(lines) for n, (y, x, a, v) in enumerate(zip(line["y"], line["x"], line["angle"], line["response"]))]
        rows += [(frame, a, n + 1, x, y, None, None, None, b) for a, b, n, y, x in found]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRACED.split(", ")]).astype({"contour2": "Int64"})

    return ridges.select(*columns).groupBy("frame").applyInPandas(run, TRACED)


def lines_of(found: DataFrame) -> DataFrame:
    """LINES: the curves of traced()."""
    return found.where("contour2 is null").drop("contour2")


def junctions_of(found: DataFrame) -> DataFrame:
    """JUNCTIONS of traced(): where line `contour2` ends on line `contour1` (or crosses itself); `point` is the place (from 1) on contour1."""
    return found.where("contour2 is not null").selectExpr("frame", "contour as contour1", "contour2", "point", "x", "y")


def trace(ridges: DataFrame, extend: float = 0.0, bright: bool = True) -> DataFrame:
    return lines_of(traced(ridges, extend, bright))


def junctions(ridges: DataFrame, extend: float = 0.0, bright: bool = True) -> DataFrame:
    return junctions_of(traced(ridges, extend, bright))
