"""Regions of interest as predicates and row spans, line sampling plans, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]


def rectangle(x: float, y: float, width: float, height: float) -> Column:
    """Pixel centres inside; left and top are inclusive, right and bottom aren't."""
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    return (cx >= x) & (cx < x + width) & (cy >= y) & (cy < y + height)


def ellipse(cx: float, cy: float, rx: float, ry: float) -> Column:
    box = F.col("x").between(math.floor(cx - rx) - 1, math.ceil(cx + rx)) & F.col("y").between(math.floor(cy - ry) - 1, math.ceil(cy + ry))
    return box & (F.pow((F.col("x") + 0.5 - cx) / rx, 2) + F.pow((F.col("y") + 0.5 - cy) / ry, 2) <= 1)


def polygon_spans(points: list[Point], height: int) -> list[tuple[int, int, int]]:
    """Rows and inclusive column spans whose centres are inside, even-odd; an edge on a row's centre line is filled."""
    edges = list(zip(points, [*points[1:], points[0]]))
    top, bottom = min(p[1] for p in points), max(p[1] for p in points)
    out = []
    for y in range(max(0, math.floor(top - 0.5)), min(height - 1, math.ceil(bottom)) + 1):
        line = y + 0.5
        crossings = sorted(x1 + (line - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in edges if y1 != y2 and min(y1, y2) <= line < max(y1, y2))
        spans = list(zip(crossings[::2], crossings[1::2]))
        spans += [(min(x1, x2), max(x1, x2)) for (x1, y1), (x2, y2) in edges if y1 == y2 == line]
        out += [(y, a, b) for lo, hi in spans if (a := math.ceil(lo - 0.5)) <= (b := math.floor(hi - 0.5))]
    return out


def within_polygon(df: DataFrame, points: list[Point], height: int) -> DataFrame:
    """A semi-join with the polygon's spans, whose number is bounded by its rows and edges."""
    spans = df.sparkSession.createDataFrame(polygon_spans(points, height), "y int, _from int, _to int")
    box = df.filter(F.col("x").between(math.floor(min(p[0] for p in points)) - 1, math.ceil(max(p[0] for p in points))) & F.col("y").between(math.floor(min(p[1] for p in points)) - 1, math.ceil(max(p[1] for p in points))))
    return box.join(F.broadcast(spans), (box["y"] == spans["y"]) & box["x"].between(spans["_from"], spans["_to"]), "left_semi")


def bounding_box(points: list[Point]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def clip_box(box: tuple[float, float, float, float], width: float, height: float) -> tuple[float, float, float, float] | None:
    x0, y0 = max(box[0], 0), max(box[1], 0)
    x1, y1 = min(box[0] + box[2], width), min(box[1] + box[3], height)
    return (x0, y0, x1 - x0, y1 - y0) if x1 >= x0 and y1 >= y0 else None


def line_samples(points: list[Point], spacing: float, sx: float = 1.0, sy: float = 1.0, most: int = 1_000_000) -> list[tuple[int, float, float, float]]:
    """``(k, distance, x, y)`` along a polyline, every ``spacing`` and at the end; lengths are scaled by the pixel sizes."""
    if spacing <= 0:
        raise ValueError("spacing must be positive")
    lengths = [math.hypot((b[0] - a[0]) * sx, (b[1] - a[1]) * sy) for a, b in zip(points, points[1:])]
    total = sum(lengths)
    n = math.ceil(total / spacing) + 1
    if n > most:
        raise ValueError(f"more than {most} samples")
    out = []
    for k in range(n):
        d = float(total if k == n - 1 else k * spacing)
        rest, j = d, 0
        while j < len(lengths) - 1 and rest > lengths[j]:
            rest -= lengths[j]
            j += 1
        t = rest / lengths[j] if lengths[j] else 0.0
        out.append((k, d, points[j][0] + t * (points[j + 1][0] - points[j][0]), points[j][1] + t * (points[j + 1][1] - points[j][1])))
    return out


def _contributors(samples: list[tuple[int, float, float, float]], method: str, centre: float) -> list[tuple[int, float, int, int, float]]:
    """``(k, distance, y, x, weight)``; pixel centres stand at integers plus ``centre``."""
    out = []
    for k, d, px, py in samples:
        if method == "nearest":
            at = (math.floor(px), math.floor(py)) if centre else (math.floor(px + 0.5), math.floor(py + 0.5))
            out.append((k, d, at[1], at[0], 1.0))
            continue
        fx, fy = px - centre, py - centre
        x0, y0 = math.floor(fx), math.floor(fy)
        out += [(k, d, y0 + j, x0 + i, abs(1 - i - (fx - x0)) * abs(1 - j - (fy - y0))) for j in (0, 1) for i in (0, 1)]
    return out


def profile(df: DataFrame, samples: list[tuple[int, float, float, float]], method: str = "nearest", centre: float = 0.5, least_weight: float | None = None) -> DataFrame:
    """``k, distance, v`` along a line plan.

    Any contributor outside or without data makes the sample null; with ``least_weight`` what is
    usable is renormalised if it holds that weight.
    """
    plan = df.sparkSession.createDataFrame(_contributors(samples, method, centre), "k int, distance double, y int, x int, w double")
    # the plan is bounded; the plane is read once, by the plan's broadcast
    found = df.select("y", "x", "v").join(F.broadcast(plan), ["y", "x"]).groupBy("k").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("used"), F.count("v").alias("n"))
    every = plan.groupBy("k", "distance").agg(F.count("*").alias("need"))
    value = F.when(F.col("n") == F.col("need"), F.col("s")) if least_weight is None else F.when(F.col("used") >= least_weight, F.col("s") / F.col("used"))
    return every.join(found, "k", "left").select("k", "distance", value.alias("v"))
