"""Georeferenced grids: affine transforms, grid tests, and reading one grid at another's pixels.

An affine is ``(a, b, c, d, e, f)``: ``X = a*x + b*y + c``, ``Y = d*x + e*y + f``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Affine = tuple[float, float, float, float, float, float]
Bounds = tuple[float, float, float, float]


@dataclass(frozen=True)
class Grid:
    crs: str
    width: int
    height: int
    affine: Affine
    registration: str = "area"

    @property
    def shift(self) -> float:
        """Of a pixel's centre from its index."""
        return 0.5 if self.registration == "area" else 0.0

    def bounds(self) -> Bounds:
        lo = 0.0 if self.registration == "area" else -0.5
        corners = [apply(self.affine, x + lo, y + lo) for x in (0, self.width) for y in (0, self.height)]
        return min(c[0] for c in corners), min(c[1] for c in corners), max(c[0] for c in corners), max(c[1] for c in corners)


def apply(t: Affine, x: float, y: float) -> tuple[float, float]:
    return t[0] * x + t[1] * y + t[2], t[3] * x + t[4] * y + t[5]


def invert(t: Affine) -> Affine | None:
    det = t[0] * t[4] - t[1] * t[3]
    if det == 0 or not math.isfinite(det):
        return None
    a, b, d, e = t[4] / det, -t[1] / det, -t[3] / det, t[0] / det
    return a, b, -(a * t[2] + b * t[5]), d, e, -(d * t[2] + e * t[5])


def relation(a: Grid, b: Grid) -> str:
    if a.crs != b.crs:
        return "different-crs"
    return "exact-grid" if a == b else "same-crs-different-grid"


def aligned(a: Grid, b: Grid, tolerance: float = 1e-9) -> bool:
    """Same pixel size and rotation, and a whole number of pixels apart."""
    if a.crs != b.crs or any(abs(p - q) > tolerance for p, q in zip((*a.affine[:2], *a.affine[3:5]), (*b.affine[:2], *b.affine[3:5]))):
        return False
    inverse = invert(a.affine)
    if inverse is None:
        return False
    x, y = apply(inverse, b.affine[2], b.affine[5])
    return abs(x - round(x)) <= tolerance and abs(y - round(y)) <= tolerance


def intersection(a: Bounds, b: Bounds) -> Bounds | None:
    """Touching edges count."""
    x0, y0, x1, y1 = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return (x0, y0, x1, y1) if x0 <= x1 and y0 <= y1 else None


def region(grid: Grid, box: Bounds, clamp: bool = True) -> tuple[int, int, int, int]:
    """Pixels that world bounds touch: x, y, width, height."""
    inverse = invert(grid.affine)
    if inverse is None:
        raise ValueError("the grid's transform is singular")
    at = [apply(inverse, x, y) for x in (box[0], box[2]) for y in (box[1], box[3])]
    lift = 0.5 - grid.shift
    x0, x1 = math.floor(min(p[0] for p in at) + lift), math.ceil(max(p[0] for p in at) + lift)
    y0, y1 = math.floor(min(p[1] for p in at) + lift), math.ceil(max(p[1] for p in at) + lift)
    if clamp:
        x0, x1, y0, y1 = max(x0, 0), min(x1, grid.width), max(y0, 0), min(y1, grid.height)
    return x0, y0, max(0, x1 - x0), max(0, y1 - y0)


def transform_bounds(box: Bounds, transform: Callable[[float, float], tuple[float, float]], samples: int = 16) -> Bounds:
    at = [k / samples for k in range(samples + 1)]
    edge = [(box[0] + t * (box[2] - box[0]), y) for t in at for y in (box[1], box[3])] + [(x, box[1] + t * (box[3] - box[1])) for t in at for x in (box[0], box[2])]
    found = [transform(*p) for p in edge]
    return min(p[0] for p in found), min(p[1] for p in found), max(p[0] for p in found), max(p[1] for p in found)


def propose_grid(crs: str, box: Bounds, width: int | None = None, height: int | None = None, resolution: float | None = None) -> Grid:
    """A north-up grid over bounds, from the upper left corner."""
    if resolution is not None:
        width, height = max(1, math.ceil((box[2] - box[0]) / resolution - 1e-9)), max(1, math.ceil((box[3] - box[1]) / resolution - 1e-9))
        return Grid(crs, width, height, (resolution, 0.0, box[0], 0.0, -resolution, box[3]))
    if not width or not height:
        raise ValueError("a size or a resolution is needed")
    return Grid(crs, width, height, ((box[2] - box[0]) / width, 0.0, box[0], 0.0, -(box[3] - box[1]) / height, box[3]))


def crs_kind(wkt: str) -> str | None:
    m = re.match(r"\s*(GEOGCS|GEOGCRS|PROJCS|PROJCRS|GEOCCS|GEODCRS|VERT_CS|VERTCRS|LOCAL_CS|ENGCRS|COMPD_CS|COMPOUNDCRS)\s*\[", wkt, re.I)
    return m[1].upper() if m else None


def planes_of_view(lengths: dict[str, int], fixed: dict[str, int], ranges: dict[str, tuple[int, int]], spatial: tuple[str, str]) -> int:
    n = 1
    for axis, length in lengths.items():
        if axis not in spatial and axis not in fixed:
            n *= ranges[axis][1] - ranges[axis][0] if axis in ranges else length
    return n


def read_at(df: DataFrame, source: Grid, target: Grid, method: str = "nearest", inverse: Callable | None = None, least_weight: float = 0.5) -> DataFrame:
    """``source``'s samples (``y, x, v``) at ``target``'s pixels; outside is null.

    Bilinear weights of pixels outside or without data are left out, and the rest is renormalised if it holds ``least_weight``.

    ``inverse`` takes arrays of target coordinates to source coordinates where the CRS differ (no
    transforms are bundled). The target is generated, mapped by column arithmetic and joined with the
    source on its pixel numbers; the source is first cut to the window that is needed.
    """
    if source == target and inverse is None:
        return df.select("y", "x", "v")
    if source.crs != target.crs and inverse is None:
        raise ValueError("another CRS needs a transform")
    back = invert(source.affine)
    if back is None:
        raise ValueError("the source's transform is singular")
    grid = df.sparkSession.range(target.width * target.height).select((F.col("id") % target.width).cast("int").alias("x"), F.expr(f"CAST(id DIV {target.width} AS INT)").alias("y"))
    t, px, py = target.affine, F.col("x") + target.shift, F.col("y") + target.shift
    world = grid.withColumns({"wx": px * t[0] + py * t[1] + t[2], "wy": px * t[3] + py * t[4] + t[5]})
    if inverse is not None:

        @F.pandas_udf("wx double, wy double")
        def moved(x: pd.Series, y: pd.Series) -> pd.DataFrame:
            a, b = inverse(x.to_numpy(), y.to_numpy())
            return pd.DataFrame({"wx": a, "wy": b})

        world = world.withColumn("_m", moved("wx", "wy")).withColumns({"wx": F.col("_m.wx"), "wy": F.col("_m.wy")}).drop("_m")
    at = world.select("y", "x", (F.col("wx") * back[0] + F.col("wy") * back[1] + back[2] - source.shift).alias("sx"), (F.col("wx") * back[3] + F.col("wy") * back[4] + back[5] - source.shift).alias("sy"))
    inside = (F.col("sx") >= -0.5) & (F.col("sx") < source.width - 0.5) & (F.col("sy") >= -0.5) & (F.col("sy") < source.height - 0.5)
    pixels = df.select(F.col("y").alias("_y"), F.col("x").alias("_x"), "v")
    if method == "nearest":
        near = at.withColumns({"_x": F.when(inside, F.floor(F.col("sx") + 0.5).cast("int")), "_y": F.when(inside, F.floor(F.col("sy") + 0.5).cast("int"))})
        return near.join(pixels, ["_y", "_x"], "left").select("y", "x", "v")
    k = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    near = at.withColumn("k", k)
    i, j = F.col("k") % 2, F.floor(F.col("k") / 2)
    x0, y0 = F.floor("sx"), F.floor("sy")
    taps = near.select(
        "y",
        "x",
        (x0 + i).cast("int").alias("_x"),
        (y0 + j).cast("int").alias("_y"),
        (F.abs(1 - i - (F.col("sx") - x0)) * F.abs(1 - j - (F.col("sy") - y0))).alias("w"),
    )
    used = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    value = F.when(used >= least_weight - 1e-12, F.sum(F.col("v") * F.col("w")) / used)
    return taps.join(pixels, ["_y", "_x"], "left").groupBy("y", "x").agg(value.alias("v"))
