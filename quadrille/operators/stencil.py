"""Neighbourhood operators: separable filters (blur, resampling, resizing) and 3 x 3 terrain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Taps of one axis at most: what a filter broadcasts.
MAX_TAPS = 5_000_000
Taps = list[list[tuple[int, float]]]


def filter_axis(df: DataFrame, axis: str, taps: Taps, invalid: str = "propagate", constant: float = 0.0, others: list[str] | None = None) -> DataFrame:
    """Along one axis, each output place is the weighted sum of its taps.

    A broadcast join with the taps and one aggregation with map-side sums. ``invalid``: ``propagate`` makes
    an output with a nodata tap null, ``ignore`` divides by the usable weights. Weight that no tap holds
    (a constant border) falls to ``constant``.
    """
    rows = [(i, at, float(w)) for i, row in enumerate(taps) for at, w in row]
    if len(rows) > MAX_TAPS:
        raise ValueError(f"more than {MAX_TAPS} taps")
    keep = others if others is not None else [c for c in df.columns if c not in (axis, "v")]
    table = df.sparkSession.createDataFrame(rows, f"_to int, {axis} int, _w double")
    v, w = F.col("v"), F.col("_w")
    used = F.sum(F.when(v.isNotNull(), w))
    if invalid == "ignore":
        value = F.when(used != 0, F.sum(v * w) / used)
    else:
        value = F.when(F.count(v) == F.count("*"), F.sum(v * w) + (1 - F.sum(w)) * constant if constant else F.sum(v * w))
    return df.join(F.broadcast(table), axis).groupBy(*keep, "_to").agg(value.alias("v")).withColumnRenamed("_to", axis)


def gaussian(sigma: float) -> list[float]:
    if not 0 < sigma <= 64:
        raise ValueError("sigma must be over 0 and at most 64")
    radius = math.ceil(3 * sigma)
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def border(i: int, n: int, mode: str) -> int | None:
    """Where a place outside 0..n-1 is read: clamped, mirrored without repeating the edge, or nowhere."""
    if 0 <= i < n:
        return i
    if mode == "clamp":
        return min(max(i, 0), n - 1)
    if mode == "mirror":
        period = 2 * (n - 1)
        i = i % period if period else 0
        return i if i < n else period - i
    if mode == "constant":
        return None
    raise ValueError(f"unknown border {mode!r}")


def blur_taps(n: int, sigma: float, mode: str = "clamp") -> Taps:
    w = gaussian(sigma)
    r = len(w) // 2
    out = []
    for i in range(n):
        row: dict[int, float] = {}
        for k, x in enumerate(w):
            at = border(i + k - r, n, mode)
            if at is not None:
                row[at] = row.get(at, 0.0) + x
        out.append(list(row.items()))
    return out


def gaussian_blur(df: DataFrame, sigma: float, width: int, height: int, mode: str = "clamp", invalid: str = "propagate", constant: float = 0.0) -> DataFrame:
    across = filter_axis(df, "x", blur_taps(width, sigma, mode), invalid, constant)
    return filter_axis(across, "y", blur_taps(height, sigma, mode), invalid, constant)


def linear_taps(source: int, target: int) -> Taps:
    """Two neighbours of each target centre, clamped."""
    out = []
    for i in range(target):
        at = (i + 0.5) * source / target - 0.5
        low = math.floor(at)
        row: dict[int, float] = {}
        for k, w in ((low, 1 - (at - low)), (low + 1, at - low)):
            k = min(max(k, 0), source - 1)
            row[k] = row.get(k, 0.0) + w
        out.append([(k, w) for k, w in row.items()])
    return out


def nearest_taps(source: int, target: int) -> Taps:
    return [[(min(max(math.floor((i + 0.5) * source / target - 0.5 + 0.5), 0), source - 1), 1.0)] for i in range(target)]


def lanczos_taps(source: int, target: int, lobes: int = 3) -> Taps:
    scale = min(1.0, target / source)

    def kernel(x: float) -> float:
        if abs(x) < 1e-12:
            return 1.0
        return 0.0 if abs(x) >= lobes else lobes * math.sin(math.pi * x) * math.sin(math.pi * x / lobes) / (math.pi * x) ** 2

    out = []
    for i in range(target):
        centre = (i + 0.5) * source / target - 0.5
        row: dict[int, float] = {}
        for k in range(math.ceil(centre - lobes / scale), math.floor(centre + lobes / scale) + 1):
            at = min(max(k, 0), source - 1)
            row[at] = row.get(at, 0.0) + kernel((k - centre) * scale)
        total = sum(row.values())
        out.append([(k, w / total) for k, w in row.items() if w])
    return out


def box_taps(source: int, factor: int) -> Taps:
    return [[(i * factor + k, 1 / factor) for k in range(factor)] for i in range(source // factor)]


def box_factor(source: int, target: int) -> int:
    """The largest power of two up to the ratio that divides the source."""
    f = 1
    while source % (2 * f) == 0 and 2 * f <= source / target:
        f *= 2
    return f


KERNELS = {"nearest": nearest_taps, "bilinear": linear_taps, "lanczos3": lanczos_taps}


def resample(df: DataFrame, source: tuple[int, int], target: tuple[int, int], method: str = "nearest", invalid: str = "propagate") -> DataFrame:
    """``source`` and ``target``: width and height."""
    taps = KERNELS[method]
    across = filter_axis(df, "x", taps(source[0], target[0]), invalid)
    return filter_axis(across, "y", taps(source[1], target[1]), invalid)


def resize(df: DataFrame, source: tuple[int, int], target: tuple[int, int], method: str = "lanczos3") -> DataFrame:
    """A resize for display; Lanczos reductions average whole boxes first."""
    if method == "lanczos3":
        for axis, k in (("x", 0), ("y", 1)):
            f = box_factor(source[k], target[k])
            if f > 1:
                df = filter_axis(df, axis, box_taps(source[k], f))
                source = tuple(s // f if i == k else s for i, s in enumerate(source))
    return resample(df, source, target, method)


def fit_size(source: tuple[int, int], width: int | None, height: int | None, fit: str = "cover", enlarge: bool = True) -> tuple[int, int]:
    """Output size of a resize; ``cover`` and ``contain`` fill the box, ``inside`` and ``outside`` keep the aspect, ``fill`` doesn't."""
    w, h = source
    if width is None or height is None:
        scale = (width / w) if height is None else (height / h)
        out = (width or max(1, math.floor(w * scale + 0.5)), height or max(1, math.floor(h * scale + 0.5)))
    elif fit in ("cover", "contain", "fill"):
        out = (width, height)
    else:
        scale = (min if fit == "inside" else max)(width / w, height / h)
        out = tuple(max(1, math.floor(s * scale + 0.5)) for s in source)
    return source if not enlarge and (out[0] > w or out[1] > h) else out


def _neighbours(df: DataFrame) -> DataFrame:
    """``c`` and its eight neighbours; absent pixels are null. Every pixel names the nine places that read it, and those meet in one aggregation."""
    names = {(dy, dx): n + w for dy, n in ((-1, "n"), (0, ""), (1, "s")) for dx, w in ((-1, "w"), (0, "c"), (1, "e"))}
    at = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in names]))
    read = df.select("y", "x", "v", at.alias("_p")).select((F.col("y") - F.col("_p.dy")).alias("y"), (F.col("x") - F.col("_p.dx")).alias("x"), "v", "_p")
    here = lambda dy, dx: (F.col("_p.dy") == dy) & (F.col("_p.dx") == dx)
    found = read.groupBy("y", "x").agg(*[F.max(F.when(here(*p), F.col("v"))).alias(n) for p, n in names.items()], F.max(here(0, 0)).alias("_own"))
    return found.filter("_own").drop("_own")


def gradient(df: DataFrame, cell_x: float = 1.0, cell_y: float = 1.0, z: float = 1.0, edge: str = "clamp", rows_north: bool = False) -> DataFrame:
    """Horn's 3 x 3 derivatives ``de`` and ``dn`` (to east and north). Nodata neighbours, and with ``clamp`` those outside, take the centre's value."""
    g = _neighbours(df)
    at = lambda n: F.coalesce(F.col(n), F.col("c"))
    de = ((at("ne") + 2 * at("e") + at("se")) - (at("nw") + 2 * at("w") + at("sw"))) * z / (8 * cell_x)
    dy = ((at("sw") + 2 * at("sc") + at("se")) - (at("nw") + 2 * at("nc") + at("ne"))) * z / (8 * cell_y)
    out = g.select("y", "x", F.col("c").alias("v"), F.when(F.col("c").isNotNull(), de).alias("de"), F.when(F.col("c").isNotNull(), dy if rows_north else -dy).alias("dn"))
    if edge == "nodata":
        ends = df.agg(F.max("x").alias("mx"), F.max("y").alias("my"))
        inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("mx")) & (F.col("y") < F.col("my"))
        out = out.crossJoin(F.broadcast(ends)).withColumns({c: F.when(inner, F.col(c)) for c in ("de", "dn")}).drop("mx", "my")
    return out


def slope(unit: str = "degrees") -> Column:
    rise = F.sqrt(F.pow("de", 2) + F.pow("dn", 2))
    return {"degrees": F.degrees(F.atan(rise)), "radians": F.atan(rise), "percent": rise * 100}[unit]


def aspect() -> Column:
    """Downslope azimuth, clockwise from north; null on flat ground."""
    turn = F.degrees(F.atan2(-F.col("de"), -F.col("dn"))) + 360
    return F.when((F.col("de") != 0) | (F.col("dn") != 0), turn - 360 * F.floor(turn / 360))


def hillshade(azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    a, h = math.radians(azimuth), math.radians(altitude)
    east, north, up = math.cos(h) * math.sin(a), math.cos(h) * math.cos(a), math.sin(h)
    lit = (-F.col("de") * east - F.col("dn") * north + up) / F.sqrt(F.pow("de", 2) + F.pow("dn", 2) + 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), lit * 255))


LENGTH_UNITS = {"metre": 1.0, "international-foot": 0.3048, "us-survey-foot": 1200 / 3937}
