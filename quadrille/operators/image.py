"""Image pipeline: an immutable list of steps over a pixel table ``y, x`` and colour columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import scalar
from quadrille.operators import project, stencil

# Positions and colours of the stops of each palette; linear in between.
STOPS = {
    "grayscale": [(0, (0, 0, 0)), (1, (255, 255, 255))],
    "viridis": [(0, (68, 1, 84)), (0.13, (71, 44, 122)), (0.25, (59, 82, 139)), (0.38, (44, 113, 142)), (0.5, (33, 145, 140)), (0.63, (39, 173, 129)), (0.75, (94, 201, 98)), (0.88, (170, 220, 50)), (1, (253, 231, 37))],
    "magma": [(0, (0, 0, 4)), (0.13, (28, 16, 68)), (0.25, (79, 18, 123)), (0.38, (129, 37, 129)), (0.5, (181, 54, 122)), (0.63, (229, 80, 100)), (0.75, (251, 135, 97)), (0.88, (254, 194, 135)), (1, (252, 253, 191))],
    "inferno": [(0, (0, 0, 4)), (0.13, (31, 12, 72)), (0.25, (85, 15, 109)), (0.38, (136, 34, 106)), (0.5, (186, 54, 85)), (0.63, (227, 89, 51)), (0.75, (249, 140, 10)), (0.88, (249, 201, 50)), (1, (252, 255, 164))],
    "plasma": [(0, (13, 8, 135)), (0.13, (75, 3, 161)), (0.25, (126, 3, 168)), (0.38, (168, 34, 150)), (0.5, (203, 70, 121)), (0.63, (229, 107, 93)), (0.75, (248, 148, 65)), (0.88, (253, 195, 40)), (1, (240, 249, 33))],
}


def palette(name: str) -> list[tuple[int, int, int]]:
    """256 colours, evenly spaced from 0 to 1."""
    places = [at for at, _ in STOPS[name]]
    colours = np.array([c for _, c in STOPS[name]], float)
    steps = np.arange(256) / 255
    return [tuple(c) for c in np.floor(np.stack([np.interp(steps, places, channel) for channel in colours.T], axis=1) + 0.5).astype(int).tolist()]


def render(df: DataFrame, black: float, white: float, scale: str = "linear", colours: str = "grayscale") -> DataFrame:
    """A plane as ``y, x, r, g, b, a``; nodata is transparent."""
    t = scalar.display_scale((F.col("v") - black) / (white - black), scale)
    at = scalar.half_up(t * 255).cast("int")
    table = palette(colours)
    rgb = {c: F.when(F.col("v").isNull(), 0).otherwise(scalar.lookup(at, [p[k] for p in table])) for k, c in enumerate("rgb")}
    return df.select("y", "x", *[v.alias(c) for c, v in rgb.items()], F.when(F.col("v").isNull(), 0).otherwise(255).alias("a"))


def relief(df: DataFrame, plane: DataFrame, black: float, white: float, azimuth: float = 315.0, elevation: float = 45.0, strength: float = 0.5) -> DataFrame:
    """A rendered plane (``y, x, r, g, b``) lit by the slopes of ``plane``: central differences in units of half the display range.

    Outside the plane a neighbour is the pixel itself; where one has no data the colour stays as it is.
    """
    if not (0 <= elevation <= 90 and 0 <= strength <= 1):
        raise ValueError("relief takes an elevation of 0 to 90 and a strength of 0 to 1")
    a, e = math.radians(azimuth), math.radians(elevation)
    # nodata is marked, so that it can be told from an absent neighbour
    near = stencil._neighbours(plane.select("y", "x", F.struct(F.col("v").alias("v")).alias("v")))
    at = lambda n: F.coalesce(F.col(n), F.col("c"))["v"]
    slopes = near.select("y", "x", ((at("e") - at("w")) * 2 / (white - black)).alias("_dx"), ((at("sc") - at("nc")) * 2 / (white - black)).alias("_dy"))
    length = F.sqrt(F.pow("_dx", 2) + F.pow("_dy", 2) + 1)
    toward = (-F.col("_dx") * math.sin(a) * math.cos(e) + F.col("_dy") * math.cos(a) * math.cos(e) + math.sin(e)) / length
    shade = F.when(toward < 0, 0.0).otherwise(toward)
    lit = slopes.select("y", "x", F.coalesce(1 - strength + strength * (0.35 + 0.65 * shade), F.lit(1.0)).alias("_lit"))
    return df.join(lit, ["y", "x"]).withColumns({c: scalar.clamp(scalar.half_up(F.col(c) * F.col("_lit")), 0, 255).cast("int") for c in "rgb"}).drop("_lit")


def rotate(df: DataFrame, degrees: float, width: int, height: int, background: float = 0.0) -> tuple[DataFrame, int, int]:
    """Clockwise by any angle: each target pixel is mapped back and read from its four neighbours; what lies outside is background.

    The canvas of a long narrow image grows with the square of its length. Only the span of each line that the image
    can reach is joined with it, in cells of four samples; the rest is generated and never moves between tasks.
    """
    a = math.radians(degrees)
    cos, sin = math.cos(a), math.sin(a)
    w, h = math.ceil(abs(width * cos) + abs(height * sin) - 1e-9), math.ceil(abs(width * sin) + abs(height * cos) - 1e-9)
    dx, dy = F.col("x") + 0.5 - w / 2, F.col("y") + 0.5 - h / 2
    sx, sy = dx * cos + dy * sin + width / 2 - 0.5, -dx * sin + dy * cos + height / 2 - 0.5
    # the first and last x of a line from which -1 <= sx < width and -1 <= sy < height, and a pixel more on either side
    lo, hi = [F.lit(0)], [F.lit(w - 1)]
    for slope, rest, size in ((cos, dy * sin + width / 2 - 0.5, width), (-sin, dy * cos + height / 2 - 0.5, height)):
        if abs(slope) > 1e-9:
            ends = [(end - rest) / slope + w / 2 - 0.5 for end in ((-1, size) if slope > 0 else (size, -1))]
            lo.append(F.floor(ends[0]) - 1)
            hi.append(F.ceil(ends[1]) + 1)
    spans = {"_lo": F.least(F.greatest(*lo), F.lit(w)).cast("int"), "_hi": F.greatest(F.least(*hi), F.lit(-1)).cast("int")}
    session, blank = df.sparkSession, F.lit(float(background))

    lines = session.range(h).select(F.col("id").cast("int").alias("y")).withColumns(spans)
    reached = lines.filter("_lo <= _hi").select("y", F.explode(F.sequence("_lo", "_hi")).alias("x"))
    at = reached.select("y", "x", F.floor(sy).cast("int").alias("_y"), F.floor(sx).cast("int").alias("_x"))
    i, j = F.col("k") % 2, F.expr("CAST(k DIV 2 AS INT)")
    taps = df.filter(F.col("v").isNotNull() & F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    cells = taps.groupBy((F.col("y") - j).alias("_y"), (F.col("x") - i).alias("_x")).agg(*[F.sum(F.when(F.col("k") == k, F.col("v"))).alias(f"_{k}") for k in range(4)])
    fx, fy = sx - F.col("_x"), sy - F.col("_y")
    value = sum(F.coalesce(f"_{k}", blank) * (fx if k % 2 else 1 - fx) * (fy if k // 2 else 1 - fy) for k in range(4))
    image = at.join(cells, ["_y", "_x"], "left").select("y", "x", value.alias("v"))

    # pieces of 256 pixels, column of pieces by column: in files these repeat, so that they take little room
    pieces = -(-w // 256) * h
    piece = session.range(0, pieces, 1, pieces // 2**14 + 1).select(F.expr(f"CAST(id % {max(h, 1)} AS INT)").alias("y"), F.expr(f"CAST(id DIV {max(h, 1)} * 256 AS INT)").alias("_from")).withColumns(spans)
    pixels = piece.select("y", "_lo", "_hi", F.explode(F.sequence("_from", F.least(F.col("_from") + 255, F.lit(w - 1)))).alias("x"))
    around = pixels.filter("x < _lo OR x > _hi").select("y", "x", blank.alias("v"))
    return image.unionByName(around), w, h


@dataclass(frozen=True)
class Image:
    """A lazy image: rows ``y, x`` and one or more value columns; every step gives a new one."""

    df: DataFrame
    width: int
    height: int
    channels: tuple[str, ...] = ("v",)
    metadata: tuple = ()

    def _with(self, df: DataFrame, width: int | None = None, height: int | None = None) -> Image:
        return replace(self, df=df, width=width or self.width, height=height or self.height)

    def crop(self, x: int, y: int, width: int, height: int) -> Image:
        if x < 0 or y < 0 or x + width > self.width or y + height > self.height or width < 1 or height < 1:
            raise ValueError("the crop is outside the image")
        return self._with(project.crop(self.df, x, y, width, height), width, height)

    def resize(self, width: int | None = None, height: int | None = None, fit: str = "cover", kernel: str = "lanczos3", enlarge: bool = True) -> Image:
        w, h = stencil.fit_size((self.width, self.height), width, height, fit, enlarge)
        inner, source = self, (self.width, self.height)
        if fit == "cover" and width and height:  # the centre that has the box's aspect
            scale = max(w / self.width, h / self.height)
            cw, ch = min(self.width, max(1, math.floor(w / scale + 0.5))), min(self.height, max(1, math.floor(h / scale + 0.5)))
            inner, source = self.crop((self.width - cw) // 2, (self.height - ch) // 2, cw, ch), (cw, ch)
        out = None
        for c in self.channels:
            one = stencil.resize(inner.df.select("y", "x", F.col(c).cast("double").alias("v")), source, (w, h), kernel)
            one = one.select("y", "x", scalar.clamp(scalar.half_up(F.col("v")), 0, 255).cast("int").alias(c))
            out = one if out is None else out.join(one, ["y", "x"])
        return self._with(out, w, h)

    def auto_orient(self, code: int) -> Image:
        w, h = (self.height, self.width) if code >= 5 else (self.width, self.height)
        return self._with(project.orient(self.df, code, self.width, self.height), w, h)

    def flip(self) -> Image:
        return self.auto_orient(4)

    def flop(self) -> Image:
        return self.auto_orient(2)

    def rotate(self, degrees: float) -> Image:
        turn = degrees % 360
        if turn in (0, 90, 180, 270):
            return self.auto_orient({0: 1, 90: 6, 180: 3, 270: 8}[turn])
        if self.channels != ("v",):
            raise ValueError("other angles take one channel")
        df, w, h = rotate(self.df, degrees, self.width, self.height)
        return self._with(df, w, h)

    def window(self, centre: float, width: float) -> Image:
        return self._with(self.df.withColumns({c: scalar.window_level(F.col(c), centre, width) for c in self.channels}))

    def lut(self, table: list[int]) -> Image:
        return self._with(self.df.withColumns({c: scalar.lookup(F.col(c), table) for c in self.channels}))

    def keep(self, **metadata) -> Image:
        return replace(self, metadata=tuple({**dict(self.metadata), **metadata}.items()))
