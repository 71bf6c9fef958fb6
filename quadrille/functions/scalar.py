"""Column functions: validity, band-math functions, display scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def usable(v: Column, nodata: float | None = None) -> Column:
    """Finite and not ``nodata``; never null."""
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != INF)
    return F.coalesce(ok & (v != nodata) if nodata is not None and nodata == nodata else ok, F.lit(False))


def valid(v: Column, nodata: float | None = None) -> Column:
    """``v`` as double, with unusable samples null: how scans hand samples to the operators."""
    d = v.cast("double")
    return F.when(usable(d, nodata), d)


def half_up(v: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(v + 0.5)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null at a zero denominator."""
    return F.try_divide(a, b)


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def linear_combination(terms: list[tuple[float, Column]], constant: float = 0.0) -> Column:
    out = F.lit(float(constant))
    for c, v in terms:
        out = out + F.lit(float(c)) * v
    return out


def display_scale(t: Column, mode: str = "linear") -> Column:
    """A position 0..1 in the display range, after the scale."""
    t = clamp(t, 0, 1)
    if mode == "linear":
        return t
    if mode == "sqrt":
        return F.sqrt(t)
    if mode == "log":
        return F.log1p(t * 999) / F.log(F.lit(1000.0))
    if mode == "asinh":
        return F.asinh(t * 10) / F.asinh(F.lit(10.0))
    raise ValueError(f"unknown scale {mode!r}")


def to_byte(v: Column, black: float, white: float) -> Column:
    """0..255 by window; null gives 0."""
    return F.coalesce(clamp(half_up((v - black) / (white - black) * 255), 0, 255), F.lit(0.0)).cast("int")


def window_level(v: Column, centre: float, width: float) -> Column:
    return to_byte(v, centre - width / 2, centre + width / 2)


def lookup(v: Column, table: list[int]) -> Column:
    """A 256-entry table at a byte."""
    if len(table) != 256:
        raise ValueError("a table has 256 entries")
    return F.element_at(F.array(*[F.lit(x) for x in table]), v.cast("int") + 1)


def orientation(code: int, x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """Where a pixel goes under the EXIF orientation 1 to 8 (size before it)."""
    right, down = F.lit(width - 1) - x, F.lit(height - 1) - y
    return {1: (x, y), 2: (right, y), 3: (right, down), 4: (x, down), 5: (y, x), 6: (down, x), 7: (down, right), 8: (y, right)}[code]
