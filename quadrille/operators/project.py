"""Projections and predicates on planes (``y, x, v``) and cubes with more axes. Null ``v`` is nodata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def samples(rows: DataFrame, line: str = "y", values: str = "values") -> DataFrame:
    """Vector form (a row a line) to sample form."""
    return rows.select(F.col(line).cast("int").alias("y"), F.posexplode(values).alias("x", "v")).withColumn("v", F.col("v").cast("double"))


def crop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The region, rebased to 0."""
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return df.filter(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def crop_lines(rows: DataFrame, x: int, y: int, width: int, height: int, line: str = "y", values: str = "values") -> DataFrame:
    """A crop in vector form: the line range reaches the scan, and arrays are cut before they are exploded."""
    return samples(rows.filter(F.col(line).between(y, y + height - 1)).select((F.col(line) - y).alias(line), F.slice(values, x + 1, width).alias(values)), line, values)


def slice_plane(df: DataFrame, display: tuple[str, str], fixed: dict[str, int]) -> DataFrame:
    """The plane of two axes (x, then y) at fixed places of the others."""
    for name, at in fixed.items():
        df = df.filter(F.col(name) == at)
    return df.select(F.col(display[1]).alias("y"), F.col(display[0]).alias("x"), "v")


def series(df: DataFrame, axis: str, fixed: dict[str, int]) -> DataFrame:
    for name, at in fixed.items():
        df = df.filter(F.col(name) == at)
    return df.select(F.col(axis).alias("at"), "v")


def select_level(df: DataFrame, level: int) -> DataFrame:
    return df.filter(F.col("level") == level).drop("level")


def threshold(df: DataFrame, mode: str, low: float, high: float | None = None, invalid: int = 0) -> DataFrame:
    """1 where the predicate holds, ``invalid`` at nodata; range ends are inclusive."""
    v = F.col("v")
    tests = {"greater-than": v > low, "greater-or-equal": v >= low, "less-than": v < low, "less-or-equal": v <= low}
    if high is not None:
        tests |= {"inside": v.between(low, high), "outside": ~v.between(low, high)}
    if mode not in tests:
        raise ValueError(f"mode {mode!r} needs another value or is unknown")
    return df.withColumn("v", F.when(v.isNull(), F.lit(invalid)).when(tests[mode], 1).otherwise(0))


def join_planes(planes: dict[str, DataFrame]) -> DataFrame:
    """Planes side by side, a column each; every plane must cover the region, so positions meet by equality."""
    out = None
    for name, df in planes.items():
        named = df.select("y", "x", F.col("v").alias(name))
        out = named if out is None else out.join(named, ["y", "x"])
    return out


def uncovered(df: DataFrame, width: int, height: int) -> DataFrame:
    """Positions of the region that ``df`` lacks."""
    want = df.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.expr(f"CAST(id DIV {width} AS INT)").alias("y"))
    return want.join(df.select("y", "x"), ["y", "x"], "left_anti")


def classify(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Class colours (``v, r, g, b``; a small table) at class numbers; undeclared ones raise."""
    found = df.join(F.broadcast(classes.withColumn("_known", F.lit(True))), "v", "left")
    return found.filter(F.when(F.col("_known") | F.col("v").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("undeclared class "), F.col("v").cast("string"))))).drop("_known")


def orient(df: DataFrame, code: int, width: int, height: int) -> DataFrame:
    from quadrille.functions.scalar import orientation

    x, y = orientation(code, F.col("x"), F.col("y"), width, height)
    return df.withColumns({"x": x, "y": y})
