"""Reductions: statistics, percentiles, histograms, projections, spectral sums, object tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, extremes, mean and population deviation of the usable samples; null where there are none."""
    v = F.col("v")
    columns = [F.count("*").alias("n"), F.count(v).alias("finite"), (F.count("*") - F.count(v)).alias("invalid"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.var_pop(v).alias("variance")]
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def percentiles(df: DataFrame, at: list[float]) -> DataFrame:
    """``p, value`` by nearest rank, ``floor(p / 100 * (n - 1) + 0.5)`` from 0.

    Values are counted before they meet. The place of a value is its running count: a running sum
    over ranges of values, after one over the ranges' totals.
    """
    counts = df.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    # 4096 ranges of equal width between the extremes: the offsets' table is that short
    ends = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    ranged = counts.crossJoin(F.broadcast(ends)).withColumn("r", F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * 4096), F.lit(0)))
    totals = ranged.groupBy("r").agg(F.sum("n").alias("s"))
    offsets = totals.select("r", (F.sum("s").over(Window.orderBy("r")) - F.col("s")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("r").orderBy("v"))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(offsets), "r").withColumn("last", F.col("before") + F.col("upto") - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.floor(F.lit(p / 100.0) * (F.col("total") - 1) + 0.5).alias("k")) for p in at])
    return placed.select("v", "first", "last", F.explode(wanted).alias("w")).filter("w.k BETWEEN first AND last").select("w.p", F.col("v").alias("value"))


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    """-1 below, ``bins`` above; the last edge is inclusive."""
    return F.when(v < low, -1).when(v > high, bins).when(v == high, bins - 1).otherwise(F.floor((v - low) / ((high - low) / bins)).cast("int"))


def histogram(df: DataFrame, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """``bin, low, high, n`` with empty bins; bins -1 and ``bins`` hold what an explicit range leaves out."""
    if not 1 <= bins <= 1_000_000:
        raise ValueError("bins must be 1 to 1000000")
    if low is None:
        ends = df.agg(F.min("v").alias("a"), F.max("v").alias("b"))
        same = F.col("a") == F.col("b")
        ends = ends.select(F.when(same, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(same, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    else:
        ends = df.sparkSession.range(1).select(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    ends = F.broadcast(ends)  # one row
    counts = df.filter("v IS NOT NULL").crossJoin(ends).groupBy(bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(-1, bins + 1).withColumnRenamed("id", "bin")
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").crossJoin(ends).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def project(cube: DataFrame, keep: list[str], how: str, invalid: str = "ignore") -> DataFrame:
    """Reduce all axes but ``keep`` by max, min or mean; ``propagate`` makes a cell with nodata null."""
    value = {"max": F.max, "min": F.min, "mean": F.avg}[how]("v")
    if invalid == "propagate":
        value = F.when(F.count("v") == F.count("*"), value)
    return cube.groupBy(*keep).agg(value.alias("v"))


def nearest_channel(channels: DataFrame, wavelength: float) -> DataFrame:
    """``channel`` with the least distance of ``centre``; the lowest of equals."""
    return channels.agg(F.min_by("channel", F.struct(F.abs(F.col("centre") - wavelength), "channel")).alias("channel"))


def integrate(cube: DataFrame, by: list[str], low: float, high: float, centre: str = "centre") -> DataFrame:
    """Trapezoid over channels inside ``low..high``; one channel gives its value; nodata gives null."""
    inside = cube.filter(F.col(centre).between(low, high))
    w = Window.partitionBy(*by).orderBy(centre)
    parts = inside.withColumn("part", (F.lag("v").over(w) + F.col("v")) * 0.5 * (F.col(centre) - F.lag(centre).over(w)))
    whole = F.when(F.count("*") == 1, F.max("v")).otherwise(F.sum("part"))
    return parts.groupBy(*by).agg(F.when(F.count("v") == F.count("*"), whole).alias("v"))


def bands(cube: DataFrame, by: list[str], channels: dict[str, int], channel: str = "channel") -> DataFrame:
    """Some channels as columns, in one aggregation and without a join."""
    wanted = cube.filter(F.col(channel).isin(*set(channels.values())))
    return wanted.groupBy(*by).agg(*[F.max(F.when(F.col(channel) == c, F.col("v"))).alias(n) for n, c in channels.items()])


def measure(df: DataFrame, width: int, low: float = 1, high: float = 99, most: int = 65_536) -> DataFrame:
    """Display range by percentiles of every ``ceil(n / most)``-th sample in row-major order; a degenerate range is widened."""
    n = df.count()
    stride = max(1, -(-n // most))
    found = {r.p: r.value for r in percentiles(df.filter((F.col("y") * width + F.col("x")) % stride == 0), [low, high]).collect()}
    a, b = found.get(float(low)), found.get(float(high))
    if a is not None and a == b:
        half = 0.5 * abs(a) or 1.0
        a, b = a - half, b + half
    return df.sparkSession.createDataFrame([(a, b)], "black double, white double")


def moments(df: DataFrame, by: list[str], sx: float = 1.0, sy: float = 1.0) -> DataFrame:
    """Object measures of pixels by label: box, centroid and the ellipse of the second moments."""
    x, y = F.col("x").cast("double") + 0.5, F.col("y").cast("double") + 0.5
    n = F.count("*")
    sums = df.groupBy(*by).agg(n.alias("pixels"), F.min("x").alias("box_x"), F.min("y").alias("box_y"), (F.max("x") - F.min("x") + 1).alias("box_width"), (F.max("y") - F.min("y") + 1).alias("box_height"), F.avg(x).alias("centroid_x"), F.avg(y).alias("centroid_y"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow("xy", 2))
    major, minor = 4 * F.sqrt(F.greatest(F.lit(0.0), half + root)), 4 * F.sqrt(F.greatest(F.lit(0.0), half - root))
    out = sums.withColumns({"diameter": 2 * F.sqrt(F.col("pixels") / F.pi()), "major": major, "minor": minor, "orientation": 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))})
    return out.withColumns({"aspect": F.when(F.col("minor") > 0, F.col("major") / F.col("minor")), "area": F.col("pixels") * abs(sx * sy)}).drop("xx", "yy", "xy")
