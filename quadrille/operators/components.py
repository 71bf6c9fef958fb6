"""Connected components of a mask: runs of rows, overlaps of neighbouring rows, stars to the least run."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder (``spark.checkpoint.dir``; a temporary one only where that is unset)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def link(edges: DataFrame) -> DataFrame:
    """``node, root`` of the nodes of ``edges`` (``u, v``): the least node that can be reached.

    Large-star and small-star steps by turns, until nothing changes.
    """
    now = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        sides = now.union(now.select("v", "u")).toDF("u", "v")
        floor = sides.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        wide = sides.join(floor, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("low"))
        narrow = wide.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = durable(narrow.union(least).toDF("u", "v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen:
            return now.toDF("node", "root").union(now.select("v", "v").distinct())
        seen = state


def label(mask: DataFrame, width: int, connectivity: int = 8) -> DataFrame:
    """``y, x, label`` of the foreground (``v`` neither null nor 0); labels count objects by their first pixel in row-major order."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    reach = 1 if connectivity == 8 else 0
    row = Window.partitionBy("y").orderBy("x")
    ink = mask.filter("v IS NOT NULL AND v <> 0").select("y", "x").withColumn("_g", F.col("x") - F.row_number().over(row))
    runs = durable(ink.groupBy("y", "_g").agg(F.min("x").alias("a"), F.max("x").alias("b")).withColumn("run", F.col("y").cast("long") * width + F.col("a")))
    up, down = runs.alias("p"), runs.alias("q")
    meet = (F.col("q.y") == F.col("p.y") + 1) & (F.col("q.a") <= F.col("p.b") + reach) & (F.col("p.a") <= F.col("q.b") + reach)
    roots = link(up.join(down, meet).select(F.col("q.run").alias("u"), F.col("p.run").alias("v")))
    rooted = runs.join(roots, runs["run"] == roots["node"], "left").select("y", "a", "b", F.coalesce("root", "run").alias("root"))
    # numbering: only the roots are ordered
    numbers = rooted.select("root").distinct().withColumn("label", F.row_number().over(Window.orderBy("root")))
    return rooted.join(numbers, "root").select("y", F.explode(F.sequence("a", "b")).alias("x"), "label")
