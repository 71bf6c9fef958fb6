"""The driver's tables as planes and cubes: nodata is null, values are doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.scalar import valid
from quadrille.operators import project


def emb_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector form: a row a line."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("y"), F.col("embedding").alias("values"))


def emb_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.samples(emb_rows(spark, sf_dir)).withColumn("v", valid(F.col("v")))


def emb_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``z`` a vector, its 64 places an 8 x 8 plane."""
    return emb_plane(spark, sf_dir).select(F.col("y").alias("z"), F.expr("CAST(x DIV 8 AS INT)").alias("y"), (F.col("x") % 8).alias("x"), "v")


def emb_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as channels with centres 400 + 10 * channel."""
    return emb_plane(spark, sf_dir).select("y", F.col("x").alias("channel"), (F.col("x") * 10.0 + 400).alias("centre"), "v")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by part (line) and line number (column): a grid with holes."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy(F.col("l_partkey").cast("int").alias("y"), (F.col("l_linenumber") - 1).alias("x")).agg(F.avg("l_extendedprice").alias("v"))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed values by day of month less one (line) and hour (column)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy((F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")).agg(F.sum("value").alias("v"))
