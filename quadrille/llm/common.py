"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace that separates words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests) a
    temporary folder is used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder (see :func:`pinned`): compressed, and read by column."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stored-")
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
