"""Raster files as DataFrames (one task a file) and back; also as a stream of new files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources import codecs

LINES = "path string, plane int, y int, values array<double>"


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"]):
            for plane, a in enumerate(codecs.decode(bytes(data), path)):
                a = a.astype(float)
                for at in range(0, len(a), 256):
                    rows = [[None if not np.isfinite(v) else float(v) for v in line] for line in a[at : at + 256]]
                    yield pd.DataFrame({"path": path, "plane": plane, "y": range(at, at + len(rows)), "values": rows})


def read_rasters(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Vector form, a row a line: ``path, plane, y, values``; nodata is null. Any path that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(_lines, LINES)


def identities(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256, crc32`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32"))


def encode_planes(df: DataFrame, format: str, by: str = "image", channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """One file a group: ``by``, ``content``. ``df``: ``by``, ``y``, ``x`` and channels, complete rectangles that fit a task."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = np.full((len(channels), int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), np.nan)
        for k, c in enumerate(channels):
            a[k, rows["y"], rows["x"]] = rows[c]
        return pd.DataFrame({by: [key[0]], "content": [codecs.encode(a, format)]})

    return df.groupBy(by).applyInPandas(pack, f"{by} {df.schema[by].dataType.simpleString()}, content binary")
