"""New raster files as a stream: each micro-batch is handed to a function of line tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quadrille.sources.files import LINES, _lines


def follow(spark: SparkSession, path: str, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query over the files that arrive under ``path``. ``once``: end when what is there is done."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    writer = files.select("path", "content").mapInPandas(_lines, LINES).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
