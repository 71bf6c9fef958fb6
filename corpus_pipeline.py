"""The corpus pipeline: five stages from raw documents to sharded training data.

Each stage reads the documents its predecessor kept; all but the last return the columns of
``documents``, the last adds ``shard`` and ``slot``. ``run`` writes every stage but the last as
Parquet in the shared checkpoint folder and reads it again, so that a lost executor costs one
stage's tasks at most.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, mixing, near_copies, quality, sharding
from quadrille.llm.common import table

SHARDS = 40


def sized(clean: DataFrame, docs: DataFrame) -> DataFrame:
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted without their host's frequent lines, and without those lines; ``n_chars`` follows the text."""
    return sized(quality.keep_good(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``; ``n_chars`` follows the text."""
    return sized(decontaminate.remove_passages(docs, table(spark, sf_dir, "benchmark")), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them, twice at most."""
    return mixing.repeat_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mix),
    ("sharding", shards),
]

#: MinHash and the Feistel permutation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    base, docs = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
