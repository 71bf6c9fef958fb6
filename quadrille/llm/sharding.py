"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's global number is its rank by a content hash; the permutation scatters the numbers over
``0 .. n-1`` without a table, so shard and slot follow from the number alone, and the number
from shard and slot (:func:`shard_and_slot`, :func:`row_number_at`). Reruns agree, whatever the
partitioning. Shard counts are at most one apart.

Defined results: null text counts as empty; null ids are hashed like a value; rows that are
equal in every hashed column are interchangeable; an empty table gives no rows; other columns
pass through, whatever their names (the helper columns carry a reserved prefix).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import table, text_or_empty

#: Buckets of the hash order; their counts, a table of this size at most, are broadcast.
BUCKET_BITS = 14
ROUNDS = 4
SEED = 20260101
MASK = 0xFFFFFFFFFFFFFFFF


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """SplitMix64's finaliser, keyed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & MASK for i in range(ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of ``0 .. n-1``, or its inverse, at ``numbers``.

    The Feistel network permutes the smallest domain of an even number of bits that holds ``n``,
    under 4n; values that leave the range walk along their cycle until they come back.
    """
    half = np.uint64(_half_bits(n))
    low = np.uint64((1 << int(half)) - 1)
    keys = _keys(seed)[::-1] if inverse else _keys(seed)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for key in keys:
            if inverse:
                left, right = right ^ (_mix(left, key) & low), left
            else:
                left, right = right, left ^ (_mix(right, key) & low)
        return (left << half) | right

    out = network(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def shard_and_slot(number: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    place = int(permute(np.array([number]), n, seed)[0])
    return place % shards, place // shards


def row_number_at(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def with_row_numbers(df: DataFrame, by: list) -> tuple[DataFrame, int]:
    """Add ``_sh_row``, the rank by a hash of the columns ``by``; also return the number of rows.

    One shuffle of the rows by a prefix of the hash, in which buckets are ranked apart; a first
    pass over the hash alone gives the buckets' counts, hence their offsets.
    """
    hashed = df.withColumn("_sh_hash", F.xxhash64(*by)).withColumn("_sh_bucket", F.shiftrightunsigned("_sh_hash", 64 - BUCKET_BITS).cast("int"))
    counts = hashed.groupBy("_sh_bucket").agg(F.count("*").alias("_sh_n"))
    offsets = counts.select("_sh_bucket", (F.sum("_sh_n").over(Window.orderBy("_sh_bucket")) - F.col("_sh_n")).alias("_sh_offset"))
    n = int(counts.agg(F.sum("_sh_n")).first()[0] or 0)
    ranked = hashed.withColumn("_sh_rank", F.row_number().over(Window.partitionBy("_sh_bucket").orderBy("_sh_hash", *by)))
    numbered = ranked.join(F.broadcast(offsets), "_sh_bucket").withColumn("_sh_row", F.col("_sh_offset") + F.col("_sh_rank") - 1)
    return numbered.drop("_sh_hash", "_sh_bucket", "_sh_rank", "_sh_offset"), n


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Every row of ``df`` with ``shard`` and ``slot`` added (replaced, if it has such columns).

    Slots of a shard run from 0 without gaps.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = df.drop("shard", "slot")
    # Ties in the hash are broken by the values themselves, the text by two more numbers of it.
    by = [F.col(id_col), F.crc32(F.encode(text_or_empty(text_col), "UTF-8")), F.length(text_or_empty(text_col))]
    return _placed(kept, by, shards, seed)


def _placed(df: DataFrame, by: list, shards: int, seed: int) -> DataFrame:
    numbered, n = with_row_numbers(df, by)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), max(n, 1), seed))

    placed = numbered.withColumn("_sh_place", place("_sh_row"))
    return placed.withColumns({"shard": (F.col("_sh_place") % shards).cast("int"), "slot": F.floor(F.col("_sh_place") / F.lit(shards)).cast("long")}).drop("_sh_row", "_sh_place")


def op9_feistel_shards(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 shards, law ``rows``. Only ids, sizes and checksums are shuffled."""
    encoded = F.encode(text_or_empty(), "UTF-8")
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(encoded) + 16).cast("long").alias("size"), F.crc32(encoded).alias("text_crc32"))
    placed = _placed(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
