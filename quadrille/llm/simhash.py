"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits. If two fingerprints
differ in at most two bits, one segment is equal (pigeonhole), and the next one, padded to 23
bits, differs in at most two. The binary Golay code is perfect: every 23-bit word is within 3 bits
of exactly one codeword. A word at distance 3 gets that codeword and the five at distance 4 as keys, a
nearer one only its own; then any two words that differ in at most two bits share a key. So the keys
(equal segment, codeword of the next) find every link; candidates that share a key are joined and
verified by their differing bits.

Keys with more than ``HOT`` fingerprints are not joined with themselves: below such a key every
fingerprint names its one-bit neighbours, and those that share a neighbour, thus differ in at most two
bits, link to the least of them. That is exact, and linear in the group.

Defined results: null and wordless texts have fingerprint zero and link like any other; equal
fingerprints are one class however many documents carry them; null ids stay, and count for a
component's least id only if it has no other; repeated rows stay; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import pinned, table, text_or_empty
from quadrille.llm.components import connected_components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
WIDTHS = (22, 21, 21)
#: Fingerprints of a key that are compared pair by pair at most.
HOT = 32
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        rows = (b" ".join(part[i : i + shingle]) for i in range(max(1, len(part) - shingle + 1)))
        hashes = np.fromiter((digest(x, SEED) for x in rows), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x = np.where((x >> bit) & 1 == 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


def _near() -> np.ndarray:
    """By syndrome: the error patterns to the codewords that are a word's keys, filled up by the first."""
    every = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], dtype=np.int64)
    out = np.zeros((2048, 6), np.int64)
    filled, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    for pattern, s in zip(every.tolist(), syndrome(every).tolist(), strict=True):
        w = pattern.bit_count()
        if filled[s] == 0:
            out[s], filled[s], weight[s] = pattern, 1, w
        elif w == 4 and weight[s] == 3:
            out[s, filled[s]] = pattern
            filled[s] += 1
    return out


NEAR = _near()


def codewords(x: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the keys of 23-bit words; six columns, repeats where there are fewer."""
    return (x[:, None] ^ NEAR[syndrome(x)]) >> 11


def segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for w in WIDTHS:
        out.append(((fp.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    return out


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (signed 64-bit), and the number of the fingerprint each belongs to."""
    parts, keys, owners = segments(fp), [], []
    for family in range(3):
        exact, fuzzy = parts[family], codewords(parts[(family + 1) % 3])
        key = ((family << 34) | (exact << 12))[:, None] | fuzzy
        new = np.concatenate([np.ones((len(fp), 1), bool), fuzzy[:, 1:] != fuzzy[:, :1]], axis=1)
        own, column = np.nonzero(new)
        keys.append(key[own, column])
        owners.append(own)
    return np.concatenate(keys), np.concatenate(owners)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(compute, "doc_id long, text_hash long, fp long")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints (column ``fp``) that connect exactly those linked by two bits or fewer."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            key, owner = golay_keys(fp)
            yield pd.DataFrame({"key": key, "fp": fp[owner]})

    keys = fps.select("fp").mapInPandas(keyed, "key long, fp long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    multi = pinned(keys.join(shared, "key"))
    cold = multi.filter(F.col("n") <= hot).select("key", "fp")
    pairs = cold.alias("a").join(cold.alias("b"), "key").filter("a.fp < b.fp").select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    found = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)

    # Below a hot key, without the codeword: family and equal segment stay together.
    exact = multi.filter(F.col("n") > hot).select(F.shiftright("key", 12).alias("part"), "fp").distinct()

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = np.cumsum((0, *WIDTHS))
        masks = [np.array([0, *(1 << int(b) for b in range(64) if not begin[f] <= b < begin[f + 1])], dtype=np.uint64).view(np.int64) for f in range(3)]
        for batch in batches:
            part, fp = batch["part"].to_numpy(), batch["fp"].to_numpy()
            for f in range(3):
                own = part >> 22 == f
                if own.any():
                    near = (fp[own][:, None] ^ masks[f]).ravel()
                    yield pd.DataFrame({"part": np.repeat(part[own], len(masks[f])), "near": near, "fp": np.repeat(fp[own], len(masks[f]))})

    named = exact.mapInPandas(neighbours, "part long, near long, fp long")
    centre = named.groupBy("part", "near").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = named.join(centre, ["part", "near"]).filter("fp != v").select(F.col("fp").alias("u"), "v")
    return found.unionByName(stars).distinct()


def components(prints: DataFrame) -> DataFrame:
    """``fp, component_id`` for the distinct fingerprints of ``prints`` (``doc_id, fp``; pinned)."""
    fps = pinned(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(fps)).withColumnRenamed("node", "fp")
    grouped = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return grouped.join(least, "root").select("fp", "root", "component_id")


def first_of_each(docs: DataFrame, placed: DataFrame, sided: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``docs`` with one row of each root of ``placed`` (``doc_id, text_hash, root, component_id`` of every row); ``sided`` may mark the table of these rows for a broadcast."""
    kept = placed.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash", "root")
    each = pinned(kept.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"), F.count("*").alias("n")).select(F.col("k.doc_id").alias("_sim_id"), F.col("k.text_hash").alias("_sim_hash"), "n"))
    found = docs.withColumn("_sim_h", F.xxhash64(text_or_empty()))
    rows = found.join(sided(each), F.col("doc_id").cast("long").eqNullSafe(F.col("_sim_id")) & (F.col("_sim_h") == F.col("_sim_hash")), "left_semi")
    if each.filter("n > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "_sim_h"])
    return rows.drop("_sim_h")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the least ``doc_id``. Columns as they are."""
    prints = pinned(fingerprints(docs))
    return first_of_each(docs, prints.join(components(prints), "fp"))


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    prints = pinned(fingerprints(table(spark, sf_dir, "documents")))
    return prints.join(components(prints), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
