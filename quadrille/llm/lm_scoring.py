"""Language-model scoring by cross-entropy difference.

A target model (documents labelled of good quality) and a background model (all documents) are
interpolated bigram models of the same order and smoothing over one shared vocabulary, which is
every word of the corpus; each token's loss under the one less its loss under the other, averaged over
a document, is its score (below zero: more like the target).

A word's probability is ``p(w) = (c(w) + MASS * b(w)) / (N + MASS)`` with its share ``b(w)`` of all
words (so it is that share in the background), a bigram's ``(c(v, w) + MASS * p(w)) / (c(v) + MASS)``.
Bigrams that stand fewer than ``LEAST`` times in the corpus count as unseen in both models, at every
size of the corpus. Neither words nor bigrams are capped, and no model is sent to the tasks:

1. Documents are encoded in blocks (a block's distinct words once, tokens as numbers) and written.
2. A block asks for its distinct words and bigrams, by 64-bit hash, with its own counts. Questions are
   packed by ranges of hashes (buckets), whose number grows with the corpus.
3. A bucket adds the counts up and answers each block, in the order of its question.
4. Answers meet their block, which scores its documents.

A word as frequent as can be is asked for once a block, so no key is hot. A task holds one block
or one bucket.

Defined results: null and wordless texts have no tokens, null losses and score; null ids are
never labelled; repeated rows are counted and scored each; repeated labels count once; without any
labelled document the target model is the words' shares. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import stored, table
from quadrille.llm.decontaminate import words_of

MASS, LEAST = 20.0, 1
#: Labelled ids that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Tokens and documents after which a block ends, and tokens of the corpus for each bucket.
BLOCK_TOKENS, BLOCK_DOCS, BUCKET_TOKENS = 2_000_000, 100_000, 500_000

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BLOCK = "block long, ids array<long>, sizes array<long>, target array<boolean>, n_words long, words binary, n_tokens long, n_target long, tokens binary"
_ASK = "bucket long, block long, size long, keys binary, n binary, t binary"
_TELL = "block long, bucket long, size long, n binary, t binary"
_SCORE = "doc_id long, n_tokens long, background_bits double, target_bits double, score double"
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return pa.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpack(data: bytes, size: int, kind: type) -> np.ndarray:
    if not size:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX[1:]:
        x = (x ^ (x >> np.uint64(30))) * m
    return x ^ (x >> np.uint64(31))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, target``: whether the document has a label of quality 1."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("_lm_id")).filter("_lm_id IS NOT NULL").distinct()
    side = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.join(side, slim["doc_id"] == side["_lm_id"], "left").select("doc_id", "text", F.col("_lm_id").isNotNull().alias("target"))


def encoded(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of ``docs`` (see :func:`flagged`). Each document with words ends with word 0, the empty one."""
    schema = _schema(_BLOCK)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        seen, ids, sizes, target, tokens, held = {b"": 0}, [], [], [], [], 0

        def out() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
            own = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            row = (number, ids, sizes, target, len(words), pack(words), len(own), sum(s for s, g in zip(sizes, target, strict=True) if g), pack(own))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

        for batch in batches:
            for i, text, good in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = words_of(text.as_py())
                if words:
                    words.append(b"")
                    tokens.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
                ids.append(i)
                sizes.append(len(words))
                target.append(good)
                held += len(words)
                if held >= block_tokens or len(ids) >= BLOCK_DOCS:
                    yield out()
                    number += 1
                    seen, ids, sizes, target, tokens, held = {b"": 0}, [], [], [], [], 0
        if ids:
            yield out()

    return docs.select("doc_id", "text", "target").mapInArrow(encode, _BLOCK)


class Block:
    """A block's tokens and its distinct bigrams; the order of its questions is that of their hashes."""

    def __init__(self, row: dict):
        self.ids, self.sizes, self.target = row["ids"], np.array(row["sizes"], np.int64), np.array(row["target"], bool)
        self.words = unpack(row["words"], row["n_words"], np.uint64)
        self.after = unpack(row["tokens"], row["n_tokens"], np.int32).astype(np.int64)
        before = np.append(0, self.after)[:-1]
        codes, self.pair = np.unique(before * len(self.words) + self.after, return_inverse=True)
        self.v, self.w = codes // len(self.words), codes % len(self.words)
        with np.errstate(over="ignore"):
            pairs = _mixed(_mixed(self.words[self.v] + _MIX[0]) + self.words[self.w])
            keys = np.concatenate((pairs, _mixed(self.words)))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self, weights: np.ndarray | None) -> np.ndarray:
        """Counts of the bigrams and words, in the order of questions."""
        both = [np.bincount(x, weights, n) for x, n in ((self.pair, len(self.v)), (self.after, len(self.words)))]
        return np.concatenate(both)[self.order].astype(np.int64)

    def bits(self, n: np.ndarray, t: np.ndarray, total: tuple[int, int], least: int) -> np.ndarray:
        """Loss of each distinct bigram under both models, by the corpus's counts in the order of questions."""
        found = np.empty((2, len(self.order)))
        found[:, self.order] = n, t
        pair, word = np.split(found, [len(self.v)], axis=1)
        pair = np.where(pair[0] >= least, pair, 0)
        share = word[0] / total[0]
        p = (word + MASS * share) / (np.array([total]).T + MASS)
        return -np.log2((pair + MASS * p[:, self.w]) / (word[:, self.v] + MASS))


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of equal ``key``, which come one after another."""
    held: list[dict] = []
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def answers(blocks: DataFrame, buckets: int) -> DataFrame:
    """Corpus counts of what each block asks for, by block and bucket; ``buckets`` is a power of two."""
    bits, ask, tell = buckets.bit_length() - 1, _schema(_ASK), _schema(_TELL)

    def question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (row,) in _grouped(batches, "block"):
            b = Block(row)
            bucket = b.keys >> np.uint64(64 - bits) if bits else np.zeros(len(b.keys), np.uint64)
            start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            n, t = b.counts(None), b.counts(np.repeat(b.target, b.sizes).astype(float))
            rows = []
            for a, e in zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True):
                keys = np.diff(b.keys[a:e], prepend=np.uint64(0))
                rows.append((int(bucket[a]), row["block"], e - a, pack(keys), pack(n[a:e]), pack(t[a:e])))
            yield _rows(rows, ask)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "bucket"):
            keys = np.concatenate([np.cumsum(unpack(r["keys"], r["size"], np.uint64), dtype=np.uint64) for r in rows])
            _, at = np.unique(keys, return_inverse=True)
            n, t = (np.bincount(at, np.concatenate([unpack(r[c], r["size"], np.int64) for r in rows])).astype(np.int64)[at] for c in ("n", "t"))
            ends = np.cumsum([r["size"] for r in rows])[:-1]
            yield _rows([(r["block"], r["bucket"], r["size"], pack(x), pack(y)) for r, x, y in zip(rows, np.split(n, ends), np.split(t, ends), strict=True)], tell)

    parts = min(buckets, max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 16))
    return blocks.mapInArrow(question, _ASK).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, _TELL)


def score(docs: DataFrame, least: int = LEAST, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``doc_id, n_tokens, background_bits, target_bits, score`` of every row of ``docs`` (see :func:`flagged`)."""
    blocks, schema = stored(encoded(docs, block_tokens)), _schema(_SCORE)
    n_blocks, *total = blocks.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    buckets = 1 << (total[0] // bucket_tokens).bit_length()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, *told in _grouped(batches, "block"):
            b = Block(first)
            n, t = (np.concatenate([unpack(r[c], r["size"], np.int64) for r in told]) if told else np.zeros(0, np.int64) for c in ("n", "t"))
            full = np.flatnonzero(b.sizes)
            mean = np.zeros((2, 0))
            if len(full):
                starts = (np.cumsum(b.sizes) - b.sizes)[full]
                mean = np.add.reduceat(b.bits(n, t, total, least)[:, b.pair], starts, axis=1) / b.sizes[full]
            rows = [(i, 0, None, None, None) for i in b.ids]
            for at, x, y in zip(full.tolist(), *mean.tolist(), strict=True):
                rows[at] = (b.ids[at], int(b.sizes[at]) - 1, x, y, y - x)
            yield _rows(rows, schema)

    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks // 4)
    met = blocks.withColumn("bucket", F.lit(-1).cast("long")).unionByName(answers(blocks, buckets), allowMissingColumns=True)
    return met.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(judge, _SCORE)


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return score(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
