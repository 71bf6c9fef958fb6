"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents, shuffled by a keyed hash, form one stream of words, cut into blocks of
equal word counts. A schedule of ``2^m`` slots visits the van der Corput points (slot numbers
with their bits reversed); a point falls into a source's share of the cumulative weights, and a
slot's rank within its source names the stream block it takes, again from the first block once
the stream is used up. Since all ``2^m`` points are visited, each source gets exactly the slots
its share holds; the last one is cut, so that a source's taken words equal its rounded target.

Defined results: null text has no words; documents without words take none; the null source is
a source of its own and the last; repeated ids are kept apart as rows; equal keys in the shuffle
order are told apart by size only (then the rows are interchangeable); empty tables give no rows.
Only the per-source table is gathered on the driver; over ``MAX_SOURCES`` sources is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, pinned, table, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
MAX_SOURCES = 100_000
#: Words of a block at least, and slots of a schedule about at most: blocks grow with the corpus.
MIN_BLOCK, MAX_SLOTS = 64, 1 << 26
SEED = "mix-1"


@dataclass(frozen=True)
class Source:
    name: str | None
    index: int
    size: int
    weight: int
    target: float

    @property
    def words(self) -> int:
        """Whole words to take."""
        return min(int(self.target + 0.5), CAP * self.size)


def targets(sizes: list[int], weights: list[int], total: float, cap: float = CAP) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess is reshared.

    The result is ``min(cap * size, level * weight)``; sources reach their caps in the order of
    ``cap * size / weight``.
    """
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    capped, open_weight, level = 0, sum(weights), 0.0
    for i in order:
        level = (total - capped) / open_weight
        if level <= cap * sizes[i] / weights[i]:
            break
        capped += cap * sizes[i]
        open_weight -= weights[i]
    else:
        level = float("inf")
    return [min(float(cap * s), level * w) for s, w in zip(sizes, weights, strict=True)]


def plan_sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> list[Source]:
    """One entry a source, in code point order, the null source last. ``sized``: ``source``, ``size``."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix over a coarser column")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes, each = [int(r.size) for r in rows], [weights[i % len(weights)] for i in range(len(rows))]
    goal = targets(sizes, each, share * sum(sizes))
    return [Source(r.source, i, s, w, t) for i, (r, s, w, t) in enumerate(zip(rows, sizes, each, goal, strict=True))]


def block_words(plan: list[Source]) -> int:
    return max(MIN_BLOCK, -(-sum(s.words for s in plan) // MAX_SLOTS))


def _slots(source: Source, block: int) -> int:
    """Slots that a source needs: whole passes over its blocks, then the rest."""
    if not source.size:
        return 0
    passes, rest = divmod(source.words, source.size)
    return passes * -(-source.size // block) + -(-rest // block)


def _reversed_bits(x: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(m):
        out, x = (out << 1) | (x & 1), x >> 1
    return out


def _before(t: np.ndarray, bound: np.ndarray, m: int) -> np.ndarray:
    """How many slots before ``t`` have a point under ``bound`` (both arrays; points in units of 2^-m).

    Slots before ``t`` fall into one block for each set bit of ``t``; the points of a block are
    the numbers congruent to one value.
    """
    count = np.zeros_like(t)
    for bit in range(m):
        has = (t >> bit) & 1
        step = 1 << (m - bit)
        first = _reversed_bits(((t >> bit) ^ 1) << bit, m)
        count += has * np.maximum(0, (bound - first + step - 1) // step)
    return count


def schedule(spark: SparkSession, plan: list[Source], block: int) -> DataFrame:
    """The mix's slots in order: ``slot, source_index, epoch, block, take`` (words from the block's start)."""
    need = np.array([_slots(s, block) for s in plan], dtype=np.int64)
    ends = np.cumsum(need) if len(plan) else np.zeros(0, np.int64)
    total = int(ends[-1]) if len(plan) else 0
    m = max(0, (total - 1).bit_length()) if total else 0
    size = np.array([s.size for s in plan], dtype=np.int64)
    words = np.array([s.words for s in plan], dtype=np.int64)
    blocks = -(-size // block)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t = batch["id"].to_numpy()
            point = _reversed_bits(t.copy(), m)
            t = t[keep := point < total]
            s = np.searchsorted(ends, point[keep], side="right")
            rank = _before(t, ends[s], m) - _before(t, ends[s] - need[s], m)
            epoch, at = np.divmod(rank, np.maximum(blocks[s], 1))
            take = np.minimum(np.minimum(block, size[s] - at * block), words[s] - epoch * size[s] - at * block)
            yield pd.DataFrame({"slot": t, "source_index": s.astype(np.int32), "epoch": epoch.astype(np.int32), "block": at, "take": take})

    return spark.range((1 << m) if total else 0).mapInPandas(fill, "slot long, source_index int, epoch int, block long, take long")


def _source_table(spark: SparkSession, plan: list[Source]) -> DataFrame:
    rows = [(s.name, s.index, s.size, s.target) for s in plan]
    return F.broadcast(spark.createDataFrame(rows, "_mx_name string, source_index int, source_size long, target double"))


def streams(df: DataFrame, plan: list[Source], id_col: str = "doc_id", seed: str = SEED) -> DataFrame:
    """``df`` (with ``source`` and ``size``) plus its source's columns and ``start``, each row's place in its source's shuffled stream.

    Running sums within buckets of the shuffle order, over their offsets: a hot source spreads
    over 4096 buckets.
    """
    keyed = df.join(_source_table(df.sparkSession, plan), F.col("source").eqNullSafe(F.col("_mx_name"))).drop("_mx_name")
    keyed = keyed.withColumn("_mx_key", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)).cast("binary"))).withColumn("_mx_bucket", F.substring("_mx_key", 1, 3))
    bucket = ["source_index", "_mx_bucket"]
    sums = keyed.groupBy(*bucket).agg(F.sum("size").alias("_mx_sum"))
    offsets = sums.select(*bucket, (F.sum("_mx_sum").over(Window.partitionBy("source_index").orderBy("_mx_bucket")) - F.col("_mx_sum")).alias("_mx_offset"))
    local = F.sum("size").over(Window.partitionBy(*bucket).orderBy("_mx_key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return keyed.withColumn("_mx_local", local).join(offsets, bucket).withColumn("start", F.col("_mx_offset") + F.col("_mx_local")).drop("_mx_key", "_mx_bucket", "_mx_local", "_mx_offset")


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` cut at the blocks' bounds: adds ``block``, ``from`` (in the block) and ``words``."""
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    begins = F.greatest(F.col("start"), F.col("block") * block)
    return cut.withColumn("from", begins - F.col("block") * block).withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - begins)


def with_sizes(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("size", F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long"))


def mixed(placed: DataFrame, plan: list[Source], columns: list[str]) -> DataFrame:
    """The mix: ``columns`` of each piece's document, with ``slot``, ``epoch`` and the ``words`` that the slot takes of it.

    A piece that no slot takes stays, with null for the three.
    """
    block = block_words(plan)
    keep = list(dict.fromkeys([*columns, "source_index", "start"]))
    cut = pieces(placed, block).select(*keep, "block", "from", F.col("words").alias("_mx_words"))
    slots = schedule(placed.sparkSession, plan, block)
    words = F.least(F.col("_mx_words"), F.col("take") - F.col("from"))
    return cut.join(slots, ["source_index", "block"], "left").withColumn("words", F.when(F.col("take") > F.col("from"), words)).select(*columns, "slot", "epoch", "words")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mix in whole documents: a row of ``docs`` stands as often as slots take its first word, up to twice.

    Columns stay as they are; rows without words go. Rows that agree in id, source and text share their
    repeats, rounded up.
    """
    key = F.xxhash64(F.col("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), text_or_empty())
    sized = pinned(with_sizes(docs.select(key.alias("key"), "source", "text")).drop("text").filter("size > 0"))
    plan = plan_sources(sized)
    block = block_words(plan)
    first = streams(sized, plan, id_col="key").select("key", "source_index", F.expr(f"start div {block}").alias("block"), F.expr(f"start % {block}").alias("from"))
    taken = first.join(schedule(docs.sparkSession, plan, block), ["source_index", "block"]).filter(F.col("take") > F.col("from"))
    times = taken.groupBy("key").agg(F.count("*").alias("n")).join(sized.groupBy("key").agg(F.count("*").alias("rows")), "key")
    copies = times.select(F.col("key").alias("_mx_key"), F.ceil(F.col("n") / F.col("rows")).cast("int").alias("_mx_copies"))
    found = docs.withColumn("_mx_own", key).join(copies, F.col("_mx_own") == F.col("_mx_key"))
    return found.withColumn("_mx_at", F.explode(F.sequence(F.lit(1), F.col("_mx_copies")))).drop("_mx_own", "_mx_key", "_mx_copies", "_mx_at")


def op10_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with the first slot of the schedule that takes some and the number of such slots. Texts are read once; ids, sources and sizes go on."""
    sized = pinned(with_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    plan = plan_sources(sized)
    facts = ["doc_id", "size", "source_size", "target"]
    # A row is told from its repeats by its place in the stream, as far as it has words.
    used = mixed(streams(sized.filter("size > 0"), plan), plan, [*facts, "source_index", "start"])
    taken = used.groupBy(*facts, "source_index", "start").agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot"), F.count_if(F.col("words") > 0).cast("long").alias("slots"))
    nothing = (F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("slots"))
    none = sized.filter("size = 0").join(_source_table(spark, plan), F.col("source").eqNullSafe(F.col("_mx_name"))).select(*facts, *nothing)
    return taken.select(*facts, "taken", "first_slot", "slots").unionByName(none)


#: The van der Corput points are made here once more, in SQL, and the words follow from the slots.
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, sum(2 * source_size) OVER q - 2 * source_size AS capped, sum(weight) OVER () - sum(weight) OVER q + weight AS open_weight,
      sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w WINDOW q AS (ORDER BY (2 * source_size)::DOUBLE / weight, i)),
l AS (SELECT (total - capped)::DOUBLE / open_weight AS level FROM o WHERE (total - capped)::DOUBLE / open_weight <= (2 * source_size)::DOUBLE / weight
      ORDER BY (2 * source_size)::DOUBLE / weight, i LIMIT 1),
t AS (SELECT w.source, w.i, w.source_size, least((2 * w.source_size)::DOUBLE, coalesce((SELECT level FROM l), 'inf'::DOUBLE) * w.weight) AS target FROM w),
a AS (SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS words FROM t),
b AS (SELECT greatest({MIN_BLOCK}, ((sum(words) + {MAX_SLOTS - 1}) // {MAX_SLOTS}))::BIGINT AS b FROM a),
n AS (SELECT a.*, b.b, CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * ((source_size + b - 1) // b) + (words % source_size + b - 1) // b END AS need FROM a, b),
e AS (SELECT *, sum(need) OVER (ORDER BY i) AS hi, sum(need) OVER (ORDER BY i) - need AS lo FROM n),
m AS (SELECT CASE WHEN sum(need) > 1 THEN len(bin((sum(need) - 1)::BIGINT)) ELSE 0 END::INT AS m FROM n),
v AS (SELECT slot, coalesce(list_sum(list_transform(range(m), lambda k: ((slot >> k::INT) & 1) << (m - 1 - k)::INT)), 0) AS point FROM (SELECT m, unnest(range((1::BIGINT << m))) AS slot FROM m)),
k AS (SELECT slot, i, b, source_size, words, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS rank FROM v JOIN e ON point >= lo AND point < hi),
g AS (SELECT slot, i, b, rank % ((source_size + b - 1) // b) AS block, rank // ((source_size + b - 1) // b) AS epoch, source_size, words FROM k),
x AS (SELECT slot, i, block, least(b, source_size - block * b, words - epoch * source_size - block * b) AS take FROM g),
p AS (SELECT d.r, d.size, e.i, e.b, sum(d.size) OVER (PARTITION BY e.i ORDER BY md5(concat_ws(':', '{SEED}', d.doc_id)), d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT r, i, b, size, start, unnest(range((start // b)::BIGINT, ((start + size - 1) // b + 1)::BIGINT)) AS block FROM p WHERE size > 0),
f AS (SELECT c.r, x.slot, least(start + size, (c.block + 1) * b) - greatest(start, c.block * b) AS piece, x.take - (greatest(start, c.block * b) - c.block * b) AS room FROM c JOIN x ON c.i = x.i AND c.block = x.block),
u AS (SELECT r, sum(least(piece, room)) AS taken, min(slot) AS first_slot, count(*) AS slots FROM f WHERE room > 0 GROUP BY r)
SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target, coalesce(u.taken, 0)::BIGINT AS taken, u.first_slot::BIGINT AS first_slot, coalesce(u.slots, 0)::BIGINT AS slots
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN u USING (r)
"""
