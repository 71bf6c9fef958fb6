"""Benchmark decontamination with an FM-index per shard of training text.

A shard is the word sequence of many documents (or of a part of a very long one), with words that
no benchmark item has and the documents' ends as separators, which no phrase holds; runs of
separators are one symbol. From the shard's suffix order come the Burrows-Wheeler transform, a wavelet tree over
its symbols for rank queries, and suffix positions sampled at every ``SAMPLE``-th place. All test
phrases are searched at once, backwards, one rank pair a step and a phrase; their occurrences are
located by stepping to the next sampled position, mapped to documents, and merged into spans.

A phrase is a window of ``WINDOW`` consecutive words of an item, or the whole of a shorter item.

Defined results: null and wordless texts and items have no words and no hits; null ids pass
through; repeated rows are judged apart; an empty benchmark hits nothing; a null item id is the empty string. Documents don't move:
only the benchmark's phrases are sent to the tasks, in blocks of ``BLOCK_WORDS`` words of items, and a
block that passes the bound starts the next pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import table

WINDOW, SAMPLE = 10, 16
#: Words of a shard at most; longer documents are cut with an overlap of a window less a word.
SHARD_WORDS = 1 << 19
#: Words of benchmark items searched in one pass at most: the bound of what is sent to tasks.
BLOCK_WORDS = 4_000_000

_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Phrases:
    """The distinct windows of some items: vocabulary, symbol matrix, and items by phrase."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text))
            for k in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(ids[k : k + window], set()).add(item)
        self.items = [sorted(v) for v in found.values()]
        self.length = np.array([len(p) for p in found], dtype=np.int64)
        self.symbols = np.zeros((len(found), window), dtype=np.int64)
        for k, p in enumerate(found):
            self.symbols[k, window - len(p) :] = p  # right-aligned: backward search starts at the right

    def __len__(self) -> int:
        return len(self.items)


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s`` by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.concatenate(([True], s[order][1:] != s[order][:-1]))
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = head
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))  # places in `order` with ties
    step = 1
    while len(open_):
        at = order[open_]
        nxt = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + nxt
        by = np.argsort(key, kind="stable")
        order[open_] = at[by]
        key = key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        place = np.maximum.accumulate(np.where(new, open_, 0))
        rank[order[open_]] = place
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class Wavelet:
    """Wavelet tree (matrix form) over integer symbols: how often a symbol stands before a place."""

    BLOCK = 64

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.n = bits, len(s)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.zeros: list[int] = []
        for b in range(bits - 1, -1, -1):
            bit = ((s >> b) & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
            self.levels.append((words, ranks))
            self.zeros.append(self.n - int(bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    @staticmethod
    def _ones(level: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        words, ranks = level
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ranks[w] + np.bitwise_count(words[w] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before place ``at``."""
        low, high = np.zeros_like(at), at.copy()
        for k, level in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            lo1, hi1 = self._ones(level, low), self._ones(level, high)
            low = np.where(one, self.zeros[k] + lo1, low - lo1)
            high = np.where(one, self.zeros[k] + hi1, high - hi1)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for k, level in enumerate(self.levels):
            words, _ = level
            bit = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            out = (out << 1) | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out


class FMIndex:
    """Over symbols from 2; 1 separates, and one 0, the least, ends the sequence."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = SAMPLE):
        order = suffix_order(s)
        bwt = s[order - 1]  # the first place follows the last, which is an end
        self.wavelet = Wavelet(bwt, max(1, int(symbols).bit_length()))
        self.below = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols + 1))))
        self.n, self.sample = len(s), sample
        self.sampled = Wavelet(((order % sample) == 0).astype(np.int64), 1)
        self.positions = order[order % sample == 0]

    def ranges(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of right-aligned phrases, by backward search."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(1, width + 1):
            live = np.flatnonzero((length >= k) & (low < high))
            c = phrases[live, width - k]
            low[live] = self.below[c] + self.wavelet.rank(c, low[live])
            high[live] = self.below[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by stepping back to sampled positions."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        for _ in range(self.sample + 1):
            here = self.sampled.symbol(at[live]) == 1
            done = live[here]
            out[done] = (self.positions[self.sampled.rank(np.ones(len(done), np.int64), at[done])] + steps[done]) % self.n
            live = live[~here]
            if not len(live):
                break
            c = self.wavelet.symbol(at[live])
            at[live] = self.below[c] + self.wavelet.rank(c, at[live])
            steps[live] += 1
        return out


def search_shard(texts: Iterable[list[bytes]], phrases: Phrases, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Occurrences in each text: starts (word numbers), ends and phrase numbers. Of ``texts`` one is held at a time, as words take many times their bytes."""
    found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
    ids, docs, places, held = [], [], [], 0

    def flush() -> None:
        nonlocal ids, docs, places, held
        if not ids:
            return
        s = np.concatenate([*(np.append(x, 1) for x in ids), [0]]).astype(np.int64)
        place = np.concatenate([np.append(x, 0) for x in places])
        doc = np.repeat(np.array(docs), [len(x) + 1 for x in ids])
        if (s > 1).any():
            index = FMIndex(s, len(phrases.vocabulary) + 1)
            low, high = index.ranges(phrases.symbols, phrases.length)
            count = high - low
            hit = np.flatnonzero(count)
            rows = np.repeat(low[hit], count[hit]) + np.arange(count.sum()) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            at, which = index.locate(rows), np.repeat(hit, count[hit])
            by = np.argsort(doc[at], kind="stable")
            at, which = at[by], which[by]
            edges = np.flatnonzero(np.diff(doc[at])) + 1
            for part, w in zip(np.split(at, edges), np.split(which, edges), strict=True):
                if len(part):
                    found[doc[part[0]]].append((place[part], place[part] + phrases.length[w], w))
        ids, docs, places, held = [], [], [], 0

    get = phrases.vocabulary.get
    for number, words in enumerate(texts):
        found.append([])
        for start in range(0, max(1, len(words)), shard_words):
            part = words[start : start + shard_words + window - 1]
            x = np.fromiter((get(w, 1) for w in part), np.int64, len(part))
            keep = (x != 1) | (np.append(2, x[:-1]) != 1)  # one separator stands for a run
            ids.append(x[keep])
            places.append(np.flatnonzero(keep) + start)
            docs.append(number)
            held += int(keep.sum())
            if held >= shard_words:
                flush()
    flush()
    empty = np.zeros(0, np.int64)
    return [tuple(np.concatenate(c) for c in zip(*f, strict=True)) if f else (empty, empty, empty) for f in found]


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Word spans, merged where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(set(zip(starts.tolist(), ends.tolist(), strict=True))):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_OUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks; each row comes to the driver alone, and no more than a block is held."""
    block, held = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        held += len(words_of(r.t))
        if held >= block_words:
            yield block
            block, held = [], 0
    yield block


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id_col, n_words, spans, items`` for every row of ``docs``: merged word spans to remove, and the items found."""
    spark = docs.sparkSession
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    passes = []
    for block in _item_blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(Phrases(block, window))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            rows, texts, held = [], [], 0

            def out() -> pa.RecordBatch:
                made = []
                for (row, doc), words, (a, b, w) in zip(rows, texts, search_shard(texts, phrases, window), strict=True):
                    items = sorted({i for k in set(w.tolist()) for i in phrases.items[k]})
                    made.append({"row": row, "doc_id": doc, "n_words": len(words), "spans": [{"from": x, "to": y} for x, y in merged_spans(a, b)], "items": items})
                return pa.RecordBatch.from_pylist(made, schema=_OUT)

            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256).to_pydict()
                    for row, doc, text in zip(part["row"], part["doc_id"], part["text"], strict=True):
                        rows.append((row, doc))
                        texts.append(words_of(text))
                        held += len(texts[-1])
                        if held >= SHARD_WORDS:
                            yield out()
                            rows, texts, held = [], [], 0
            if rows:
                yield out()

        passes.append(slim.mapInArrow(search, "row long, doc_id long, n_words long, spans array<struct<from:long,to:long>>, items array<string>"))
    if len(passes) == 1:
        return passes[0].drop("row").withColumnRenamed("doc_id", id_col)
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    joined = every.groupBy("row").agg(F.first("doc_id").alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.array().cast("array<struct<from:bigint,to:bigint>>")

    def add(runs, s):
        last = F.element_at(runs, -1)
        longer = F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to")))
        return F.when((F.size(runs) > 0) & (last["to"] >= s["from"]), F.concat(F.slice(runs, 1, F.size(runs) - 1), longer)).otherwise(F.concat(runs, F.array(s)))

    return joined.withColumn("spans", F.aggregate("spans", empty, add)).drop("row")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given word spans; what stood around a span is parted by a space."""
    data = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_WORDS))]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : words[a][0]])
        at = words[b - 1][1]
    return b" ".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def remove_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the benchmark's passages cut out of ``text_col``, other columns as they are; rows left without words by the cut go.

    All blocks of the benchmark are searched in the text as it came, one pass each, without a shuffle; the passes add
    their spans to a column, and the last one merges and cuts them.
    """
    spark, place, spans = docs.sparkSession, docs.columns.index(text_col), "_dc_spans"
    schema, names = docs.schema, docs.columns
    wide = T.StructType([*schema.fields, T.StructField(spans, T.ArrayType(T.LongType()))])

    def searched(rows: DataFrame, block: list, last: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(Phrases(block, window))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(place).to_pylist()
                # starts and ends in turn, of the blocks before
                known = [np.array(x or (), np.int64) for x in batch.column(len(names)).to_pylist()] if batch.num_columns > len(names) else [np.zeros(0, np.int64)] * len(texts)
                found = [np.concatenate([x, np.column_stack([a, b]).astype(np.int64).ravel()]) for x, (a, b, _) in zip(known, search_shard(map(words_of, texts), sent.value, window), strict=True)]
                columns = batch.columns[: len(names)]
                if not last:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], names=[*names, spans])
                    continue
                keep = np.ones(len(texts), bool)
                for k, x in enumerate(found):
                    if len(x):
                        texts[k] = cut(texts[k], merged_spans(x[::2], x[1::2]))
                        keep[k] = bool(words_of(texts[k]))
                columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

        return rows.mapInArrow(find, schema if last else wide)

    held = None
    for block in _item_blocks(benchmark, block_words):
        if held is not None:
            docs = searched(docs, held, False)
        held = block
    return searched(docs, held, True)


def op1_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT g.r, g.i, g.n, p.item FROM g JOIN p USING (phrase, n)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
