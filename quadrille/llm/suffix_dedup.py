"""Exact substring dedup with a logarithmic family of suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts earlier (in a document of
smaller id, or before in the same one). Texts are UTF-8; matches don't cross documents.

Suffixes that could match meet in one place: every string of ``LENGTH`` bytes holds one anchor, the
leftmost of its ``GRAM``-byte strings with the least hash, so equal strings have equal anchors.
Anchors are counted first, and only those whose hash stands twice or more go on (a bitmap of the
repeated hashes, of checked size, is sent to the tasks; beyond ``BITMAP_BITS`` they are joined). An
anchor goes with the text around it that its strings cover, to a bucket by its hash; what a task has met before
it drops at once, text and all. The strings of a hot anchor, one with more occurrences than a bucket should
hold, go each to a bucket by its own digest of 128 bits, so that a bucket holds the strings of few anchors or copies
of few strings.

A bucket reads its texts in document order, in batches. A batch's suffix array has the positions of its suffixes in
the order of a fingerprint of their first ``LENGTH`` bytes (strings needn't be made: only what is
equal over ``LENGTH`` bytes must stand together). The array is merge-scanned against itself and every level of the index;
what stands beside an earlier suffix is a match, compared byte by byte with the earlier text, run by run.
The rest becomes a new level, and levels of about equal size are merged, so that there are logarithmically many.

Defined results: null and empty texts have no bytes; texts shorter than ``LENGTH`` bytes lose none;
null ids come after all others; rows of one id count as documents in the order of a hash of their texts, so that
nothing depends on the order of rows; of rows that agree in id and text one is the first; other columns are not read.
Bytes that are left need not be valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import stored, table, text_or_empty

LENGTH, GRAM = 100, 32
#: Bits of the bitmap at most (32 MB), bits for each repeated hash, anchors of a bucket, anchors of a batch, and hot anchors at most.
BITMAP_BITS, BITS_EACH, BUCKET, BATCH, MOST_HOT = 1 << 28, 8, 24_000, 6_000, 1_000_000
#: Bytes whose anchors are found at a time, about.
PORTION = 12_000
#: Texts that a task remembers to drop their repeats.
REMEMBERED = 400_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_DIGEST = 16


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of ``texts`` in order: hash, number of the text, and the first and last start in it of the strings that an anchor stands in."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins, count = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
    if not count.any():
        return (np.zeros(0, np.int64),) * 4
    h = fingerprints(data, gram)
    least = h & np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(h), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    ends = np.cumsum(count)
    starts = np.repeat(begins - (ends - count), count) + np.arange(ends[-1])  # those of strings inside a text
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    text = np.searchsorted(ends, first, side="right")
    return h[at[first]].view(np.int64), text, starts[first] - begins[text], starts[last] - begins[text]


def _portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    """``texts`` in portions whose arrays stay in the processor's cache."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def fingerprints(data: bytes, length: int = LENGTH) -> np.ndarray:
    """A 64-bit fingerprint of the ``length`` bytes from each place of ``data`` on; by doubling, the last two parts may overlap."""
    size = 8 if length >= 8 else 1
    h = np.ndarray((len(data) - size + 1,), "<u8" if size == 8 else "u1", data, 0, (1,)).astype(np.uint64)
    step = 0
    with np.errstate(over="ignore"):
        while size < length:
            ahead = min(size, length - size)
            left, right = h[: len(h) - ahead] * _MIX[step % 4], h[ahead:] * _MIX[(step + 1) % 4]
            left += right
            np.right_shift(left, np.uint64(31), out=right)
            left ^= right
            h, size, step = left, size + ahead, step + 1
    return h


def merge_scan(level: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Where in ``level`` each of ``array`` stands, or -1; both sorted and without repeats: one merge of two runs."""
    both = np.concatenate((level, array))
    order = np.argsort(both, kind="stable")
    merged = both[order]
    twin = np.flatnonzero(merged[1:] == merged[:-1])
    out = np.full(len(array), -1, np.int64)
    out[order[twin + 1] - len(level)] = order[twin]
    return out


class IndexFamily:
    """Levels of suffix positions in the order of their fingerprints, each at most half as large as the one before."""

    def __init__(self, length: int = LENGTH, fingerprint=fingerprints) -> None:
        self.length, self.fingerprint = length, fingerprint
        self.texts = bytearray()
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # fingerprints, places in `texts`
        self.odd: set[bytes] = set()  # strings with the fingerprint of another one that came first

    def add(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """Runs ``text, from, to`` of the starts in ``texts`` (in order of arrival) whose strings came before; takes the new ones in."""
        data, base = b"".join(texts), len(self.texts)
        sizes = np.array([len(t) for t in texts])
        first, count = np.cumsum(sizes) - sizes, sizes - self.length + 1
        ends = np.cumsum(count)
        places = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
        keys = self.fingerprint(data, self.length)[places]
        self.texts += data
        order = np.argsort(keys)
        array, at = keys[order], places[order] + base
        head = np.append(True, array[1:] != array[:-1])
        heads = np.flatnonzero(head)
        least = np.minimum.reduceat(at, heads)
        distinct, earlier = array[heads], np.full(len(heads), -1, np.int64)
        for level, where in self.levels:
            found = merge_scan(level, distinct)
            earlier[found >= 0] = where[found[found >= 0]]
        new = earlier < 0
        if new.any():
            self._put(distinct[new], least[new])
        group = np.cumsum(head) - 1
        match = np.where(new[group] & (at != least[group]), least[group], earlier[group])
        partner = np.empty(len(match), np.int64)
        partner[order] = match
        return self._runs(places + base, partner, np.repeat(np.arange(len(texts)), count), first + base)

    def _put(self, keys: np.ndarray, where: np.ndarray) -> None:
        self.levels.append((keys, where))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            (k, w), (lk, lw) = self.levels.pop(), self.levels.pop()
            both = np.concatenate((lk, k))
            order = np.argsort(both, kind="stable")  # two sorted runs: one merge
            self.levels.append((both[order], np.concatenate((lw, w))[order]))

    def _runs(self, places: np.ndarray, partner: np.ndarray, text: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        marked = np.flatnonzero(partner >= 0)
        if not len(marked):
            return []
        p, q, t = places[marked], partner[marked], text[marked]
        cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1) | (np.diff(t) != 0)) + 1
        begins, stops = np.append(0, cut), np.append(cut, len(p)) - 1
        out: list[tuple[int, int, int]] = []
        own, n = self.texts, self.length
        for k, f, a, b, c, d in zip(t[begins].tolist(), first[t[begins]].tolist(), p[begins].tolist(), p[stops].tolist(), q[begins].tolist(), q[stops].tolist(), strict=True):
            if own[a : b + n] == own[c : d + n]:
                out.append((k, a - f, b - f + 1))
                continue
            for i in range(b - a + 1):  # a fingerprint that two strings share
                s = bytes(own[a + i : a + i + n])
                if s == own[c + i : c + i + n] or s in self.odd:
                    out.append((k, a + i - f, a + i - f + 1))
                else:
                    self.odd.add(s)
        return out


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_MET = pa.schema([("kh", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("u", pa.binary())])
_SPAN = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, row, text``; ``row`` is a hash of the text, so that a row is the same in every scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("row"), text_or_empty(text_col).alias("text"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(part)[0] for part in _portions([_bytes(t.as_py()) for t in batch.column(0)])]
        values, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(count)], names=["kh", "n"])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a bucket's rows (:data:`_MET`, in document order)."""
    family, digests, last = IndexFamily(), set(), None
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH).to_pydict()
            out: list[tuple] = []
            held: list[tuple] = []
            for doc, row, lo, hi, u in zip(part["doc"], part["row"], part["lo"], part["hi"], part["u"], strict=True):
                if u is None:  # met before by the task that read it
                    out.append((doc, row, lo, hi + LENGTH))
                    continue
                if (doc, row, lo) == last:  # the same text under the same id
                    continue
                last = (doc, row, lo)
                if len(u) > _DIGEST:
                    held.append((doc, row, lo, u))
                elif u in digests:
                    out.append((doc, row, lo, lo + LENGTH))
                else:
                    digests.add(u)
            if held:
                for k, a, b in family.add([u for *_, u in held]):
                    doc, row, lo, _ = held[k]
                    out.append((doc, row, lo + a, lo + b - 1 + LENGTH))
            if out:
                yield _batch(out, _SPAN)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, row, a, b``: byte spans to remove of each distinct id and text of ``docs`` (``row``: the text's hash); spans may overlap."""
    spark, slim = docs.sparkSession, _keyed(docs, id_col, text_col)
    repeated = stored(slim.select("text").mapInArrow(_counted, "kh long, n long").groupBy("kh").agg(F.sum("n").alias("n")).filter("n > 1"))
    distinct, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most MOST_HOT anchors can have more than total / MOST_HOT occurrences
    busy = repeated.filter(F.col("n") > max(BUCKET, total // MOST_HOT)).toArrow()
    hot, hot_total = np.sort(busy["kh"].to_numpy()), int(busy["n"].to_numpy().sum())
    bits = max(1 << 16, 1 << (distinct * BITS_EACH).bit_length())
    sent = None
    if bits <= BITMAP_BITS:
        place = F.col("kh").bitwiseAND(bits - 1)
        words = repeated.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((kh & {bits - 1}L) & 63 AS INT))")).alias("b"))
        found = words.toArrow()
        bitmap = np.zeros(bits // 64, np.uint64)
        bitmap[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast(bitmap)
    sent_hot = spark.sparkContext.broadcast(hot)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier: dict[bytes, tuple] = {}  # texts met in this task: the first place
        for batch in batches:
            out: list[tuple] = []
            own = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for part in _portions([_bytes(t.as_py()) for t in batch.column(2)]):
                kh, text, first, last = anchors(part)
                if sent is not None and len(kh):
                    at = kh & (bits - 1)
                    keep = (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                    kh, text, first, last = kh[keep], text[keep], first[keep], last[keep]
                busy = np.isin(kh, sent_hot.value).tolist() if len(sent_hot.value) else [False] * len(kh)
                ids = [next(own) for _ in part]
                gone: tuple = ()  # the last row, if it is a dropped one: text, from, to
                for k, i, lo, hi, split in zip(kh.tolist(), text.tolist(), first.tolist(), last.tolist(), busy, strict=True):
                    doc, row = ids[i]
                    for a, b in ((s, s) for s in range(lo, hi + 1)) if split else ((lo, hi),):
                        u = part[i][a : b + LENGTH]
                        key, me = xxhash.xxh128_digest(u), (doc is None, doc or 0, row, a)
                        before = earlier.get(key)
                        if before is None or me < before:
                            if len(earlier) >= REMEMBERED:
                                earlier.clear()
                            earlier[key] = me
                            out.append((int.from_bytes(key[:8], "little", signed=True), doc, row, a, b, key) if split else (k, doc, row, a, b, u))
                            gone = ()
                        elif before != me:  # all its strings start earlier
                            if gone and gone[0] == i and gone[2] == a - 1:
                                gone = (i, gone[1], b)
                                out[-1] = (row, doc, row, gone[1], b, None)
                            else:
                                gone = (i, a, b)
                                out.append((row, doc, row, a, b, None))
                if len(out) > 20_000:
                    yield _batch(out, _MET)
                    out = []
            if out:
                yield _batch(out, _MET)

    met = slim.mapInArrow(meet, "kh long, doc long, row long, lo long, hi long, u binary")
    if sent is None:
        # rows without text, and those of hot anchors, are known to repeat; their key isn't an anchor's
        met = met.withColumn("sure", F.coalesce(F.octet_length("u") <= _DIGEST, F.lit(True)))
        known = repeated.select(F.col("kh").alias("k2"), F.lit(True).alias("k"))
        met = met.join(known, (F.col("kh") == F.col("k2")) & ~F.col("sure"), "left").filter("sure OR k").drop("sure", "k", "k2")
    buckets = -(-(int(total) + 8 * hot_total) // BUCKET)
    ordered = met.repartition(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "kh").sortWithinPartitions(F.col("doc").asc_nulls_last(), "row", "lo")
    return ordered.mapInArrow(_scanned, "doc long, row long, a long, b long")


_CUT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])


def cut_text(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What ``spans`` (may overlap) leave of ``data``, and their union as runs."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    left, at = [], 0
    for a, b in runs:
        left.append(data[at:a])
        at = b
    return b"".join([*left, data[at:]]), [(a, b) for a, b in runs]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by document, spans (without a text) first, then its texts: the first loses the spans, a repeated row all it can."""
    key, spans, again = None, [], False
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part, rows = batch.slice(start, 2000).to_pydict(), []
            for doc, row, a, b, text in zip(part["doc"], part["row"], part["a"], part["b"], part["text"], strict=True):
                if (doc, row) != key:
                    key, spans, again = (doc, row), [], False
                if text is None:
                    spans.append((a, b))
                    continue
                data = _bytes(text)
                kept, runs = cut_text(data, [(0, len(data))] if again and len(data) >= LENGTH else spans)
                again, spans = True, []
                rows.append({"doc_id": doc, "kept": kept, "spans": [{"from": x, "to": y} for x, y in runs]})
            yield pa.RecordBatch.from_pylist(rows, schema=_CUT)


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept`` (bytes), ``spans`` (removed runs, merged) for every row of ``docs``; ``spans`` by :func:`repeated_spans`."""
    none = F.lit(None).cast("long")
    texts = _keyed(docs, id_col, text_col).select("doc", "row", none.alias("a"), none.alias("b"), "text")
    both = spans.select("doc", "row", "a", "b", F.lit(None).cast("string").alias("text")).unionByName(texts)
    return both.repartition("doc", "row").sortWithinPartitions("doc", "row", F.col("text").isNotNull()).mapInArrow(_cut, "doc_id long, kept binary, spans array<struct<from:long,to:long>>")


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, and the digest of what it keeps."""
    docs = table(spark, sf_dir, "documents")
    cut = cut_spans(docs, repeated_spans(docs))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return cut.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT r, h, unnest(range(0, greatest(0, len(h) // 2 - {LENGTH - 1}))) AS i FROM d)),
x AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS n FROM w) WHERE n > 1),
s AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS b FROM x),
g AS (SELECT r, i, sum(b) OVER (PARTITION BY r ORDER BY i) AS g FROM s),
t AS (SELECT r, g, min(i) AS a, max(i) + {LENGTH} AS e FROM g GROUP BY r, g),
p AS (SELECT r, g, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY g), 0) AS f FROM t),
q AS (SELECT r, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY g) AS pre, max(e) AS tail, sum(e - a) AS n_removed, count(*) AS n_spans FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(pre, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN q USING (r)
"""
