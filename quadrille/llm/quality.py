"""Quality rules: per-document counts and cross-document line frequency by host.

A line is normalised (words joined by one space, A-Z lower-cased, digits to 0) and hashed with its
host. A host's line that stands in more than ``max(MIN_DOCS, SHARE x the host's documents)``
distinct documents is boilerplate; equal texts count as one document, so copies don't make
boilerplate. A document is depleted, and rejected, if without its boilerplate fewer than
``MIN_WORDS`` words or less than ``MIN_LEFT`` of its words are left. The other documents lose their
boilerplate lines (``keep_good``; ``without_boilerplate`` rejects none); the query gives counts and verdicts only.

Defined results: null and wordless texts fail the base rules (no words); a null source is a host
of its own; repeated rows each get their verdict; lines without words are ignored; other columns
are not read. Lines are pre-aggregated by host and hash before they meet.
"""

from __future__ import annotations

from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import pinned, table

SHARE, MIN_DOCS, MIN_WORDS, MIN_LEFT = 0.05, 10, 10, 0.3
WINDOW = 5
#: A boilerplate table of more rows than this is joined by shuffle, not broadcast.
BROADCAST_ROWS = 200_000

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
#: Bytes that begin a code point of a word.
_WORD_CHAR = np.ones(256, np.int64)
_WORD_CHAR[np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8)] = 0
_WORD_CHAR[0x80:0xC0] = 0
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more in ``words``."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    key, distinct = ids[:n], len(seen)
    for k in range(1, size):
        if distinct * len(seen) >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            distinct = len(values)
        key, distinct = key * len(seen) + ids[k : k + n], distinct * len(seen)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def host_of(source: str | None) -> int:
    return xxhash.xxh64_intdigest(b"" if source is None else b"=" + source.encode("utf-8", "surrogatepass"))


def without_lines(text: str, source: str | None, lost: Container[int]) -> str:
    """``text`` without the lines whose hashes (those of ``measures``) are in ``lost``; all others stay as they are."""
    host, out = host_of(source), []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        parts = line.translate(_NORMAL).split()
        if not parts or np.uint64(xxhash.xxh64_intdigest(b" ".join(parts), host)).astype(np.int64).item() not in lost:
            out.append(line)
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def measures(text: str | None, source: str | None) -> dict:
    """Base counts of a text, and its distinct normalised lines: hash with the host, and words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    host = host_of(source)
    normal: dict[int, int] = {}
    for line in lines:
        parts = line.translate(_NORMAL).split()
        h = xxhash.xxh64_intdigest(b" ".join(parts), host)
        normal[h] = normal.get(h, 0) + len(parts)
    repeats = repeated_words(words)
    return {
        "n_words": len(words),
        "word_chars": int(histogram @ _WORD_CHAR),
        "n_symbols": int(histogram @ _SYMBOL),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeats,
        "base_failed": len(words) < 10 or 100 * repeats > 20 * len(words),
        "host": np.uint64(host).astype(np.int64).item(),
        "text_hash": np.uint64(xxhash.xxh64_intdigest(data, host)).astype(np.int64).item(),
        "lines": [np.uint64(h).astype(np.int64).item() for h in normal],
        "line_words": list(normal.values()),
    }


_SCHEMA = "row_key long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, host long, text_hash long, lines array<long>, line_words array<int>"
_ARROW = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("host", pa.int64()), ("text_hash", pa.int64()), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000).to_pydict()
            rows = [{"row_key": k, "doc_id": i, **measures(t, s)} for k, i, s, t in zip(part["row_key"], part["doc_id"], part["source"], part["text"], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def row_key() -> Column:
    """What tells a document row from others; rows that agree in it get the same verdict."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), F.coalesce("text", F.lit("")))


def measure_documents(docs: DataFrame) -> DataFrame:
    """One row a document with its base counts and line hashes (``doc_id``, ``source``, ``text`` are read)."""
    return docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(_measured, _SCHEMA)


def boilerplate(measured: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """``line`` hashes (host included) above the limit."""
    distinct = measured.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    # The host goes along only as a value, so that a hot host's lines spread by their own hashes.
    lines = distinct.select("host", F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("docs"), F.first("host").alias("host")).filter(F.col("docs") > min_docs)
    hosts = distinct.groupBy("host").agg(F.count("*").alias("host_docs"))
    return lines.join(hosts, "host").filter(F.col("docs") > share * F.col("host_docs")).select("line")


def verdicts(measured: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """``measured``, which must be pinned as it is read several times, with ``left_words`` and ``kept``."""
    found = pinned(boilerplate(measured, share, min_docs))
    rows = measured.withColumn("_row", F.monotonically_increasing_id())
    lines = rows.select("_row", F.explode(F.arrays_zip("lines", "line_words")).alias("p")).select("_row", F.col("p.lines").alias("line"), F.col("p.line_words").alias("w"))
    lost = lines.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "line").groupBy("_row").agg(F.sum("w").alias("_lost"))
    left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    kept = ~F.col("base_failed") & (left >= min_words) & (left >= min_left * F.col("n_words"))
    return rows.drop("lines", "line_words").join(lost, "_row", "left").withColumn("left_words", left.cast("long")).withColumn("kept", kept).drop("_row", "_lost")


def _cleaned(docs: DataFrame, reject: bool, share: float, min_docs: int, min_words: int, min_left: float) -> DataFrame:
    """While the boilerplate's hashes are few enough to be sent to the tasks, texts don't move: a second
    pass measures them again. Beyond ``BROADCAST_ROWS`` verdicts and each row's lines to remove are joined by shuffle.
    """
    measured = pinned(measure_documents(docs))
    found = pinned(boilerplate(measured, share, min_docs))
    names = docs.columns
    at, host = names.index("text"), names.index("source")

    def stripped(batch: pa.RecordBatch, lost: list) -> pa.RecordBatch:
        texts = [without_lines(t, s, x) if x and t else t for t, s, x in zip(batch.column(at).to_pylist(), batch.column(host).to_pylist(), lost, strict=True)]
        columns = batch.columns[: len(names)]
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    if found.count() > BROADCAST_ROWS:
        kept = verdicts(measured, share, min_docs, min_words, min_left).select("row_key", "kept").distinct()
        lines = measured.select("row_key", F.explode("lines").alias("line")).join(found, "line").groupBy("row_key").agg(F.collect_set("line").alias("_q_lost"))
        judged = kept.join(lines, "row_key", "left").filter("kept" if reject else "true").select(F.col("row_key").alias("_q_key"), "_q_lost")
        rows = docs.withColumn("_q_row", row_key()).join(judged, F.col("_q_row") == F.col("_q_key")).select(*names, "_q_lost")

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield stripped(batch, [frozenset(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()])

        return rows.mapInArrow(strip, docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(r.line for r in found.collect()))

    def judge(text: str | None, source: str | None) -> tuple[bool, list[int]]:
        m = measures(text, source)
        lost = {h: w for h, w in zip(m["lines"], m["line_words"], strict=True) if h in sent.value}
        left = m["n_words"] - sum(lost.values())
        return not reject or not m["base_failed"] and left >= min_words and left >= min_left * m["n_words"], list(lost)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [judge(t.as_py(), s.as_py()) for t, s in zip(part.column(at), part.column(host), strict=True)]
                yield stripped(part.filter(pa.array([ok for ok, _ in found], pa.bool_())), [x for ok, x in found if ok])

    return docs.mapInArrow(keep, docs.schema)


def keep_good(docs: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """``docs`` without the rejected rows, the texts of the others without their host's boilerplate lines; other columns stay as they are."""
    return _cleaned(docs, True, share, min_docs, min_words, min_left)


def without_boilerplate(docs: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows of ``docs``, the texts without their host's boilerplate lines; other columns stay as they are."""
    return _cleaned(docs, False, share, min_docs, MIN_WORDS, MIN_LEFT)


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = verdicts(pinned(measure_documents(table(spark, sf_dir, "documents"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_words", "kept")


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
l AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT r, source, text, line, {_WORDS.format("line")} AS parts FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
z AS (SELECT r, source, text, len(parts) AS w, regexp_replace(translate(array_to_string(parts, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS line FROM n),
h AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source),
b AS (SELECT z.source, z.line FROM z JOIN h ON z.source IS NOT DISTINCT FROM h.source GROUP BY z.source, z.line, h.host_docs
      HAVING count(DISTINCT z.text) > {MIN_DOCS} AND count(DISTINCT z.text) > {SHARE}::DOUBLE * h.host_docs),
x AS (SELECT z.r, sum(z.w) AS lost FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source AND z.line = b.line GROUP BY z.r),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY r),
g AS (SELECT r, unnest(range(1, len(words) - {WINDOW} + 2)) AS i, words FROM d WHERE len(words) > {WINDOW}),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i:i + {WINDOW - 1}]) AS c FROM g),
k AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM q WHERE c > 1) GROUP BY r),
m AS (SELECT d.doc_id, len(d.words) AS n_words, len(array_to_string(d.words, '')) AS word_chars, len(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(u.n_dup_lines, 0) AS n_dup_lines, coalesce(k.n_repeat_words, 0) AS n_repeat_words, len(d.words) - coalesce(x.lost, 0) AS left_words
      FROM d LEFT JOIN u USING (r) LEFT JOIN k USING (r) LEFT JOIN x USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, left_words::BIGINT AS left_words,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND left_words >= {MIN_WORDS} AND left_words >= {MIN_LEFT}::DOUBLE * n_words AS kept
FROM m
"""
