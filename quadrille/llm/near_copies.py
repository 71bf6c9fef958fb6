"""Near-copy dedup by five-word shingles: Golay keys of SimHash fingerprints and MinHash bands as candidate keys, exact Jaccard similarity as the rule.

Two texts link if their sets of ``SHINGLE``-word shingles (words A-Z lower-cased) have a Jaccard similarity of
``SIMILAR`` or more; a component keeps one document. A text's 64-bit fingerprint has the keys of :mod:`quadrille.llm.simhash`, an equal segment and
the Golay codewords of the next, of which texts within two bits always share one. Texts at the limit of similarity differ in some ten
bits, so each has ``BANDS`` keys more, of the least values under ``ROWS`` of
``HASHES`` hash functions; two texts at the limit share none of these in 14 of 10,000 cases (simulated; bands share functions).
Candidates must agree in ``LEAST_EQUAL`` of the ``HASHES`` least values, which a pair at the limit misses with a probability
below 1 in 100 million; those that do are verified on the whole sets.

Texts of equal sets are one node, so that copies don't multiply. Below a key all nodes first meet only one, its
centre, which is linear: the node whose keys are the most shared, which is likeliest the text that the others are copies of.
In the next round those that are in other components than a key's new centre, a node outside of
its largest part, meet that one. Nodes of keys that still hold more than one component are compared by an exact prefix filter on their sets, the
rarest shingles first: two sets at the limit share a shingle that leaves each of them enough others, and what no other node has is never shared, so that a text with
many changes of its own links to nothing without a comparison. Pairs inside one component don't change it and are never made.

SimHash keys alone can't do this: texts at the limit differ in 15 of 100 fingerprint bits, decode a 23-bit segment to the same Golay
codeword in 12 of 100 cases, and would need over 500 keys each.

Defined results: texts shorter than a shingle have one of all their words; null and wordless texts are one
class; null ids stay, and count for a component's least id only if it has no other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import pinned, text_or_empty
from quadrille.llm.components import connected_components
from quadrille.llm.simhash import first_of_each, golay_keys

SHINGLE, SIMILAR, HASHES, BANDS, ROWS, LEAST_EQUAL, SEED = 5, 0.8, 240, 64, 9, 150, 42
#: Tables of so many short rows at most are broadcast, and graphs of so many links worked out in one task; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Short rows, and whole sets, that a task of a small table has: each task more costs files and seconds of its own.
TASK_ROWS, TASK_SETS = 20_000, 2_000
#: Rounds in which a key's nodes meet one centre only.
ROUNDS = 2
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TIMES, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The hash functions of each band; bands share some.
_CHOSEN = np.array([np.random.default_rng((SEED, band)).permutation(HASHES)[:ROWS] for band in range(BANDS)])
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n, out = max(min(len(h), 1), len(h) - shingle + 1), np.zeros(1, np.uint64)
    for i in range(min(shingle, len(h))):
        out = out * _BASE + h[i : i + n]
    return np.unique(_mixed(out)) if n else h


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(s), bitorder="little").tobytes(), "little")


def least_values(s: np.ndarray) -> np.ndarray:
    """The least value of a set under each hash function."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 256):
        np.minimum(least, (s[at : at + 256, None] * _TIMES + _PLUS).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key a band (signed) of :func:`least_values`."""
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least[_CHOSEN].T:
        key = _mixed(key * _BASE + row)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, node, size, keys, signature`` of every row; ``node`` is a hash of the set of shingles, and a set without shingles has no keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("signature", pa.binary())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            nodes, sizes, prints, keys, signatures = [], [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py())
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                prints.append(fingerprint(s))
                least = least_values(s)
                keys.append(band_keys(least) if len(s) else ())
                signatures.append(_mixed(least).astype(np.uint16).tobytes())
            key, owner = golay_keys(np.array(prints, np.uint64).view(np.int64))
            order = np.argsort(owner, kind="stable")
            golay = np.split(key[order], np.searchsorted(owner[order], np.arange(1, len(prints))))
            keys = [np.concatenate((k, g)) if len(k) else k for k, g in zip(keys, golay, strict=True)]
            node = pa.array(np.array(nodes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], schema=schema)

    return _slim(docs).mapInArrow(compute, "doc_id long, text_hash long, node long, size long, keys array<long>, signature binary")


def _count(df: DataFrame) -> int:
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()


def _packed(df: DataFrame, most: int | None = None, rows: int = TASK_ROWS) -> DataFrame:
    """``df``, pinned, in no more partitions than its rows need; made in no more than ``most`` rows need, if it has no more."""
    df = pinned(df if most is None else df.coalesce(1 + most // rows))
    return df.coalesce(1 + _count(df) // rows)


def _sided(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _count(df) <= BROADCAST_ROWS else df


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` of the graph that all ``batches`` (``u, v``) make; a root is its component's least node."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
        root, before = np.arange(len(nodes)), None
        while before is None or not np.array_equal(root, before):
            before, a, b = root.copy(), root[ends[: len(u)]], root[ends[len(u) :]]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, further := root[root]):
                root = further
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(nodes[root[at : at + (1 << 16)]])], names=["node", "root"])


def roots_of(edges: DataFrame) -> DataFrame:
    """:func:`connected_components`, of a small graph (pinned ``edges``) in one task."""
    return edges.coalesce(1).mapInArrow(_united, "node long, root long") if _count(edges) <= BROADCAST_ROWS else connected_components(edges)


def _compared(pairs: DataFrame, facts: DataFrame, what: str, alike) -> DataFrame:
    """Those of ``pairs`` (pinned) whose nodes' column ``what`` of ``facts`` agrees by ``alike(a, b)``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [alike(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left, right = facts.select(F.col("node").alias("u"), F.col(what).alias("a")), facts.select(F.col("node").alias("v"), F.col(what).alias("b"))
    few = _sided(pairs)
    return _packed(left.join(few, "u").join(right.join(few.select("v"), "v", "left_semi"), "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, s``: the sets of ``nodes``, each made once more from one text."""
    wanted = pinned(nodes.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py()).tobytes() for t in batch.column(0)]
            node = np.array([xxhash.xxh64_intdigest(s) for s in made], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(made, pa.binary())], names=["node", "s"])

    slim = _slim(docs)
    rows = slim.join(_sided(wanted), slim["doc_id"].eqNullSafe(wanted["_id"]) & (slim["text_hash"] == wanted["_hash"]), "left_semi").select("text")
    return rows.mapInArrow(sets, "node long, s binary").dropDuplicates(["node"])


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of ``pairs`` (``u, v``; pinned) whose whole sets are similar."""
    pairs = _compared(pairs, nodes, "signature", lambda a, b: np.count_nonzero(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)) >= LEAST_EQUAL)
    needed = _packed(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), 2 * _count(pairs))
    known = _packed(_sets(docs, nodes.join(_sided(needed), "node", "left_semi")), rows=TASK_SETS)
    return _compared(pairs, known, "s", lambda a, b: similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= similar)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, s in zip(batch.column(0), batch.column(1), strict=True):
            tokens = np.frombuffer(s.as_buffer(), np.int64)
            for at in range(0, len(tokens), 1 << 16):
                part = tokens[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), node.as_py(), np.int64))], names=["token", "node"])


def prefixes(sets: DataFrame, busy: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``token, node, size, root, left`` of the shingles by which nodes (``node, size, root``) of different roots could be similar.

    The shingles of a set stand in the order of how many nodes have them; ``left`` is how many of them stand from this one on. Two sets' first
    common shingle has all common ones from it on, in both; so it is one with ``left`` of ``similar`` times the set's size at least.
    """
    tokens = pinned(sets.mapInArrow(_shingle_rows, "token long, node long"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = tokens.join(shared, "token").withColumn("left", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("token"))))
    kept = pinned(ranked.join(busy, "node").filter(F.col("left") >= similar * F.col("size") - 1e-6).select("token", "node", "size", "root", "left"))
    mixed = kept.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("token")
    return pinned(kept.join(mixed, "token"))


def close(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``u, v`` of nodes of different roots that share one of ``rows`` (:func:`prefixes`) and have enough left there: all pairs that are similar, and others."""
    a, b = rows.alias("a"), rows.alias("b")
    enough = (1 + similar) * F.least("a.left", "b.left") >= similar * (F.col("a.size") + F.col("b.size")) - 1e-6
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") < F.col("b.root")) & enough)
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def components(docs: DataFrame, prints: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``node, root, component_id`` for the distinct nodes of ``prints`` (:func:`sketches`; pinned)."""
    # pinned rows keep their numbers
    prints = prints.withColumn("at", F.monotonically_increasing_id())
    nodes = _packed(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("at").alias("at")))
    texts = prints.join(_sided(nodes.select("at")), "at", "left_semi")
    texts = texts if _count(nodes) <= BROADCAST_ROWS else pinned(texts)
    members = texts.select("node", "size", F.explode("keys").alias("key"))
    shared = _packed(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    multi = _packed(members.join(_sided(shared), "key").withColumn("score", F.sum("n").over(Window.partitionBy("node"))))
    most = _count(multi)
    alike = lambda a, b: F.least(a, b) >= SIMILAR * F.greatest(a, b)
    ends = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    edges = tried = roots = None
    split = multi.withColumn("root", F.col("node"))
    for number in range(rounds + 1):
        if number:
            placed = _packed(multi.join(_sided(roots), "node", "left").select("key", "node", "size", "score", "n", F.coalesce("root", "node").alias("root")), most)
            parts = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("parts"))
            parts = _packed(parts.filter("parts > 1").select("key", F.col("main.root").alias("main")), most)
            split = _packed(placed.join(_sided(parts), "key"), most)
        if number < rounds:
            centre = split.filter("root != main").groupBy("key") if number else split.groupBy("key")
            centre = _packed(centre.agg(F.max(F.struct("score", "node", "size", "root")).alias("centre")), most)
            met = split.join(_sided(centre), "key").filter((F.col("root") != F.col("centre.root")) & alike(F.col("size"), F.col("centre.size")))
            pairs = met.select(*ends(F.col("node"), F.col("centre.node"))).distinct()
            pairs = _packed(pairs if tried is None else pairs.join(_sided(tried), ["u", "v"], "left_anti"), most)
        else:
            # the two nodes of a key that has no third have met
            busy = _packed(split.filter("n > 2").select("node", "size", "root").distinct(), most)
            pairs = close(prefixes(_sets(docs, texts.join(_sided(busy), "node", "left_semi")), busy))
            pairs = _packed(pairs if tried is None else pairs.join(_sided(tried), ["u", "v"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = verified(docs, texts, pairs)
        edges = found if edges is None else edges.unionByName(found)
        # a round that links nothing leaves the components as they are
        if roots is None or found.limit(1).count():
            roots = _packed(roots_of(edges))

    grouped = nodes.join(_sided(roots), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return grouped.join(least, "root").select("node", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the least ``doc_id``. Columns as they are."""
    prints = pinned(sketches(docs))
    placed = _packed(components(docs, prints))
    return first_of_each(docs, prints.select("doc_id", "text_hash", "node").join(_sided(placed), "node"), _sided)
