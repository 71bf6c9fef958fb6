import random
from collections import defaultdict

import corpus_pipeline
import pyarrow.parquet as pq
from quadrille.llm import near_copies as s
from quadrille.llm import simhash


def shingles(text):
    w = (text or "").lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(sets):
    """Pairs of 0.8 or more by brute force."""
    at, pairs = defaultdict(list), set()
    for i, x in enumerate(sets):
        for t in x:
            at[t].append(i)
    for group in at.values():
        pairs |= {(i, j) for j in group for i in group if i < j}
    return {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_stage_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [d["text"] for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    long = [t for t in texts if len(t.split()) > 60]
    for k in range(60):
        w = rng.choice(long[:6]).split()
        for _ in range(max(1, len(w) * (k % 5) // 100)):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        texts.append(" ".join(w))
    texts += ["a b", "A  b", "a b c", "", None, " \n"]
    sets = [shingles(t) for t in texts]
    empty = [i for i, x in enumerate(sets) if not x]
    pairs = near(sets) | {(empty[0], i) for i in empty[1:]}
    want = sorted(set(roots(len(texts), pairs)))
    far = [(i, j) for i, j in pairs if (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > simhash.MAX_BITS]
    assert len(far) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (7, "X y z")], "doc_id long, text string")
    assert [r.doc_id for r in s.one_of_each(docs).collect()] == [7]
    assert s.one_of_each(docs.limit(0)).collect() == []
