import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from quadrille.llm import simhash as s
from quadrille.llm.components import connected_components


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_codeword_sets_meet_within_two_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 4000)
    for flips in (1, 2):
        y = x.copy()
        for row in range(len(y)):
            for b in rng.choice(23, flips, replace=False):
                y[row] ^= 1 << int(b)
        a, b = s.codewords(x), s.codewords(y)
        assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist(), strict=True))
    assert len(np.unique(s.syndrome(s.codewords(x)[:, 0] << 11))) > 1


def naive(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [1, 32])
def test_links_equal_brute_force(spark, hot):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    edges = s.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)
    got = {(r.node, r.root) for r in connected_components(edges).collect()}
    by = {}
    for node, root in got:
        by.setdefault(root, set()).add(node)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    roots = union(len(fps), pairs)
    want = {}
    for i, r in enumerate(roots):
        want.setdefault(r, set()).add(signed[i])
    assert sorted(map(sorted, by.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_documents_and_odd_rows(spark, tmp_path):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).to_pylist()
    rows += [{"doc_id": 9001, "text": None}, {"doc_id": 9002, "text": " \n"}, {"doc_id": None, "text": ""}, {"doc_id": 9003, "text": "One"}, {"doc_id": 9003, "text": "One"}]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], "a") for r in rows], "doc_id long, text string, fp string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = s.op3_golay_simhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    fp = [naive(r["text"]) for r in rows]
    roots = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {}
    for i, r in enumerate(roots):
        ids = [x for x in (least.get(r), rows[i]["doc_id"]) if x is not None]
        least[r] = min(ids) if ids else None
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((x["doc_id"], f"{f:016x}", least[r]) for x, f, r in zip(rows, fp, roots, strict=True)), key=key)
    kept = s.one_of_each(docs).collect()
    assert len(kept) == len(set(roots)) and kept[0].__fields__ == ["doc_id", "text", "fp"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.one_of_each(docs).collect() == []
