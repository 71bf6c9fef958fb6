import math
from collections import Counter

import numpy as np
import pytest
from quadrille.llm import lm_scoring as s
from quadrille.llm.decontaminate import words_of

DOCS = [(1, "a b a b c", 0), (2, "A b. b d", 0), (3, None, 1), (4, "", 1), (5, "x y z a b", 0), (5, "x y z a b", 0), (None, "a b", 0), (6, "b a " * 3000, 2)]
LABELS = [(1, 1), (1, 1), (2, 0), (5, 1), (None, 1)]


def brute(docs, good, least):
    seqs = [(i, [*words_of(t), "$"], i in good) for i, t, _ in docs]
    models = []
    for only in (False, True):
        uni, bi = Counter(), Counter()
        for _, q, g in seqs:
            if len(q) > 1 and (g or not only):
                uni.update(q)
                bi.update(zip(["$", *q], q))
        models.append((uni, bi))
    every, pairs = models[0]
    total, out = sum(every.values()), []
    for i, q, _ in seqs:
        if len(q) == 1:
            out.append((i, 0, None, None, None))
            continue
        m = []
        for uni, bi in models:
            p = {w: (uni[w] + s.MASS * every[w] / total) / (sum(uni.values()) + s.MASS) for w in q}
            bits = [-math.log2(((bi[a, b] if pairs[a, b] >= least else 0) + s.MASS * p[b]) / (uni[a] + s.MASS)) for a, b in zip(["$", *q], q)]
            m.append(sum(bits) / len(bits))
        out.append((i, len(q) - 1, *m, m[1] - m[0]))
    return out


@pytest.mark.parametrize("least, block, bucket", [(2, 4_000_000, 500_000), (1, 7, 5), (3, 1, 100)])
def test_brute_force(spark, least, block, bucket):
    docs = s.flagged(spark.createDataFrame(DOCS, "doc_id long, text string, target int"), spark.createDataFrame(LABELS, "doc_id long, quality int"))
    got = [tuple(r) for r in s.score(docs, least, block, bucket).collect()]
    want = brute(DOCS, {1, 5}, least)
    key = lambda r: (r[0] or 0, r[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and [x is None for x in a] == [x is None for x in b]
        assert [x for x in a[2:] if x is not None] == pytest.approx([x for x in b[2:] if x is not None], rel=1e-9)


def test_packing():
    for x in (np.arange(300, dtype=np.int32), np.array([1 << 63, 5], np.uint64), np.zeros(0, np.int64)):
        assert s.unpack(s.pack(x), len(x), x.dtype.type).tolist() == x.tolist()


def test_empty(spark):
    docs = s.flagged(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert s.score(docs).collect() == []
    docs = s.flagged(spark.createDataFrame([(1, "one word")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert s.score(docs).first().score is not None
