import random

import numpy as np
from quadrille.llm import near_copies as s


def variants(rng, words, n, changes):
    out = []
    for i in range(n):
        w = list(words)
        for at in rng.sample(range(0, len(w) - 5, 5), changes(i)):
            w[at] = f"new{rng.random()}"
        out.append(" ".join(w))
    return out


def test_group_that_does_not_link_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    # one change of 140 words takes five of 136 shingles: four leave a similarity of 0.74 to the first text, and less between two
    texts = variants(rng, [f"w{i}" for i in range(140)], 120, lambda i: 4)
    sets, met, verified = [set(s.shingles(t).tolist()) for t in texts], [], s.verified
    monkeypatch.setattr(s, "verified", lambda docs, nodes, pairs, *more: met.append(pairs.count()) or verified(docs, nodes, pairs, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alike = sum(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert len(s.one_of_each(docs).collect()) == len(texts) and alike == 0
    assert len(met) == s.ROUNDS + 1 and met[-1] < 60, met


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(7)
    texts = variants(rng, [f"w{i}" for i in range(120)], 60, lambda i: i % 5) + variants(rng, [f"w{i}" for i in range(60, 150)], 30, lambda i: i % 3)
    sets = {i: np.asarray(x) for i, x in enumerate(dict.fromkeys(s.shingles(t).tobytes() for t in texts)) for x in [np.frombuffer(x, np.uint64)]}
    want = {(i, j) for i in sets for j in sets if i < j and s.similarity(sets[i], sets[j]) >= s.SIMILAR}
    rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "node long, s binary")
    busy = spark.createDataFrame([(i, len(x), i) for i, x in sets.items()], "node long, size long, root long")
    got = {tuple(r) for r in s.close(s.prefixes(rows, busy)).collect()}
    assert want <= got and len(want) > 50 and len(got) < len(sets) * (len(sets) - 1) / 2
