import numpy as np
from quadrille.llm import near_copies as s
from quadrille.llm import simhash


def texts():
    words = [f"w{i}" for i in range(3000)]
    return [" ".join(words), " ".join([*words[:-1], "else"]), " ".join(f"v{i}" for i in range(3000)), "", None]


def test_keys_of_the_fingerprint(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    for r in s.sketches(docs).collect():
        x = s.shingles(texts()[r.doc_id])
        ones = [sum(int(h) >> bit & 1 for h in x) for bit in range(64)]
        fp = sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(x))
        keys, _ = simhash.golay_keys(np.array([fp], np.uint64).view(np.int64))
        assert r["keys"] == ([*s.band_keys(s.least_values(x)).tolist(), *keys.tolist()] if len(x) else [])


def test_golay_keys_alone_link(spark, monkeypatch):
    # a band that no two texts share
    monkeypatch.setattr(s, "band_keys", lambda least: np.array([least.sum() >> np.uint64(1)]).astype(np.int64))
    a, b = (s.fingerprint(s.shingles(t)) for t in texts()[:2])
    assert (a ^ b).bit_count() <= simhash.MAX_BITS
    docs = spark.createDataFrame(list(enumerate(texts()[:3])), "doc_id long, text string")
    assert sorted(r.doc_id for r in s.one_of_each(docs).collect()) == [0, 2]
