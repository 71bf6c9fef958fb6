import random

import numpy as np
from quadrille.llm import decontaminate as d


def test_suffix_order_and_locate():
    rng = random.Random(3)
    for n, k in ((1, 1), (50, 1), (300, 2), (500, 7)):
        s = np.array([rng.randint(0, k) for _ in range(n - 1)] + [0])
        order = d.suffix_order(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def brute(words, phrases):
    out = []
    for k in range(len(phrases)):
        p = [w for w in phrases.symbols[k] if w]
        ids = [phrases.vocabulary.get(w, 1) for w in words]
        out += [(i, i + len(p), k) for i in range(len(ids) - len(p) + 1) if ids[i : i + len(p)] == p]
    return sorted(out)


def test_search_equals_brute_force():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "é", "9"])
    items = [(str(i), " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 4, 12, 20])] + [("n", None)]
    phrases = d.Phrases(items, window=4)
    texts = [d.words_of(" ".join(rng.choice(["zz", word(), word(), word()]) for _ in range(n))) for n in (0, 1, 5, 80, 400, 3)]
    for shard in (7, 50, 10_000):
        got = d.search_shard(texts, phrases, 4, shard)
        for words, (a, b, w) in zip(texts, got, strict=True):
            assert sorted(set(zip(a.tolist(), b.tolist(), w.tolist(), strict=True))) == brute(words, phrases)


def test_blocks_and_nulls(spark):
    docs = spark.createDataFrame([(1, "A b c! d e", "x"), (1, "A b c! d e", "x"), (None, None, None), (4, "", "y")], "doc_id long, text string, row string")
    bench = spark.createDataFrame([(7, "a B"), (8, "c d"), (9, None), (10, "q"), (None, "zz")], "item_id long, text string")
    for block in (1, 1000):
        rows = sorted((r.doc_id or 0, r.n_words, [(s["from"], s["to"]) for s in r.spans], r["items"]) for r in d.contaminated_spans(docs, bench, block_words=block).collect())
        assert rows == [(0, 0, [], []), (1, 5, [(0, 4)], ["7", "8"]), (1, 5, [(0, 4)], ["7", "8"]), (4, 0, [], [])]
    empty = d.contaminated_spans(docs.limit(0), bench).collect()
    assert empty == []
    assert all(r.spans == [] for r in d.contaminated_spans(docs, bench.limit(0)).collect())
