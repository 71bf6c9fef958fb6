import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
from quadrille.llm import suffix_dedup as s


def brute(docs):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    seen, out = set(), [None] * len(docs)
    for i in order:
        data = (docs[i][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - s.LENGTH + 1):
            x = data[k : k + s.LENGTH]
            if x in seen:
                gone[k : k + s.LENGTH] = True
            seen.add(x)
        runs = s.runs_of(gone)
        out[i] = (docs[i][0] if docs[i][0] is not None else -1, len(data), int(gone.sum()), len(runs), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return sorted(out)


def weak(data, length):
    """A fingerprint that many strings share."""
    return s.fingerprints(data, length) % np.uint64(7)


def test_family():
    rng = random.Random(1)
    for fingerprint in (s.fingerprints, weak):
        family, seen = s.IndexFamily(6, fingerprint), set()
        for _ in range(40):
            batch = [bytes(rng.choice(b"abc") for _ in range(rng.randint(6, 30))) for _ in range(rng.randint(1, 9))]
            got = {(k, i) for k, a, b in family.add(batch) for i in range(a, b)}
            for k, text in enumerate(batch):
                for i in range(len(text) - 5):
                    assert ((k, i) in got) == (text[i : i + 6] in seen)
                    seen.add(text[i : i + 6])
        sizes = [len(k) for k, _ in family.levels]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
        assert sum(sizes) == len(seen) if fingerprint is s.fingerprints else family.odd


def test_anchors_are_content():
    rng = random.Random(2)
    a = bytes(rng.choice(b"abcd ") for _ in range(700))
    texts = [a, b"", b"xx" + a[50:600], a[:99], a[300:] + a[:300], a[:100]]
    kh, text, first, last = (x.tolist() for x in s.anchors(texts))
    found, starts = {}, []
    for k, i, lo, hi in zip(kh, text, first, last, strict=True):
        for at in range(lo, hi + 1):
            assert found.setdefault(texts[i][at : at + s.LENGTH], k) == k
            starts.append((i, at))
    assert starts == [(i, at) for i, x in enumerate(texts) for at in range(len(x) - s.LENGTH + 1)]
    assert all(len(x) == 0 for x in s.anchors([b"", a[:99], a[:99]]))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("abcdefé\x00 ") for _ in range(n))
    shared = [part(n) for n in (90, 100, 130, 400, 1500)]
    docs = [(i, "".join(rng.choice([part(rng.randint(1, 150)), rng.choice(shared)]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "z" * 1000), (None, shared[3]), (103, "z" * 99)]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.op4_suffix_levels(spark, str(tmp_path)).collect())
    assert got == brute(docs) and sum(r[2] for r in got) > 5000


def boilerplate(rng, n):
    """Documents around one passage, with copies of whole rows and of ids."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(30))
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 30))) + passage + " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return docs + [docs[3], docs[3], (3, None), (n + 1, docs[5][1]), (n + 2, passage * 3)]


def test_without_bitmap_and_hot_anchors(spark, monkeypatch):
    docs = boilerplate(random.Random(5), 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    for bits, bucket, most, remembered in ((1 << 28, 24_000, 10**6, 400_000), (0, 24_000, 10**6, 400_000), (1 << 28, 8, 10**6, 50), (0, 8, 10**6, 3)):
        for name, value in (("BITMAP_BITS", bits), ("BUCKET", bucket), ("MOST_HOT", most), ("REMEMBERED", remembered)):
            monkeypatch.setattr(s, name, value)
        rows = s.cut_spans(df, s.repeated_spans(df)).collect()
        got = sorted((r.doc_id, len(r.kept) + sum(x["to"] - x["from"] for x in r.spans), sum(x["to"] - x["from"] for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows)
        assert got == want, (bits, bucket)


def test_doubled_sentence_beyond_the_bitmap(spark, monkeypatch):
    monkeypatch.setattr(s, "BITMAP_BITS", 0)
    sentence = "".join(random.Random(6).choice("abcdefghij ") for _ in range(128))
    docs = [(i, sentence * 2 + str(i)) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: sum(x["to"] - x["from"] for x in r.spans) for r in s.cut_spans(df, s.repeated_spans(df)).collect()}
    assert got == {i: n for i, _, n, *_ in brute(docs)}


def test_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    assert sorted(tuple(r) for r in s.op4_suffix_levels(spark, "/root/testdata/sf0.001").collect()) == brute(docs)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert s.op4_suffix_levels(spark, str(tmp_path)).collect() == []
