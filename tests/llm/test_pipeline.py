import re

import corpus_pipeline
import pyarrow.parquet as pq
from quadrille.llm import decontaminate, quality
from quadrille.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, SF).cache()
        seen.append((name, before, docs.count()))
        assert set(table(spark, SF, "documents").columns) <= set(docs.columns)
    assert all(n > 50 for _, _, n in seen), seen
    rows = docs.collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    bench = [decontaminate.words_of(x["text"]) for x in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    windows = {b" ".join(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9)) if w}
    for r in rows:
        w = decontaminate.words_of(r.text)
        assert not windows & {b" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
        assert r.n_chars == len(r.text) and len(w) > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_odd_rows_do_not_crash(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, row_key string, size string"
    words = "w" + " word".join(map(str, range(30)))
    rows = [(None, None, None, None, None, "a", "b", "c"), (1, "", "en", "s", 0, "a", "b", "c"), (2, words, None, None, 5, "a", "b", "c"), (2, words, None, None, 5, "a", "b", "c"), (None, words + " more", "en", "s", 9, "a", "b", "c")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= (1 if data else 0)


def test_cut():
    assert decontaminate.cut("One, two THREE four.", [(1, 3)]) == "One,   four."
    assert decontaminate.cut("One", [(0, 1)]) == " "


def naive_repeats(words):
    seen, cover = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {j for i in at for j in range(i, i + 5)}
    return len(cover)


def test_repeated_words():
    for d in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        words = re.findall(rb"[^\x20\x09-\x0D]+", d["text"].encode())
        assert quality.repeated_words(words) == naive_repeats(words)
    assert quality.repeated_words([b"a"] * 7) == 7
