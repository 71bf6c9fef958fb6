import corpus_pipeline
import pytest
from quadrille.llm import quality

LINE = "Boiler  plate line 7 of the host"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_lines_above_the_limit_go(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", limit)
    own = lambda i: f"some words of document {chr(96 + i)} that\n\n are not  the same {chr(96 + i)} in any other one of them"
    rows = [(i, f"{LINE}\n{own(i)}\nboiler plate LINE 9 of the host", "h", 0) for i in range(1, 21)]
    rows += [(50, LINE + "\nonly this", "h", 0), (51, f"{LINE}\n{own(26)}", "other", 0), (52, f"{LINE}\n{own(25)}", None, 0), (53, None, "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    want = {i: own(i) for i in range(1, 21)} | {51: rows[21][1], 52: rows[22][1]}
    assert {r.doc_id: r.text for r in quality.keep_good(docs).collect()} == want
    assert {r.doc_id: r.text for r in quality.without_boilerplate(docs).collect()} == want | {50: "only this", 53: None}
    staged = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert {r.doc_id: r.n_chars for r in staged} == {i: len(t) for i, t in want.items()}
