from quadrille.llm import decontaminate as d


def test_blocks_are_judged_on_the_input(spark):
    first, second = "a b c d e f g h i j", "f g h i j k l m n o"
    # cut apart, "p q" and "r s t u v w x y" would meet as the third passage
    third = "p q r s t u v w x y"
    bench = spark.createDataFrame([(1, first), (2, second), (3, third)], "item_id long, text string")
    texts = ["one a b c d e f g h i j k l m n o two", f"p q {first} r s t u v w x y", first, "none", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {0: ["one", "two"], 1: "p q r s t u v w x y".split(), 3: ["none"], 4: []}
    for block in (1, 10, 1000):
        got = {r.doc_id: (r.text or "").split() for r in d.remove_passages(docs, bench, block_words=block).collect()}
        assert got == want
    assert d.remove_passages(docs, bench.limit(0)).count() == 5
