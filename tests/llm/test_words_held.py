import weakref

from quadrille.llm import decontaminate as d


class Words(list):
    pass


def test_search_holds_the_words_of_one_text_at_a_time():
    phrases, refs, most = d.Phrases([("1", "a b c")], 3), [], []

    def texts():
        for _ in range(50):
            words = Words([b"x", b"a", b"b", b"c"])
            refs.append(weakref.ref(words))
            most.append(sum(r() is not None for r in refs))
            yield words
            del words

    found = d.search_shard(texts(), phrases, 3, 20)
    assert [(a.tolist(), b.tolist()) for a, b, _ in found] == [([1], [4])] * 50
    assert max(most) <= 2
