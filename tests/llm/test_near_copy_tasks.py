import random

import pytest
from quadrille.llm import near_copies as s
from test_near_copy_groups import variants


def near_group(n):
    """Texts of which all link to the first, and many to each other."""
    words = [f"w{i}" for i in range(200)]
    return [" ".join(words), *variants(random.Random(8), words, n - 1, lambda i: 1 + i % 4)]


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_group_is_linear_and_small_tables_take_few_tasks(spark, monkeypatch, many_partitions):
    met, parts, verified = [], [], s.verified

    def seen(docs, nodes, pairs, *more):
        met[-1] += pairs.count()
        parts.append(pairs.rdd.getNumPartitions())
        return verified(docs, nodes, pairs, *more)

    monkeypatch.setattr(s, "verified", seen)
    for n in (40, 80):
        docs = spark.createDataFrame(list(enumerate(near_group(n))), "doc_id long, text string")
        met.append(0)
        assert [r.doc_id for r in s.one_of_each(docs).collect()] == [0]
    assert 0 < met[1] <= 3 * met[0], met
    assert set(parts) == {1}, parts


@pytest.mark.parametrize("most", [s.BROADCAST_ROWS, 0])
def test_roots_of_a_graph(spark, monkeypatch, most):
    monkeypatch.setattr(s, "BROADCAST_ROWS", most)
    rng = random.Random(9)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)]
    chain = list(zip(ids[200:], ids[201:], strict=False))
    pairs = [(rng.choice(ids[:200]), rng.choice(ids[:200])) for _ in range(90)] + chain
    pairs = [(u, v) for u, v in pairs if u != v]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    edges = s.pinned(spark.createDataFrame(pairs, "u long, v long").repartition(5))
    got = [tuple(r) for r in s.roots_of(edges).collect()]
    assert len(got) == len(root) and dict(got) == root
    assert s.roots_of(edges.limit(0)).collect() == []


def test_tables_too_large_for_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(s, "TASK_ROWS", 50)
    texts = [*near_group(30), "a b", "A  b", "", None, " ", " ".join(f"v{i}" for i in range(90))]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    assert sorted(r.doc_id for r in s.one_of_each(docs).collect()) == [0, 30, 32, 35]
