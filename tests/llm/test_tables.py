"""Sharding, mixing and quality rules on small tables with nulls, ties, repeats and clashing names."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from quadrille.llm import mixing, quality, sharding

ODD = [(None, None, None), (1, "", "a"), (2, "one two", "b"), (2, "one two", "b"), (3, "One  two\nthree\n\nOne  two", "a"), (4, "é " * 40, None), (5, "w " * 5000, "c"), (6, "line here\n" * 3 + "x y z", "a"), (7, " \t\n", "b")]
TEXT = "boiler plate line of the host\n"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    out = {}
    more = [(100 + i, TEXT + f"some words of document {chr(97 + i % 26)}{chr(97 + i // 26)} that are not the same in any other one of them", "h") for i in range(30)]
    more += [(200 + i, TEXT + f"only {i}", "h") for i in range(3)] + [(300 + i, "a copied text of ten words or more, with the same lines", "h") for i in range(20)]
    for name, rows in (("odd", [*ODD, *more]), ("empty", [])):
        folder = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, shard string").write.parquet(f"{folder}/documents.parquet")
        out[name] = (folder, rows)
    return out


def duck(folder, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return con.execute(sql).df()


def same(df, want):
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    key = lambda r: tuple(str(None if pd.isna(v) else round(float(v), 6) if not isinstance(v, (str, bool)) else v) for v in r)
    assert Counter(key(tuple(r[n] for n in names)) for r in df.collect()) == Counter(key(r) for r in want[names].itertuples(index=False))


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_against_sql(spark, odd, which):
    folder, rows = odd[which]
    same(mixing.op10_low_discrepancy_mix(spark, folder), duck(folder, mixing.OP10_SQL))
    same(quality.op7_line_frequency(spark, folder), duck(folder, quality.OP7_SQL))


def test_quality_verdicts(spark, odd):
    rows = {r.doc_id: r for r in quality.op7_line_frequency(spark, odd["odd"][0]).collect()}
    assert all(rows[100 + i].kept for i in range(30)) and not any(rows[200 + i].kept for i in range(3)) and all(rows[300 + i].kept for i in range(20))


def test_mix_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45) == pytest.approx([20, 25 / 3, 50 / 3])
    assert sum(mixing.targets([1, 50, 7, 0], [3, 1, 2, 3], 87)) == pytest.approx(87)


def test_mix_totals(spark, odd):
    rows = mixing.op10_low_discrepancy_mix(spark, odd["odd"][0]).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(sum(v) for v in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows), abs=5)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    all_ = np.arange(n)
    out = sharding.permute(all_, n)
    assert sorted(out.tolist()) == all_.tolist() and (sharding.permute(out, n, inverse=True) == all_).all()
    for i in (0, n - 1):
        assert sharding.row_number_at(*sharding.shard_and_slot(i, n, 7), n, 7) == i


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_shards(spark, odd, which):
    folder, rows = odd[which]
    got = sharding.op9_feistel_shards(spark, folder).collect()
    text = lambda r: (r[1] or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len(text(r)) + 16, zlib.crc32(text(r))) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max((len(v) for v in by.values()), default=0) - (min(map(len, by.values())) if len(by) == 40 else 0) <= 1
    again = sharding.op9_feistel_shards(spark.newSession(), folder).repartition(5).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_shard_columns(spark, odd):
    out = sharding.shard_rows(spark.read.parquet(f"{odd['odd'][0]}/documents.parquet"), 3)
    assert out.columns == ["doc_id", "text", "source", "size", "shard", "slot"] and dict(out.dtypes)["shard"] == "int"
