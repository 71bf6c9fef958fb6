import importlib.util

import __spark_entry__
import pytest


def test_names_and_oracles():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 78
    if importlib.util.find_spec("quadrille.llm"):
        assert {n.split("_")[0] for n in queries if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.n > 0


@pytest.mark.parametrize("name", ["prj02_crop", "agg03_percentiles", "agg10_object_table", "stn13_rotate_30"])
def test_some_queries(spark, name):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
