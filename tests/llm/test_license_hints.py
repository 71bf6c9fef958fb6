import duckdb
from quadrille.llm import license_scan as s

TEXTS = ["This work is in the public\ndomain.", "x\n\nThis is free and unencumbered software released into the public\ndomain.", "This work is in the public-domain.", "This program is free-software", "Version 2.0,\nJanuary, 2004", "words only"]


def test_hint_before_normalisation(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in s.op6_license_sentences(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows == sorted(con.execute(s.OP6_SQL).fetchall())
    assert [r[3] for r in rows[:3]] == ["Public-Domain", "Unlicense", "Public-Domain"] and rows[3][2] == "<gpl-free>" and rows[5][1] == 0


def test_either_reading(spark):
    text = "Released under the MIT License\nwithout more\n\nThis work is in the public\ndomain.\n\nLicensed under the BSD\nlicense."
    (row,) = s.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.licenses == ["BSD", "Public-Domain"] and row.either == ["BSD", "Public-Domain", "MIT"]
