"""Masks by group on odd rows: null texts, words that end in s, rows that repeat."""

import duckdb

from lexarium import catalog


def both(spark, tmp_path, docs):
    items = [(3, "barlow fintry glossa")]
    made = {"documents": spark.createDataFrame(docs, "doc_id long, text string, source string"), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    con = duckdb.connect()
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.queries()["mask_by_group"](spark, str(tmp_path)).select("doc_id", "sha1", "n_masked").collect()
    want = con.sql(f"SELECT doc_id, sha1, n_masked FROM ({catalog.oracle_sql()['mask_by_group']})").fetchall()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, want))


def test_words_that_end_in_s(spark, tmp_path):
    got, want = both(spark, tmp_path, [(1, "Barlow's barlows fintrys! glossas glossa. BARLOW", "src3"), (2, "barlow the", "src2"), (3, "barlow", None)])
    assert got == want


def test_null_texts(spark, tmp_path):
    got, want = both(spark, tmp_path, [(1, None, "src3"), (2, "", "src3"), (3, " barlow ", "src3"), (None, "fintry", "src3")])
    assert got == want and len(got) == 3


def test_repeated_rows(spark, tmp_path):
    rows = [(1, "a barlow b", "src3"), (1, "a barlow b", "src3"), (2, "fintry", "src3"), (None, "glossa x", "src3"), (None, "glossa x", "src3"), (None, None, "src3")]
    got, want = both(spark, tmp_path, rows)
    assert got == want and len(got) == 3
