"""The pipeline's stages against brute-force versions of their decisions."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from lexarium.llm import quality, tokens

from .test_operators import LONG, ODD, SCHEMA, brute_lines, brute_targets, check_packing, near_rows

DATA = "/root/testdata"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    more = spark.createDataFrame([(1000 + (d or 0) * 1, t, g, s, n) for d, t, g, s, n in ODD if t != LONG], SCHEMA)
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    names = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == names
    # quality rules: what the operator's verdicts keep
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r.doc_id for r in quality.verdicts(spark.read.parquet(f"{folder}/documents.parquet"), marks).filter("kept").collect()}
    assert {r.doc_id for r in after["quality_rules"]} == kept and 0 < len(kept) < len(before)
    # line dedup
    want = brute_lines([(r.doc_id, r.text) for r in after["quality_rules"]], 3)
    assert {r.doc_id: r.text for r in after["line_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in after["line_dedup"])
    # near dedup
    roots = near_rows([(r.doc_id, r.text) for r in after["line_dedup"]])
    assert sorted(r.doc_id for r in after["near_dedup"]) == sorted(set(roots.values()))
    # mixing
    size = lambda t: len((t or "").encode().split())
    total, taken = {}, {}
    for r in after["near_dedup"]:
        total[r.source] = total.get(r.source, 0) + size(r.text)
    for r in after["source_mix"]:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in brute_targets(total).items())
    # packing
    check_packing(after["best_fit_packing"], [(r.doc_id, r.text) for r in after["source_mix"]], 2048, tokens.Tokens(tokens.source_of()))
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, after["best_fit_packing"]))


def test_stages_on_awkward_tables(spark, tmp_path):
    for n, rows in enumerate(([], ODD)):
        path = f"file://{tmp_path}/{n}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
            assert len(out.collect()) <= 2000 and (rows or out.count() == 0)
        corpus_pipeline.run(spark, path).count()


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_substring_dedup", "op9_topk_search", "op10_source_mix"])
def test_sql_agrees(spark, name):
    folder = f"{DATA}/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, folder)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    plain = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(df.select(cols).collect()) == plain(want.project(", ".join(cols)).fetchall())
