"""All stages of the pipeline in a row, line and near dedup by their own rules."""

import corpus_pipeline
from lexarium.llm import tokens

from .test_line_words import brute_wordy
from .test_near import brute_kept
from .test_operators import brute_targets, check_packing
from .test_pipeline import folder  # noqa: F401


def test_stages_in_a_row(spark, folder, tmp_path):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = docs.collect()
    lined = {r.doc_id: r.text for r in after["line_dedup"]}
    assert lined == brute_wordy([(r.doc_id, r.text) for r in after["quality_rules"]], 3, 50)
    assert all(r.n_chars == len(r.text) for r in after["line_dedup"])
    assert sorted(r.doc_id for r in after["near_dedup"]) == brute_kept(lined.items())
    size = lambda t: len((t or "").encode().split())
    total, taken = {}, {}
    for r in after["near_dedup"]:
        total[r.source] = total.get(r.source, 0) + size(r.text)
    for r in after["source_mix"]:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in brute_targets(total).items())
    check_packing(after["best_fit_packing"], [(r.doc_id, r.text) for r in after["source_mix"]], 2048, tokens.Tokens(tokens.source_of()))
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, after["best_fit_packing"]))
