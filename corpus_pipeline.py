"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.

Cases, in all stages: empty tables give empty tables; null texts count as empty;
very long texts are taken whole; rows without a doc_id, repeated rows and rows of one doc_id with
different texts are documents like others; ties go by doc_id; columns beyond those of
documents are dropped at the start of a stage.  What a stage does with each is said there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexarium.deploy import shipped
from lexarium.llm import lines, mixing, near, packing, quality
from lexarium.llm.shared import remove, scratch, shared_path, written, written_since

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, blank and short texts among them; repeated rows are judged alike."""
    return quality.keep_clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of three lines or 50 words go; n_chars follows the text.

    No row goes: a text that is cut whole stays as an empty one.  Rows that are equal in doc_id and text are cut alike.
    """
    out = lines.dedup_lines(docs.select(COLUMNS), words=50)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays, the one with the smallest doc_id.

    Rows without a doc_id come last; of repeated rows, and of null and blank texts, one stays.
    """
    return near.one_per_group(docs.select(COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes; n_chars follows the text.

    Null and blank texts are never taken; a null source is a source of its own.
    """
    out = mixing.mixed_rows(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their places in sequences of 2048 tokens; an empty text is the closing id alone."""
    return packing.pack_documents(docs)


#: Folders that earlier stages left for their results to be read from.
_left: list[str] = []


def staged(stage: Callable) -> Callable:
    """Wrap a stage: what earlier stages left is deleted first, but for what ``docs`` still reads (their results are written by then)."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        used = "\n".join(docs.inputFiles()) if _left else ""
        for folder in [x for x in _left if x.rsplit("/", 1)[1] not in used]:
            remove(spark, folder)
            _left.remove(folder)
        before = written()
        out = stage(spark, docs, sf_dir)
        _left.extend(written_since(before))
        return out

    return shipped(run)


STAGES = [
    ("quality_rules", staged(quality_rules)),
    ("line_dedup", staged(line_dedup)),
    ("near_dedup", staged(near_dedup)),
    ("source_mix", staged(source_mix)),
    ("best_fit_packing", staged(best_fit_packing)),
]

#: SQL can't express the first, third and last stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, writing what each one keeps; a stage's input and tables go once its output is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
