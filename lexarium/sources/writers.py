"""Sinks: delimited files, JSON, one text per document, and a staged commit with read-back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').mode("errorifexists").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], rows: int = 2_000_000) -> None:
    """One folder for each combination of ``by``; rows meet their folder's writer before, so files stay few.

    A folder of more than about ``rows`` rows has several writers, so a hot value is no single task.
    """
    # at most one row for each ``rows`` rows of the table
    big = df.groupBy(*(F.col(c).alias(f"_k_{c}") for c in by)).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by))
    spread = df.join(big, same, "left").select(*df.columns, F.floor(F.rand(1) * F.ceil(F.coalesce("_n", F.lit(1)) / rows)).alias("_lx_part"))
    spread.repartition(*by, "_lx_part").drop("_lx_part").write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook as a folder: one delimited file of rows for each sheet."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


def freeze(spark: SparkSession, folder: str, names: Sequence[str], path: str) -> None:
    """Copy some results of a folder to a new one that is never written again."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target = fs.Path(path)
    if target.getFileSystem(conf).exists(target):
        raise FileExistsError(path)
    for name in names:
        source, copy = fs.Path(f"{folder}/{name}"), fs.Path(f"{path}/{name}")
        fs.FileUtil.copy(source.getFileSystem(conf), source, copy.getFileSystem(conf), copy, False, conf)


def documents(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One text per key, lines joined in order without a last line end; keys without lines have none."""
    held = lines.filter(F.col(text).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_l"))
    return held.select(key, F.array_join(F.transform("_l", lambda x: x[text]), "\n").alias("text"))


def write_documents(docs: DataFrame, key: str, path: str) -> None:
    """Text files, a folder for each key."""
    docs.select(key, F.col("text").alias("value")).write.mode("errorifexists").partitionBy(key).text(path)


def reconcile(planned: DataFrame, written: DataFrame) -> DataFrame:
    """Rows that only one of plan and read-back has; empty if the write is whole."""
    return planned.exceptAll(written).withColumn("side", F.lit("missing")).unionByName(written.exceptAll(planned).withColumn("side", F.lit("extra")))


def commit(spark: SparkSession, df: DataFrame, path: str) -> int:
    """Write to a staging folder, compare with the plan, then rename; never over an existing folder. Returns the rows."""
    jvm = spark._jvm
    final, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".staging")
    store = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(final):
        raise FileExistsError(path)
    store.delete(staging, True)
    df.write.parquet(path + ".staging")
    back = spark.read.schema(df.schema).parquet(path + ".staging")
    if not reconcile(df, back).isEmpty():
        raise RuntimeError(f"read-back of {path} differs from the plan")
    n = back.count()
    if not store.rename(staging, final):
        raise RuntimeError(f"{path} could not be put in place")
    return n


def markdown(title: str, small: DataFrame) -> str:
    """A report table of a small frame (it is collected: reviewed dimensions, not data); one of over 1,000 rows is an error."""
    rows = small.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError(f"the table {title!r} has more than 1,000 rows")
    head = "| " + " | ".join(small.columns) + " |\n|" + "---|" * len(small.columns)
    return "\n".join([f"## {title}", "", head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows), ""])
