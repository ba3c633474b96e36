"""Scans: delimited files of strings, marked-up files, text as lines, manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, all strings, quotes doubled, cells over several lines; a byte-order mark is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
    df = reader.csv(path)
    first = df.columns[0] if df.columns else ""
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df.select(columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV scan, or an empty frame of the columns if the file is missing."""
    return read_csv(spark, path, columns) if exists(spark, path) else spark.createDataFrame([], strings(columns))


def read_ragged(spark: SparkSession, path: str, columns: list[str], anchor: str, sep: str = ",") -> DataFrame:
    """Rows with surplus fields are realigned where the anchor column must repeat the first field.

    Short rows are padded with empty strings; a row that can't be realigned raises an error.
    """
    at, n = columns.index(anchor), len(columns)
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    # cells end at a separator; one in quotes may hold it, and doubled quotes
    mark = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.regexp_replace("value", "^\ufeff", ""), F.lit(sep)), F.lit(f'("(?:[^"]|"")*"|.*?){mark}'), F.lit(1))
    bare = F.transform(raw, lambda x: F.when(x.rlike('^".*"$') & (F.length(x) > 1), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    cells = lines.select(bare.alias("c")).filter(F.col("c") != F.array(*map(F.lit, columns)))  # the header alone goes
    surplus = F.size("c") - n
    pad = F.concat("c", F.array_repeat(F.lit(""), F.greatest(-surplus, F.lit(0)).cast("int")))
    # the fields before the anchor that were torn apart are joined again
    torn = F.concat(F.slice("c", 1, at - 1), F.array(F.array_join(F.slice("c", F.lit(at), (surplus + 1).cast("int")), sep)), F.slice("c", (F.lit(at) + surplus + 1).cast("int"), F.lit(n)))
    fixed = F.when(surplus <= 0, pad).when(F.get("c", (F.lit(at) + surplus).cast("int")) == F.col("c")[0], torn).otherwise(F.raise_error(F.concat(F.lit("row can't be realigned: "), F.array_join("c", sep))))
    rows = cells.select(fixed.alias("f"), (surplus > 0).alias("_realigned"))
    return rows.select(*(F.col("f")[i].alias(name) for i, name in enumerate(columns)), "_realigned")


def read_lines(spark: SparkSession, glob: str) -> DataFrame:
    """file, line_no (from 0), text of each line of the files, in whole-file scans."""
    whole = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "text"))


def in_file_order(lines: DataFrame) -> DataFrame:
    """Lines sorted by the number that the file's name is, then by name, then by line."""
    stem = F.regexp_extract("file", r"^(\d+)\.[^.]*$", 1).try_cast("long")
    return lines.orderBy(stem.asc_nulls_last(), "file", "line_no")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents that may span lines; fields that a document lacks are null."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def smoke(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """The ``n`` first rows by key for a trial run; all rows where none is given."""
    return df if n is None else df.orderBy(key).limit(n)


def paired_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of two views of the same files; a line without a twin raises an error."""
    both = a.withColumnRenamed("text", "text_a").join(b.withColumnRenamed("text", "text_b"), ["file", "line_no"], "full")
    twin = F.col("text_a").isNull() | F.col("text_b").isNull()
    return both.withColumn("text_a", F.when(twin, F.raise_error(F.concat(F.lit("no twin: "), "file"))).otherwise(F.col("text_a")))


def header_probe(spark: SparkSession, glob: str, patterns: dict[str, str], head: int = 60_000) -> DataFrame:
    """First match of each pattern in the first bytes of the files."""
    files = spark.read.format("binaryFile").load(glob)
    # the cut may split a character, which is then replaced
    text = F.make_valid_utf8(F.substring("content", 1, head).cast("string"))
    return files.select("path", *(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias(n) for n, p in patterns.items()))


def input_manifest(spark: SparkSession, glob: str) -> DataFrame:
    """Path, size and SHA-256 of each input file."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
