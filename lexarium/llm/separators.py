"""Token counts by a separator scan over flat, unindexed token files.

A flat token file is nothing but little-endian ids of fixed width (uint16 where
the end-of-document id, the greatest one, fits, else uint32), each document closed
by an end-of-document id.  The scan cuts files into blocks of fixed size, finds
the closing ids of a block with one vectorised comparison, and stitches the
blocks by a prefix scan over block summaries: the running number of closed
documents gives each its ordinal, the running last closing place gives the start
of a document that began blocks earlier.  Summaries are one row a block, whatever
the documents' sizes; a document may span any number of blocks.

``write_flat`` produces such files in the folder that driver and executors
share, one for each attempt of a task, under a name of its own.  Its written manifest lists
files and the ordinals of doc_ids but no boundaries; a file of an attempt that did
not finish is not in it and is not scanned.

Cases: a null or blank text is a closing id alone (0 tokens); a text that spells out the
end-of-document token counts it as the ordinary characters that it is, so it does not
end the document; very long texts may span any number of blocks; repeated rows are
documents of their own; an empty table or file gives no rows; tokens after a
file's last closing id are an unclosed document and are reported with closed
false; further columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import remove, shared_path, stash
from .tokens import Tokens, source_of

#: The end-of-document id of the public vocabulary; ordinary text never encodes to it.
END_ID = 50256
BLOCK_IDS = 1 << 20
#: Blocks that one task searches, one after the other, and of which it writes one file.
TASK_BLOCKS = 8


def id_type(greatest: int) -> str:
    """The narrowest type of file that holds ids up to ``greatest``."""
    return "<u2" if greatest < 1 << 16 else "<u4"


def _open(uri: str):
    """(file system, path) of a folder or file URI, as executors reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_flat(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as flat token files; returns the written manifest (file, ordinal, doc_id)."""
    spark = docs.sparkSession
    text = source_of(path)
    if end_id in Tokens.of(text).fast._mergeable_ranks.values():
        raise ValueError(f"ordinary text can encode to the end-of-document id {end_id}")
    kind = file_type(end_id, path)
    source = spark.sparkContext.broadcast(text)  # a vocabulary file: a few MB, whatever the corpus

    def run(batches):
        enc = Tokens.of(source.value)
        store, root = _open(folder)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        store.create_dir(root, recursive=True)
        n = 0
        with store.open_output_stream(f"{root}/{name}") as f:
            for b in batches:
                for text in b.column(1).to_pylist():
                    f.write(np.append(enc.ids(text or ""), np.uint32(end_id)).astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), pa.array(np.arange(n, n + b.num_rows)), b.column(0)], names=["file", "ordinal", "doc_id"])
                n += b.num_rows

    return stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, ordinal long, doc_id long"), "manifest")


def file_type(end_id: int, path: str | None = None) -> str:
    """The type of the files that ``write_flat`` makes with a vocabulary."""
    return id_type(max(end_id, Tokens.of(source_of(path)).greatest))


def flat_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and sizes of the token files below ``folder``, listed through Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(p):
        return []
    return sorted((s.getPath().getName(), s.getLen()) for s in store.listStatus(p) if s.getPath().getName().endswith(".bin"))


def scan(spark: SparkSession, folder: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, kind: str | None = None, only: set[str] | None = None) -> DataFrame:
    """file, ordinal, start, n_tokens and closed of each document in the token files of ``folder``, or ``only`` those of some names."""
    listed = [(name, size) for name, size in flat_files(spark, folder) if size and (only is None or name in only)]
    kind = kind or id_type(end_id)
    width = int(kind[-1])
    upto = list(accumulate(-(-size // (width * block_ids)) for _, size in listed)) or [0]
    each_task = max(TASK_BLOCKS, -(-upto[-1] // 10_000))
    tasks = max(1, -(-upto[-1] // each_task))
    files = spark.createDataFrame([(*f, n) for f, n in zip(listed, [0, *upto])], "file string, bytes long, before long")
    ids = F.floor(F.col("bytes") / width)
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((ids - 1) / block_ids))))
    task = F.floor((F.col("before") + F.col("block")) / each_task).cast("int")
    dealt = blocks.repartitionById(tasks, task).select("file", "block", F.least(ids - F.col("block") * block_ids, F.lit(block_ids)).alias("ids"))

    def search(batches):
        store, root = _open(folder)
        for b in batches:
            for file, block, n in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(f"{root}/{file}") as f:
                    raw = f.read_at(int(n) * width, block * block_ids * width)
                ends = np.flatnonzero(np.frombuffer(raw, kind) == end_id) + block * block_ids
                last = pa.array([int(ends[-1]) if len(ends) else None], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([block * block_ids + n]), pa.array([len(ends)]), last, pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "upto", "n", "last", "ends"])

    found = stash(dealt.mapInArrow(search, "file string, block long, upto long, n long, last long, ends array<long>"), "blocks")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    summary = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    stitched = found.select("file", "block", "ends").join(summary, ["file", "block"])
    each = stitched.select("file", "first", "carry", "ends", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    closed = each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), begin.alias("start"), (F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("closed"))
    totals = found.groupBy("file").agg(F.max("upto").alias("upto"), F.sum("n").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    rest = totals.filter("upto > last + 1").select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("upto") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest)


def token_counts(docs: DataFrame, end_id: int = END_ID, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id and n_tokens of each row, counted in flat files that are written for it."""
    folder = shared_path(docs.sparkSession, "flat")
    manifest = write_flat(docs, folder, end_id, path)
    written = {r.file for r in manifest.select("file").distinct().collect()}  # one name a task
    counted = scan(docs.sparkSession, folder, end_id, block_ids, file_type(end_id, path), written)
    remove(docs.sparkSession, folder)  # the scan has read them
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
