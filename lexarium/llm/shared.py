"""Helpers that several operators of this subpackage share.

Intermediate tables that are read more than once go through :func:`stash`: they
are written as Parquet below ``spark.checkpoint.dir`` and read back.  That cuts
lineage and survives lost executors; nothing is kept in executor storage.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but ASCII white space.  ``bytes.split()`` splits
#: on exactly these six bytes, so Python code splits the UTF-8 bytes of a text.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: list[str] = []
#: Folders written and not yet deleted.
_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made, but only in local mode: on a
    cluster each executor would write its part to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_root:
        path = tempfile.mkdtemp(prefix="lexarium-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_root.append("file://" + path)
    return _own_root[0]


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/lexarium/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written_since(before: set[str]) -> list[str]:
    """Folders below the shared folder that were written since, and are still there."""
    return [p for p in _written if p not in before]


def written() -> set[str]:
    return set(_written)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what was written below the shared folder since its beginning; nothing may read that later."""
    before = written()
    try:
        yield
    finally:
        for path in written_since(before):
            remove(spark, path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def unstash(*frames: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in frames:
        remove(df.sparkSession, df.stash_path)


def tidy(spark: SparkSession) -> None:
    """Let the driver notice now that plans are done with; Spark's cleaner then deletes their shuffle files on all executors."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _written:
        _written.remove(folder)


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def row_key(*names: str) -> Column:
    """64-bit key of a row's contents; with ``doc_id`` beside it, it tells rows apart."""
    return F.xxhash64(*names)


_HEAVY = 512
#: Rows that Spark may broadcast by its own estimate.
_BROADCAST = 1 << 18


def by_merge(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a side of a join, never broadcast if it has many rows (``rows``, or fewer).

    Spark goes by the sizes of files, which are compressed and know nothing of a step
    in Python that makes many rows of one; the driver holds what is broadcast.
    """
    return df.hint("merge") if rows > _BROADCAST else df


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``keys``; a key that many rows of ``left`` share stays where those rows are.

    ``right`` is a written table with one row a key, whose column ``n`` is the number of
    rows of ``left`` with that key; ``left`` is read three times (to count its rows, for heavy keys and for the rest).  A key with more than one in
    512 rows is heavy.  There are fewer than 512 of them, whatever the data, so
    they are broadcast; the rest meet by a shuffle.  ``how`` is inner or left_semi.
    """
    rows = left.count()
    heavy = right.filter(F.col(n) * _HEAVY > rows)
    if heavy.isEmpty():
        return left.join(right, keys, how)
    rest = right.filter(F.col(n) * _HEAVY <= rows)
    light = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(heavy), keys, how).unionByName(light.join(rest, keys, how))


def sample_by_hash(df: DataFrame, key: Column, count: int, limit: int) -> DataFrame:
    """About ``limit`` of ``count`` rows, the same ones on each run.

    Rows of one key are drawn together; if those are many, twice ``limit`` rows are the most.
    """
    if count <= limit:
        return df
    draw = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30))
    return df.filter(draw < int((1 << 30) * limit / count)).orderBy(draw, *df.columns).limit(2 * limit)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long).

    Returns (node, root), root the smallest node of the component, for nodes that
    have an edge.  Each round of large-star and small-star contraction is two
    aggregations with joins; hot nodes are only ever joined, never gathered.
    The rounds needed grow with the logarithm of the longest path.
    """
    cur = stash(edges.filter("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    state, most = None, 2 * cur.count()  # no round makes more edges
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(by_merge(low, most), "u").filter("v > u").selectExpr("v AS u", "m AS v").filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(by_merge(low2, most), "u").selectExpr("explode(array(struct(v AS u, m AS v), struct(u AS u, m AS v))) AS e").select("e.*").filter("u <> v").distinct()
        nxt = stash(small, "edges")
        row = nxt.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        unstash(cur)
        cur = nxt
        if tuple(row) == state:
            break
        state = tuple(row)
    nodes = cur.selectExpr("u AS node", "v AS root")
    return nodes.union(cur.selectExpr("v AS node", "v AS root").distinct())
