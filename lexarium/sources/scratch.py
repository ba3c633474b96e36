"""A folder for files that queries write and read again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share; in local mode also in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            path = tempfile.mkdtemp(prefix="lexarium-files-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _own.append("file://" + path)
        root = _own[0]
    return f"{root.rstrip('/')}/lexarium-files/{name}-{uuid.uuid4().hex}"
