"""Ships the package to executors, so that Python workers can import it anywhere."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package as a zip archive to all executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexarium-zip-")  # the driver's own: Spark sends the file on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped[sc.applicationId] = str(target)


def shipped(f: Callable) -> Callable:
    """Wrap a query or stage, whose first argument is the session, so that the package is shipped first."""

    @functools.wraps(f)
    def run(spark, *args, **params):
        ship(spark)
        return f(spark, *args, **params)

    return run
