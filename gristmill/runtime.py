"""Makes the package importable in the Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as tmp:
        copy = Path(tmp, "src", root.name)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        target = tempfile.mkdtemp(prefix="gristmill-src-")
        atexit.register(shutil.rmtree, target, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{target}/gristmill", "zip", Path(tmp, "src")))
    _SHIPPED.add(sc.applicationId)
