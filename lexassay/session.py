"""Making the package known to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of a session, once, unless they find it by themselves.

    They do if its folder is on ``PYTHONPATH`` or, on one machine, is the working directory.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    found = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.master.startswith("local[") or sc.master == "local":
        found.append(Path.cwd())
    if ROOT not in found:
        folder = tempfile.mkdtemp(prefix="lexassay-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "lexassay-package"), "zip", ROOT, "lexassay"))
