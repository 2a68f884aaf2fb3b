"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the session runs on
    one machine is a temporary folder used.  On a cluster a missing folder is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexassay-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


#: Rows of a statistic that may be broadcast.
MOST_BROADCAST = 100_000


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows, which is counted first; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
