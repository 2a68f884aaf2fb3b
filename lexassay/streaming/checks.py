"""The stateless checks on streams, and windowed usage counts.

Every rule in ``operators.rules`` that needs no window works on a streaming DataFrame as it is; these helpers
add sources, late data and duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet" if not folder.endswith(".parquet") else folder)


def without_repeats(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the watermark; later copies beyond it count as new."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def usage(stream: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Counts by key and tumbling window; state is dropped behind the watermark."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), key, "n")


def checked(stream: DataFrame, sections: Callable[[DataFrame], DataFrame], rules: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The union of several stateless rules over the sections of a stream."""
    s = sections(stream)
    out = rules[0](s)
    for rule in rules[1:]:
        out = out.unionByName(rule(s))
    return out


def to_folder(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once Parquet sink."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
