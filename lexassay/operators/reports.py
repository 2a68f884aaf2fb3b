"""Report algebra: located errors as rows, numbered, merged and nested.

An error row is ``row_id, section, rule, item, start_at, end_at, source, target, ord`` with half-open spans
in code points.  Reports are built by union, numbering in a window per record and section, and one
aggregation per record; a record's errors are bounded by its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("row_id", "section", "rule", "item", "start_at", "end_at", "source", "target")


def union(*errors: DataFrame) -> DataFrame:
    """All errors of several rules; equal rows are kept once."""
    return reduce(DataFrame.unionByName, [e.select(*COLUMNS) for e in errors]).distinct()


def numbered(errors: DataFrame) -> DataFrame:
    """1-based ids in each section, by item, place and rule."""
    w = Window.partitionBy("row_id", "section").orderBy("item", F.col("start_at").asc_nulls_last(), "rule", "end_at", F.coalesce("source", F.lit("")))
    return errors.withColumn("error_id", F.row_number().over(w))


def nested(errors: DataFrame) -> DataFrame:
    """``row_id, errors``: the report of a record, its sections in order, their details numbered."""
    detail = F.struct(F.col("error_id").alias("_id"), F.col("rule").alias("error_type"), F.array("source").alias("source"), F.array("target").alias("target"), F.array(F.struct("item", F.col("start_at").alias("start"), F.col("end_at").alias("end"))).alias("position"))
    by = numbered(errors).groupBy("row_id", "section").agg(F.sort_array(F.collect_list(detail)).alias("error_detail"))
    return by.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(F.col("section").alias("error_sent"), "error_detail"))).alias("errors"))


def flat(reports: DataFrame) -> DataFrame:
    """Stored nested reports as rows: ``report_id, section_at, section, detail_at, error_type, n_source, n_positions``."""
    s = reports.select("report_id", F.posexplode("errors").alias("section_at", "s"))
    d = s.select("report_id", "section_at", F.col("s.error_sent").alias("section"), F.posexplode("s.error_detail").alias("detail_at", "d"))
    return d.select("report_id", "section_at", "section", "detail_at", F.col("d.error_type").alias("error_type"), F.coalesce(F.size("d.source"), F.lit(0)).alias("n_source"), F.coalesce(F.size("d.position"), F.lit(0)).alias("n_positions"))


def merged(reports: DataFrame) -> DataFrame:
    """Reports on one question merged by section without duplicates: ``_id, section, error_type, n``.

    Pre-aggregated by (question, section, type) before the exchange, so that a question with many reports
    is no hot group.
    """
    s = reports.select("_id", F.explode("errors").alias("s")).select("_id", F.col("s.error_sent").alias("section"), F.explode("s.error_detail").alias("d"))
    return s.groupBy("_id", "section", F.coalesce("d.error_type", F.lit("")).alias("error_type")).agg(F.count("*").alias("n"))


def with_context(errors: DataFrame, sections: DataFrame, width: int = 4) -> DataFrame:
    """Errors with ``width`` characters of text on either side of their span."""
    j = errors.join(sections.select("row_id", "section", "item", "text"), ["row_id", "section", "item"])
    a = F.greatest(F.col("start_at") - width, F.lit(0))
    return j.withColumn("context", F.substring(F.col("text"), a + 1, F.col("end_at") + width - a)).drop("text")
