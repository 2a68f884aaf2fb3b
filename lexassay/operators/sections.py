"""Records as long relations: one row for each text of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def question_sections(questions: DataFrame) -> DataFrame:
    """``row_id, subject, section, item, text`` for the description (item -1), stems, solutions and explanations.

    Nulls give no row; empty texts do.  One explode, no shuffle.
    """
    q = F.col("query")

    def items(section: str, arr: Column) -> Column:
        return F.coalesce(F.transform(arr, lambda t, i: F.struct(F.lit(section).alias("section"), i.cast("int").alias("item"), t.alias("text"))), F.array().cast("array<struct<section:string,item:int,text:string>>"))

    parts = F.concat(
        F.array(F.struct(F.lit("description").alias("section"), F.lit(-1).alias("item"), q["description"].alias("text"))),
        items("stems", F.transform(q["stems"], lambda s: s["stem"])),
        items("solutions", q["solutions"]),
        items("explanations", q["explanations"]),
    )
    return questions.select("row_id", "subject", F.explode(parts).alias("s")).select("row_id", "subject", "s.*").where(F.col("text").isNotNull())


def document_sections(documents: DataFrame) -> DataFrame:
    """Documents in the same shape, section ``text``, item 0."""
    return documents.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("row_id"), "subject", F.lit("text").alias("section"), F.lit(0).alias("item"), "text")


def legacy_view(questions: DataFrame) -> DataFrame:
    """The flat record of batch jobs: last received wins for each ``_id``; records without one are left out."""
    flat = questions.select(F.col("query._id").cast("bigint").alias("_id"), F.struct("received_at", "row_id").alias("_at"), F.struct("row_id", F.col("query.description").alias("question"), F.col("query.type").alias("type"), F.col("query.difficulty").alias("difficulty")).alias("r"))
    # the latest record of a partition is chosen before the exchange
    return flat.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.max_by("r", "_at").alias("r")).select("_id", "r.*")
