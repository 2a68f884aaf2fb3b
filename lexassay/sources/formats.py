"""Text formats of the domain as DataFrames, and back.

Files are split by Spark; nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION = "grade string, subject string, query struct<_id:double,description:string,stems:array<struct<stem:string,options:map<string,string>>>,labels:array<string>,answers:string,solutions:array<string>,explanations:array<string>,difficulty:double,type:string>"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines; unreadable lines land in ``_bad`` instead of failing the job."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``value``: one row a line, or a record by another separator."""
    return spark.read.text(path, lineSep=separator) if separator else spark.read.text(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """``word``: trimmed lines that are not empty."""
    return lines(spark, path).select(F.trim("value").alias("word")).where("word <> ''")


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated fields; the last column takes the ragged rest as an array."""
    parts = F.split("value", "\t")
    n = len(columns)
    return lines(spark, path).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns[:-1])], F.slice(parts, n, F.greatest(F.size(parts) - n + 1, F.lit(0))).alias(columns[-1]))


def m2_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: blank-line separated M2 records."""
    return lines(spark, path, "\n\n").select(F.trim("value").alias("record")).where("record <> ''")


def write_m2(df: DataFrame, column: str, path: str) -> None:
    df.select(F.concat(F.col(column), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def conll(spark: SparkSession, path: str) -> DataFrame:
    """``sent, pos, word, tag``: sentences end at blank lines or document starts."""
    rec = lines(spark, path, "\n\n").select(F.monotonically_increasing_id().alias("sent"), F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("-DOCSTART-")).alias("l")).where(F.size("l") > 0)
    f = lambda x: F.split(F.trim(x), "[ \t]+")
    return rec.select("sent", F.posexplode("l").alias("pos", "x")).select("sent", "pos", F.get(f(F.col("x")), F.lit(0)).alias("word"), F.element_at(f(F.col("x")), -1).alias("tag"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vector``: a text file of vectors."""
    p = F.split("value", " ")
    return lines(spark, path).select(F.get(p, F.lit(0)).alias("word"), F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x.try_cast("float") if hasattr(x, "try_cast") else x.cast("float")).alias("vector")).where(F.size("vector") > 1)


def symbol_counts(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, n`` of a vocabulary file; a symbol given twice is an error."""
    v = lines(spark, path).select(F.regexp_extract("value", r"^(.*) ([0-9]+)$", 1).alias("symbol"), F.regexp_extract("value", r"^(.*) ([0-9]+)$", 2).cast("long").alias("n")).where("symbol <> ''")
    w = Window.partitionBy("symbol")
    return v.withColumn("_k", F.count("*").over(w)).select(F.when(F.assert_true(F.col("_k") == 1, F.concat(F.lit("twice: "), F.col("symbol"))).isNull(), F.col("symbol")).alias("symbol"), "n")


def hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """``n, text`` of generator output: lines ``H-<n>``, detokenised, in order of n."""
    p = F.split("value", "\t")
    h = lines(spark, path).where(F.col("value").startswith("H-"))
    return h.select(F.substring(F.get(p, F.lit(0)), 3, 20).cast("long").alias("n"), F.trim(F.replace(F.replace(F.element_at(p, -1), F.lit(" "), F.lit("")), F.lit("▁"), F.lit(" "))).alias("text"))
