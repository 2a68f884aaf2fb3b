"""Formats read back as written; stateless rules and windows on streams."""

from pyspark.sql import functions as F

from lexassay.operators import rules
from lexassay.sources import formats
from lexassay.streaming import checks


def _write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_formats(spark, tmp_path):
    assert [r["word"] for r in formats.word_list(spark, _write(tmp_path, "w", "a\n\n b \n")).collect()] == ["a", "b"]
    t = formats.tsv(spark, _write(tmp_path, "t", "U+4E00\t一\tyi1;null\tx\ty\n"), ["cp", "ch", "sound", "parts"]).first()
    assert (t["ch"], t["parts"]) == ("一", ["x", "y"])
    m = formats.m2_records(spark, _write(tmp_path, "m", "S a b\nA 0 1|||R|||c|||REQUIRED|||-NONE-|||0\n\nS d\n\n")).collect()
    assert len(m) == 2
    c = formats.conll(spark, _write(tmp_path, "c", "-DOCSTART- O\n\nJohn B-PER\nran O\n\nParis B-LOC\n")).collect()
    assert [(r["word"], r["tag"]) for r in c] == [("John", "B-PER"), ("ran", "O"), ("Paris", "B-LOC")]
    v = formats.symbol_counts(spark, _write(tmp_path, "v", "the 10\nof 7\n")).collect()
    assert {(r["symbol"], r["n"]) for r in v} == {("the", 10), ("of", 7)}
    h = formats.hypotheses(spark, _write(tmp_path, "h", "S-0\tx\nH-1\t-0.1\t▁He ▁go es\n")).first()
    assert (h["n"], h["text"]) == (1, "He goes")
    e = formats.vectors(spark, _write(tmp_path, "e", "2 3\nthe 0.5 1 2\n")).collect()
    assert [r["word"] for r in e if len(r["vector"]) == 3] == ["the"]


def test_json_lines_keep_going_on_bad_lines(spark, tmp_path):
    p = _write(tmp_path, "j", '{"subject": "math"}\n{bad\n')
    rows = formats.json_lines(spark, p, "subject string, _bad string").select("subject", "_bad").collect()
    assert [(r["subject"], r["_bad"]) for r in rows] == [("math", None), (None, "{bad")]


def test_rules_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "对。。"), (2, "fine")], "row_id long, text string").withColumn("section", F.lit("t")).withColumn("item", F.lit(0)).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = checks.to_folder(checks.checked(stream, lambda s: s, [rules.symbol_runs, rules.web_addresses]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["source"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["。。"]


def test_usage_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'a' as kind, 1L as id union all select timestamp'2024-01-01 11:00:00', 'a', 1L union all select timestamp'2024-01-05 01:00:00', 'b', 2L").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = checks.usage(stream, "ts", "kind").writeStream.format("memory").queryName("usage_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["kind"], r["n"]) for r in spark.table("usage_out").collect()} == {("a", 2), ("b", 1)}
    u = checks.without_repeats(stream, "id", "ts", "1 day").writeStream.format("memory").queryName("once_out").trigger(availableNow=True).start()
    u.awaitTermination(60)
    assert spark.table("once_out").count() == 2
