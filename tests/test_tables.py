import pytest
from bibspark.operators import review
from bibspark.operators.tables import Tables
from bibspark.sources import pages
from pyspark.sql import functions as F


def test_versions(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/store")
    assert not t.exists("documents") and t.count("documents") == 0
    with pytest.raises(KeyError):
        t.load("documents")
    rows = lambda *r: spark.createDataFrame(list(r), "run_id string, work_id string, title string")
    t.upsert("documents", rows(("r", "a", "one"), ("r", "b", "two"), ("q", "a", "other")), ["run_id", "work_id"])
    before = t.load("documents")
    t.upsert("documents", rows(("r", "b", "new"), ("r", None, "no id")), ["run_id", "work_id"])
    assert before.count() == 3  # who reads the version before can end
    t.upsert("documents", rows(("r", None, "again")), ["run_id", "work_id"])
    assert {(r.work_id, r.title) for r in t.documents("r").collect()} == {("a", "one"), ("b", "new"), (None, "again")}
    assert t.documents("r", "b").first().title == "new"
    (tmp_path / "store" / "documents" / "v9").mkdir()  # a writer that died
    assert t.count("documents") == 4
    t.clear("documents")
    assert t.count("documents") == 0


def test_runs_and_events(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/store")
    t.create_run("r1", "2024-01-01", name="first")
    t.create_run("r2", "2024-01-02", name="second")
    with pytest.raises(ValueError):
        t.create_run("r1", "2024-01-03")
    assert t.run("r2").first().status == "created" and t.count("runs") == 2
    for i in range(3):
        t.append("review_events", spark.createDataFrame([("r1", i)], "run_id string, n int"))
    assert sorted(r.n for r in t.review_events("r1").collect()) == [0, 1, 2]


def test_reviewed_text(spark):
    rows = spark.createDataFrame([(" a ; b\r\n\nc\n", ), ("  ",), (None,), ("x",)], "t string")
    got = rows.select(review.reviewed_values(F.col("t"), repeatable=True).alias("m"), review.reviewed_values(F.col("t"), repeatable=False).alias("s")).collect()
    assert [r.m for r in got] == [["a", "b", "c"], [], [], ["x"]] and [len(r.s) for r in got] == [1, 0, 0, 1]
    assert spark.range(1).select(review.typed_text(F.array(F.lit(" a "), F.lit(""), F.lit("b")))).first()[0] == "a\nb"


def test_reviewed_changes(spark):
    ledger = spark.createDataFrame([("r", "authors", "B", "api_review", 2), ("r", "authors", "A", "api_review", 1), ("r", "title", "T", "bibtex_raw_field", None), ("r", "place", "P", "api_review", None)], "record_id string, field_id string, value string, method string, sequence int")
    overrides = spark.createDataFrame([("r", "manual.1"), ("q", None)], "record_id string, schema_override string")
    excluded = spark.createDataFrame([("r", "url"), ("r", "place")], "record_id string, field_id string")
    got = {(r.field_id, r.replacement_value) for r in review.reviewed_changes(ledger, overrides, excluded).collect()}
    assert got == {("authors", "A\nB"), ("place", "P"), ("url", None), ("__schema_id__", "manual.1")}


def test_recognition_command(spark):
    row = spark.range(1).select(pages.recognition_command("ocr", F.lit("in.png"), F.lit("out"), languages="por+eng", models="/m").alias("a")).first()
    assert row.a == ["ocr", "in.png", "out", "-l", "por+eng", "--oem", "1", "--psm", "3", "--tessdata-dir", "/m", "-c", "tessedit_create_tsv=1"]
