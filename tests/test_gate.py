import datetime
import io
import zipfile

import pytest
from bibspark.operators import extract, gate, review, sinks, store
from bibspark.streaming import folder
from pyspark.sql import functions as F


def test_classified_metadata(spark):
    rows = spark.createDataFrame(
        [("ok", "T", 1, None, "m", 0.9, "2020", "J", "journal_article"), ("none", None, 0, None, "m", 0.0, None, None, "unknown"), ("hidden", "T", 0, None, "not_visible_in_print", 0.0, "2020", None, "unknown"), ("weak", "T", 2, None, "m", 0.5, None, None, "journal_article"), ("corp", "T", 0, "C", "m", 0.0, "2020", None, "book_manual")],
        "k string, title string, n_authors int, corporate_author string, authors_method string, authors_confidence double, year string, journal string, document_type string",
    )
    got = {r.k: (r.status, r.errors) for r in gate.classify_metadata(rows).collect()}
    assert got == {"ok": ("processed", []), "none": ("failed", ["title_not_found", "authors_ambiguous", "year_ambiguous"]), "hidden": ("review_required", ["authors_not_visible_in_source"]), "weak": ("review_required", ["authors_ambiguous", "year_ambiguous", "journal_not_found"]), "corp": ("processed", [])}


def test_warnings(spark):
    page = "struct<method:string,confidence:double,diagnostic_code:string>"
    rows = spark.createDataFrame([(1, [("unavailable", None, None), ("ocr", 0.5, None), ("skipped", None, None)], ["api_review", "x_inferred"], None), (2, [("native", None, None)], [], "Rio"), (3, [("unavailable", None, "ocr_language_missing")], ["publisher_profile"], "Rio")], f"k int, pages array<{page}>, methods array<string>, place string")
    w = gate.page_warnings(F.col("pages"), F.col("methods"), place=F.col("place"), document_type=F.lit("journal_article"), authors_method=F.lit("m"))
    got = {r.k: (r.w, r.s) for r in rows.select("k", w.alias("w"), gate.with_warnings(F.lit("processed"), w).alias("s")).collect()}
    assert got[1] == (["ocr_not_available", "page_text_unavailable", "ocr_low_confidence", "metadata_pages_only", "place_not_identified", "human_review", "inferred_metadata"], "processed_with_warnings")
    assert got[2] == ([], "processed") and got[3][0] == ["ocr_language_missing", "page_text_unavailable", "inferred_metadata"]


def test_weak_ocr_evidence(spark):
    evidence = spark.createDataFrame([("a", "v", 1), ("b", "v", 2), ("c", None, 1), ("d", "v", None)], "doc_id string, value string, page_number int")
    pages = spark.createDataFrame([(d, n, "ocr", 0.7 if n == 1 else 0.8) for d in "abcd" for n in (1, 2)], "doc_id string, page_number int, method string, confidence double")
    assert [r.doc_id for r in gate.low_ocr_evidence(evidence, pages).collect()] == ["a"]


def test_human_approval(spark):
    b = lambda x: F.lit(x)
    row = spark.range(1).select(gate.human_approved(b("approved"), b(False), b(False), b(False), b(False)).alias("a"), gate.human_approved(b("corrected"), b(False), b(False), b(True), b(False)).alias("b"), gate.human_approved(b("corrected"), b(False), b(False), b(False), b(False)).alias("c"), gate.human_approved(b("pending"), b(True), b(True), b(True), b(True)).alias("d")).first()
    assert tuple(row) == (True, True, False, False)


def test_document_types(spark):
    texts = {"dissertation": "dissertacao apresentada ao", "thesis": "tese de doutorado", "journal_article": "plant methods vol", "book_manual": "isbn 978 85 2a edicao", "web_article": "publicado em gov.br", "unknown": "nothing"}
    df = spark.createDataFrame(list(texts.items()), "want string, t string").withColumn("s", extract.article_signals(F.col("t"), F.col("t")))
    kind = extract.document_type(F.col("t"), F.col("t"), F.col("s"), ["plant methods"])
    assert all(r.want == r.got for r in df.select("want", kind.alias("got")).collect())


def test_periodical_fields(spark):
    texts = [
        "Revista X, v. 12, n. 3, p. 10-20, jan., 2019\n",
        "Journal of Y 45 (2018) 100–110\n",
        "Published in: Letters of Z\nVolume 7, issue 2\npp. 5-9 Published 3 May 2017 http://doi.org/10.1/x http://e.org/a).",
        "Acta W\nISSN 1234-5678\n© 2016",
        "nothing here",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", extract.periodical_fields(F.col("t"), F.lit("10.1/x")).alias("f")).collect()}
    assert (got[0].journal, got[0].volume, got[0].issue, got[0].pages, got[0].year) == ("Revista X", "12", "3", "10-20", "2019")
    assert (got[1].journal, got[1].volume, got[1].pages, got[1].year) == ("Journal of Y", "45", "100-110", "2018")
    assert (got[2].journal, got[2].volume, got[2].issue, got[2].pages, got[2].year, got[2].source_url) == ("Letters of Z", "7", "2", "5-9", "2017", "http://e.org/a")
    assert (got[3].journal, got[3].year) == ("Acta W", "2016") and all(v is None for v in got[4])


def test_line_helpers(spark):
    row = spark.range(1).select(
        extract.between(F.array(*map(F.lit, "a S b c E d".split())), "S", "E").alias("a"),
        extract.without_repeats(F.array(*map(F.lit, ["x", "X", "y", "x", "y"])), F.lower).alias("b"),
        extract.canonical_key(F.lit(""), F.lit(""), F.lit(""), F.lit("paper pdf original")).alias("c"),
        extract.stem_key(F.lit("paper ocr site 2")).alias("d"),
        extract.page_doi(F.array(F.lit("no"), F.lit("see 10.1234/ab.c."))).alias("e"),
    ).first()
    assert row.a == ["b", "c"] and row.b == ["x", "y"] and (row.c, row.d, row.e) == ("file:paper", "paper 2", "10.1234/ab.c")


def test_front_text(spark):
    pages = spark.createDataFrame([("a", 3, "three"), ("a", 1, "one"), ("a", 2, ""), ("a", 4, "four")], "doc_id string, page_number int, text string")
    assert extract.front_text(pages, 2).first().text == "one three"


def test_merge_and_corrections(spark):
    docs = spark.createDataFrame([("a", "Old", "2020"), ("b", "Keep", None)], "k string, title string, year string")
    entries = spark.createDataFrame([("a", "New", "2020")], "k string, title string, year string")
    got = {r.k: (r.title, r.year, r.conflict, r.applied) for r in review.merge_structured(docs, entries, "k").collect()}
    assert got == {"a": ("New", "2020", True, True), "b": ("Keep", None, False, False)}
    changes = spark.createDataFrame([("place", "Sao Paulo", "São Paulo", "x", 1), ("place", "Sao  Paulo", "São Paulo", "x", 2), ("doi", "10.1", "10.2", "x", 1), ("place", "ab", "abc", "x", 1), ("place", "Rio", "RIO", "x", 1), ("place", "Sao Paulo", "SP", "x", 3)], "field_name string, source_value string, replacement_value string, document_type string, ts int")
    memory = review.confirmed(review.correction_candidates(changes))
    assert {(r.replacement_value, r.confirmation_count) for r in memory.collect()} == {("São Paulo", 2), ("SP", 1)}
    values = spark.createDataFrame([("d", "place", "sao paulo", "x"), ("e", "place", "sao paulo", "y")], "doc_id string, field_name string, source_key string, document_type string")
    assert [(r.doc_id, r.suggestions) for r in review.suggestions(values, memory).collect()] == [("d", ["São Paulo", "SP"])]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "o"), (2, "b", "o")], "k int, v string, original string")
    new = spark.createDataFrame([(2, "x", "n", 1), (2, "y", "n", 2), (3, "z", "n", 1)], "k int, v string, original string, ord int")
    assert {tuple(r) for r in review.upserted(old, new, ["k"], keep_first=("original",)).collect()} == {(1, "a", "o"), (2, "y", "o"), (3, "z", "n")}


def test_stores(spark):
    cache = spark.createDataFrame([("a", 1, "p"), ("b", 3, None), ("c", 2, "pp")], "k string, used int, payload string")
    hits, misses = store.cache_lookup(spark.createDataFrame([("a",), ("b",), ("z",)], "k string"), cache, ["k"])
    assert [r.k for r in hits.collect()] == ["a"] and {r.k for r in misses.collect()} == {"b", "z"}
    assert {r.k for r in store.prune(cache, 2, order=["used"]).collect()} == {"b", "c"}
    assert tuple(store.cache_summary(cache).first()) == (3, 3)
    runs = spark.createDataFrame([("r1", "running", None, 1, "2020"), ("r2", "done", None, 4, "2021")], "run_id string, status string, error_message string, revision int, created_at string")
    assert {(r.run_id, r.status, r.error_message, r.revision) for r in store.recovered(runs).collect()} == {("r1", "failed", "interrupted", 2), ("r2", "done", None, 4)}
    assert [r.run_id for r in store.latest_runs(runs, 1).collect()] == ["r2"]
    labels = spark.createDataFrame([("book", "Books", 1)], "family string, label string, position int")
    assert {(r.label, r.works) for r in store.family_groups(spark.createDataFrame([("book",), ("film",), (None,)], "family string"), labels).collect()} == {("Books", 1), ("other", 2)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("2", "b", "", "", "Second"), ("1", "a", "", "", "First"), ("3", "c", "", "", None)], "record_id string, sort_name string, sort_title string, sort_year string, reference string")
    sinks.write_text(rows, str(tmp_path / "refs"), notice="draft")
    assert "".join(p.read_text() for p in sorted((tmp_path / "refs").glob("part-*"))) == "First\n\nSecond\n\n"
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    data = sinks.docx_bytes(["A <b> Title here"], [["Title"]])
    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()
    assert "<w:b/>" in xml and "A &lt;b&gt; " in xml
    failed = spark.createDataFrame([("s", "failed", "read", "E", "no /home/me/x.pdf\nhere")], "source_name string, status string, phase string, exception_type string, message string")
    assert sinks.failures(failed).first().message == "no <path> here"
    report = spark.createDataFrame([("1", "s", "blocked", ["x"], None), ("2", "t", "ready", [], "R")], "record_id string, source_name string, readiness string, issues array<string>, reference string")
    assert [r.text for r in sinks.report_lines(report).collect()] == ["s\nstatus: blocked\n- x"]


def test_publication(tmp_path):
    target = tmp_path / "out"
    for i in range(4):
        with sinks.Publication(str(target), history=2) as p:
            (p / "f").write_text(str(i))
    assert (target / "f").read_text() == "3" and len(list((tmp_path / "out.history").iterdir())) == 2
    with pytest.raises(RuntimeError), sinks.Publication(str(target)) as p:
        raise RuntimeError
    assert (target / "f").read_text() == "3"


def test_stream_of_inventories(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [("a", "pdf", 1, "h1", at), ("a", "pdf", 1, "h1", at), ("b", "ris", 2, "h2", at + datetime.timedelta(minutes=5)), ("a", "pdf", 3, "h3", at + datetime.timedelta(hours=3))]
    spark.createDataFrame(rows, folder.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = folder.inventories(spark, str(tmp_path / "in"))
    q = folder.first_seen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 3
    q = folder.arrivals(stream).writeStream.format("memory").queryName("came").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.source_type, r.files, r["bytes"]) for r in spark.table("came").collect()} == {("pdf", 2, 2), ("ris", 1, 2), ("pdf", 1, 3)}
