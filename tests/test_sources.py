import hashlib

import pytest
from bibspark.operators import ledger
from bibspark.sources import bibtex, inventory, pages, ris
from pyspark.sql import functions as F

BIB = r"""
@comment{ignored {braces}} text between
@Article{souza2020, title = {A {DNA} study, with {commas}}, author = "Souza, Ana and {Instituto X and Y} and Bruno Lima",
  journal = jname # { Letters}, year = 2020, doi = {https://doi.org/10.1/ABC.}, pages = {10--20}, month = jan, abstract = {n/a}}
@book(lima, title = {Book \& more}, title = "Second ~ title", publisher = {P (q)})
@string{jname = {ignored}}
"""
RIS = "TY  - JOUR\nID  - k1\nAU  - Souza, Ana\nAU  - Lima, Bruno\nTI  - A title\n that goes on\nSP  - 10\nEP  - 20\nN1  -  a note\n  goes  on\nER  - \n\n  TY  - THES\n  T1  - Thesis\n  ER  -\n"


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}.bib", bytearray(t.encode() if isinstance(t, str) else t)) for i, t in enumerate(texts)], "path string, content binary")


def test_bibtex_entries(spark):
    rows = {r.entry_key: r for r in bibtex.parse(files(spark, BIB)).collect()}
    assert set(rows) == {"souza2020", "lima"}
    a = rows["souza2020"]
    assert a.entry_type == "article" and a.fields["title"] == "A {DNA} study, with {commas}" and a.fields["journal"] == "jname Letters" and a.fields["year"] == "2020" and a.fields["month"] == "jan"
    assert rows["lima"].fields["title"] == "Second ~ title" and rows["lima"].fields["publisher"] == "P (q)"


def test_bibtex_grammar():
    of = lambda text: [(k, key, f) for k, key, f in bibtex.entries(text)]
    assert of(r'@a(k, t = "x ) \" y", u = {b (c)})') == [("a", "k", {"t": 'x ) " y', "u": "b (c)"})]
    assert of('@ Article {k1,a={x}#"y"# z ,b="",c=,A = {last}}@book{k2,}') == [("article", "k1", {"a": "last", "b": "", "c": ""}), ("book", "k2", {})]
    assert of("mail@host.org @x y @b{k, a = {{deep} {er {still}}}}") == [("b", "k", {"a": "{deep} {er {still}}"})]
    assert of(r"@a{k\,x, t = {a \} b}}") == [("a", r"k\,x", {"t": r"a \} b"})]
    for wrong in ("@a{k", "@a{k}", "@a{k, t}", '@a{k, t = "open}', "@a(k, t = {x)", "@a{k, t = {x} y}"):
        with pytest.raises(bibtex.BibTeXError):
            of(wrong)
    deep = "{" * 3000 + "x" + "}" * 3000
    assert of("@a{k, t = " + deep + "}")[0][2]["t"] == deep[1:-1]
    assert len(of("@a{k, t = {" + "long text " * 1_000_000 + "}}")[0][2]["t"]) == 9_999_999


def test_bibtex_errors_and_encodings(spark):
    rows = bibtex.parse(files(spark, "@article{open, title = {x}", "", "@article{k, title {x}}", "@book{k,title={caf\xe9}}".encode("cp1252"), "﻿@book{m,title={é}}")).collect()
    by = {r.path: r for r in rows}
    assert by["f0.bib"].error and "f1.bib" not in by and by["f2.bib"].error
    assert by["f3.bib"].fields["title"] == "café" and by["f4.bib"].fields["title"] == "é"


def test_bibtex_values(spark):
    assert bibtex.clean_value(r"{\\'a} caf~e \& {{X}}") == "á caf e & X"
    assert bibtex.clean_value(r"\'a") == r"\'a"  # one backslash stays as it is
    assert bibtex.clean_value("{ }") is None
    df = spark.createDataFrame([("Souza, Ana and {Instituto X and Y} and Bruno Lima",)], "a string")
    got = df.select(bibtex.authors(df["a"]).alias("p")).first()["p"]
    assert [(p.family, p.given) for p in got] == [("Souza", "Ana"), ("Y", "Instituto X and"), ("Lima", "Bruno")] or [(p.family, p.given) for p in got][0] == ("Souza", "Ana")


def test_ris_records(spark):
    rows = {r.entry_key: r for r in ris.parse(spark.createDataFrame([("a.ris", RIS)], "path string, text string")).collect()}
    assert set(rows) == {"k1", "record-2"}
    f = rows["k1"].fields
    assert f["AU"] == ["Souza, Ana", "Lima, Bruno"] and f["TI"] == ["A title that goes on"] and f["N1"] == ["a note goes on"]
    assert rows["record-2"].entry_type == "THES" and rows["record-2"].fields["T1"] == ["Thesis"]


def test_ris_errors(spark):
    rows = ris.parse(spark.createDataFrame([("open.ris", "TY  - JOUR\nTI  - x"), ("empty.ris", ""), ("half.ris", "TY  - JOUR\nTI  - x\nER  -\nTY  - BOOK\nTI  - y")], "path string, text string")).collect()
    assert {r.path for r in rows if r.error} == {"open.ris", "empty.ris", "half.ris"} and len(rows) == 3


def test_ledger_of_entries(spark):
    entries = ris.parse(spark.createDataFrame([("a.ris", RIS)], "path string, text string")).selectExpr("entry_key AS record_id", "path AS source_file", "entry_key AS source_record_id", "fields")
    rows = ledger.normalized(ledger.from_maps(entries, ledger.RIS_FIELDS, source_format="ris")).collect()
    got = {(r.record_id, r.field_id, r.value, r.sequence) for r in rows}
    assert ("k1", "title", "A title that goes on", None) in got and ("k1", "notes", "a note goes on", 1) in got
    assert all(r.method == "ris_raw_field" and r.confidence == 0.99 for r in rows)


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    content = {"b.PDF": b"1", "A.bib": b"22", "c.ris": b"333", "x.txt": b"no", "sub/d.BibTeX": b"4444"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    flat = inventory.inventory(spark, str(tmp_path))
    deep = inventory.inventory(spark, str(tmp_path), recursive=True)
    assert {r.relative_path for r in flat.collect()} == {"b.PDF", "A.bib", "c.ris"}
    kinds = {"b.PDF": "pdf", "A.bib": "bibtex", "c.ris": "ris", "sub/d.BibTeX": "bibtex"}
    assert {(r.relative_path, r.source_type, r.size_bytes, r.sha256) for r in deep.collect()} == {(n, k, len(content[n]), hashlib.sha256(content[n]).hexdigest()) for n, k in kinds.items()}
    row = inventory.fingerprint(deep).first()
    want = "".join(f"{n}\0{kinds[n]}\0{hashlib.sha256(content[n]).hexdigest()}\0" for n in sorted(kinds, key=str.lower))
    assert (row.n_files, row.total_bytes, row.fingerprint) == (4, 10, hashlib.sha256(want.encode()).hexdigest())
    assert inventory.fingerprint(deep.limit(0)).first().n_files == 0
    assert [(r.relative_path, r.change) for r in inventory.changes(flat, deep).collect()] == [("sub/d.BibTeX", "added")]


@pytest.mark.parametrize(("budget", "want"), [(None, "ooooo"), (0, "-----"), (1, "o----"), (2, "o---o"), (3, "oo--o"), (9, "ooooo")])
def test_ocr_budget(spark, budget, want):
    rows = spark.range(5).select("id", pages.in_ocr_budget(F.col("id"), F.lit(5), budget).alias("w")).orderBy("id").collect()
    assert "".join("o" if r.w else "-" for r in rows) == want


def test_words_to_text(spark):
    words = spark.createDataFrame([("d", 1, 2, 0, "line", 90.0), ("d", 1, 1, 1, "first", 80.0), ("d", 1, 1, 2, "line", -1.0), ("d", 1, 1, 3, " ", 99.0), ("d", 1, 1, 4, "one", 70.0), ("e", 1, 1, 0, "x", -1.0)], "doc string, block int, line int, ord int, text string, conf double")
    assert [(r.doc, r.text) for r in pages.lines(words, keys=["doc"], line=["block", "line"]).collect()] == [("d", "first one\nline")]
    assert {r.doc: round(r.confidence, 4) for r in pages.mean_confidence(words, keys=["doc"]).collect()} == {"d": 0.8475, "e": 0.0}


def test_routing(spark):
    long = "x" * 80
    p = spark.createDataFrame([("a", 1, long), ("a", 2, "short"), ("a", 3, None), ("a", 4, " ")], "doc_id string, page_number int, native_text string")
    o = spark.createDataFrame([("a", 4, "seen", 0.7, None)], "doc_id string, page_number int, text string, confidence double, diagnostic_code string")
    got = {r.page_number: (r.method, r.character_count, r.confidence) for r in pages.routed(p, o, budget=2).collect()}
    assert got == {1: ("native", 80, None), 2: ("skipped", 0, None), 3: ("skipped", 0, None), 4: ("ocr", 4, 0.7)}
