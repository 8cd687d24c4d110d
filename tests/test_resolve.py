import pytest
from bibspark.operators import ledger, link, resolve
from bibspark.operators.rounds import components
from bibspark.plans.catalog import Catalog, repeatable
from bibspark.plans.compile import compile_references, numbered, ordered, year_letters
from pyspark.sql import functions as F

FIELDS = ["authors", "corporate_author", "title", "subtitle", "periodical_title", "place", "volume", "publication_year", "doi", "url", "access_date", "notes"]
ARTICLE = {
    "required_fields": ["authors", "title", "periodical_title", "publication_year"], "conditional_fields": ["subtitle", "place", "volume", "doi", "url", "access_date", "notes"],
    "ordered_fields": ["authors", "title", "subtitle", "periodical_title", "place", "volume", "publication_year", "doi", "url", "access_date", "notes"],
}
CATALOG = {
    "fields": [{"id": f, "repeatable": f in ("authors", "notes")} for f in FIELDS],
    "schemas": [
        {"id": "my.1", "section": "1", "family": "periodical_article", "medium": "electronic", **ARTICLE, "conditions": [{"any_of": ["authors", "corporate_author"]}, {"when_field_present": "url", "then_required": ["access_date"]}]},
        {"id": "my.2", "section": "2", "family": "audiovisual", "medium": "electronic", "required_fields": ["title"], "conditional_fields": ["place", "url"], "ordered_fields": ["title", "place", "url"], "conditions": [{"any_of": ["authors", "corporate_author"]}]},
    ],
}
LEDGER = "record_id string, field_id string, value string, normalized_value string, source_format string, source_file string, source_record_id string, method string, confidence double, page_number int, raw_field_name string, sequence int, ord long"


def candidates(spark, *rows):
    """(record, field, value, format, file, method, confidence, sequence)."""
    return spark.createDataFrame([(r, f, v, v.lower(), fmt, file, None, m, c, None, None, q, i) for i, (r, f, v, fmt, file, m, c, q) in enumerate(rows)], LEDGER)


def resolved(spark, *rows):
    dims = spark.createDataFrame([("authors", True)], "field_id string, repeatable boolean")
    return {(r.record_id, r.field_id): r for r in resolve.resolve_fields(candidates(spark, *rows), dims).collect()}


def test_scores(spark):
    df = spark.createDataFrame([(0.5, "pdf", "x"), (0.5, "bibtex", "bibtex_raw_field"), (0.05, "pdf", "pdf_metadata_title"), (0.99, "ris", "api_review"), (0.5, "odd", None)], "c double, s string, m string")
    got = [r[0] for r in df.select(resolve.candidate_score(F.col("c"), F.col("s"), F.col("m"))).collect()]
    assert got[:4] == pytest.approx([0.5, 0.66, 0.0, 1.0])


def test_conflict_and_support(spark):
    got = resolved(
        spark,
        ("a", "title", "One", "pdf", "f1", "m", 0.9, None), ("a", "title", "Ones", "ris", "f2", "m", 0.9, None), ("a", "title", "one", "pdf", "f3", "m", 0.7, None),
        ("b", "title", "X", "pdf", "f1", "m", 0.95, None), ("b", "title", "Y", "pdf", "f1", "m", 0.8, None),
        ("c", "title", "X", "bibtex", "f1", "bibtex_raw_field", 0.99, None), ("c", "title", "Mine", "catalog", "me", "api_review", 0.1, None),
        ("d", "title", "X", "pdf", "f1", "m", 1.0, None), ("d", "title", "Y", "pdf", "f1", "m", 0.88, None),
    )
    a, b, c, d = (got[k, "title"] for k in "abcd")
    assert (a.status, a["values"], a.runner_up, a.n_alternatives) == ("conflict", ["Ones"], ["One"], 2) and a.confidence == pytest.approx(0.96)
    assert (b.status, b["values"]) == ("selected", ["X"])
    assert (c.status, c["values"], c.human) == ("selected", ["Mine"], True)
    assert d.status == "conflict"  # a gap of exactly 0.12 still counts


def test_equal_lists_support_each_other(spark):
    got = resolved(
        spark,
        ("a", "authors", "B", "pdf", "f1", "m", 0.8, 2), ("a", "authors", "A", "pdf", "f1", "m", 0.8, 1), ("a", "authors", "A", "ris", "f2", "m", 0.7, 1), ("a", "authors", "B", "ris", "f2", "m", 0.7, 2), ("a", "authors", "Z", "bibtex", "f3", "m", 0.76, None),
    )["a", "authors"]
    assert got["values"] == ["A", "B"] and got.confidence == pytest.approx(0.83) and got.n_alternatives == 2


def test_schema_choice(spark):
    types = spark.createDataFrame([("a", "my.1", "pdf", 0.92, "r1", 1), ("a", "my.2", "ris", 0.99, "r2", 2), ("a", "my.1", "pdf", 0.92, "r3", 3), ("a", "my.1", "pdf", 0.92, "r1", 4), ("b", None, "pdf", 0.9, "x", 1), ("c", "my.1", "pdf", 0.5, "x", 1)], "record_id string, schema_id string, source_format string, confidence double, reason string, ord int")
    over = spark.createDataFrame([("c", "my.2")], "record_id string, schema_override string")
    got = {r.record_id: r for r in resolve.resolve_schema(types, over).collect()}
    assert got["a"].schema_id == "my.2" and got["a"].schema_reason.startswith("r2; close alternative schema=my.1 score=0.97")
    assert "b" not in got and (got["c"].schema_id, got["c"].schema_confidence) == ("my.2", 1.0)


def types_of(spark, *rows):
    return spark.createDataFrame([(r, s, "bibtex", 0.99, "entry type", 1) for r, s in rows], "record_id string, schema_id string, source_format string, confidence double, reason string, ord int")


BASE = [("authors", "Souza, Ana"), ("title", "A study"), ("periodical_title", "Letters"), ("publication_year", "2020"), ("doi", "10.1/x"), ("url", "https://doi.org/10.1/OTHER")]


def rows_of(record, pairs=BASE):
    return [(record, f, v, "bibtex", "f", "bibtex_raw_field", 0.99, 1 if f == "authors" else None) for f, v in pairs]


def test_defaults_coherence_and_missing(spark):
    rows = candidates(spark, *rows_of("a"), *rows_of("b", BASE[1:4]), *rows_of("v", [("title", "Film")]))
    fields, records = resolve.resolve(rows, types_of(spark, ("a", "my.1"), ("b", "my.1"), ("v", "my.2")), Catalog.load(CATALOG), access_date="2025-03-05")
    f = {(r.record_id, r.field_id): r["values"] for r in fields.collect()}
    assert f["a", "place"] == ["[S. l.]"] and f["a", "access_date"] == ["2025-03-05"] and f["a", "url"] == ["https://doi.org/10.1/x"]
    r = {x.record_id: x for x in records.collect()}
    assert r["a"].ready and r["a"].missing == []
    assert r["b"].missing == ["authors", "any_of:authors|corporate_author"] and not r["b"].ready
    assert r["v"].missing == ["any_of:authors|corporate_author"]  # a condition on fields that the schema lacks can't be met
    _, loose = resolve.resolve(rows, types_of(spark, ("v", "my.2")), Catalog.load(CATALOG), access_date="2025-03-05", strict=False)
    assert {x.record_id: x.ready for x in loose.collect()}["v"]


def test_matching_url_is_preferred(spark):
    rows = candidates(spark, *rows_of("a", BASE[:5]), ("a", "url", "https://example.org/1", "bibtex", "f", "bibtex_raw_field", 0.99, None), ("a", "url", "http://dx.doi.org/10.1/X", "pdf", "g", "m", 0.5, None))
    fields, _ = resolve.resolve(rows, types_of(spark, ("a", "my.1")), Catalog.load(CATALOG), access_date="2025-03-05")
    assert {r.field_id: r["values"] for r in fields.collect()}["url"] == ["http://dx.doi.org/10.1/X"]


def test_exclusion_and_reviews(spark):
    rows = candidates(spark, *rows_of("a"))
    reviews = spark.createDataFrame([("a", "title", ["Better"], "me", "api_review"), ("a", "doi", [], "me", "api_review")], "record_id string, field_id string, values array<string>, source_file string, method string")
    new = ledger.with_reviewed(rows.select(*ledger.COLUMNS), reviews)
    again = ledger.with_reviewed(new, reviews)
    assert new.count() == rows.count() + 1 == again.count()
    fields, records = resolve.resolve(new, types_of(spark, ("a", "my.1")), Catalog.load(CATALOG), access_date="2025-03-05", excluded=ledger.excluded_fields(reviews))
    f = {r.field_id: r["values"] for r in fields.collect()}
    assert f["title"] == ["Better"] and "doi" not in f


def test_ledger_keeps_the_first(spark):
    rows = candidates(spark, ("a", "title", "X", "pdf", "f", "second", 0.1, None), ("a", "title", "x", "pdf", "f", "third", 0.9, None), ("a", "title", "X", "ris", "f", "m", 0.9, None))
    assert {(r.source_format, r.method) for r in ledger.deduplicated(rows).collect()} == {("pdf", "second"), ("ris", "m")}
    both = ledger.merged(rows, rows)
    assert ledger.deduplicated(both).count() == 2


def test_compiled_list(spark):
    rows = candidates(spark, *rows_of("a"), *rows_of("b", [("title", "Another"), *[p for p in BASE if p[0] != "title"]]), *rows_of("c", [("authors", "Álvares, Zé"), ("title", "Z"), ("periodical_title", "P"), ("publication_year", "2020")]), *rows_of("d", [("title", "lone")]))
    out = compile_references(rows, types_of(spark, *[(k, "my.1") for k in "abcd"]), Catalog.load(CATALOG), access_date="2025-03-05")
    got = [(r.record_id, r.year_suffix, r.reference) for r in ordered(out).collect()]
    assert [g[0] for g in got] == ["c", "d", "a", "b"]
    by = {g[0]: g for g in got}
    assert by["b"][1:] == ("b", "SOUZA, Ana. Another. Letters, [s. l.], 2020b. DOI: https://doi.org/10.1/x.")
    assert by["a"][1] == "a" and by["c"][1] == "" and by["d"][2] is None


def test_year_letters_and_numbers(spark):
    rows = spark.createDataFrame([(i, i % 2, i != 4) for i in range(8)], "i long, g long, ready boolean")
    got = {r.i: r.year_suffix for r in year_letters(rows, group=["g"], order=["i"]).collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "b", 4: "", 5: "c", 6: "c", 7: "d"}
    nums = numbered(spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1009).alias("o")), group=["g"], order=["o"])
    for g in range(3):
        own = sorted((r.o, r.position) for r in nums.filter(F.col("g") == g).collect())
        assert [p for _, p in own] == list(range(1, len(own) + 1))


def test_catalog_checks():
    good = Catalog.load(CATALOG)
    assert good.report()["electronic"] == 2 and good.schema_id("audiovisual", "electronic") == "my.2"
    for change in ({"fields": CATALOG["fields"] * 2}, {"schemas": CATALOG["schemas"] * 2}, {"output_policy": {"network_access": True}}, {"fields": CATALOG["fields"][:3]}, {"schemas": [CATALOG["schemas"][0] | {"ordered_fields": ["title"]}]}, {"schemas": [CATALOG["schemas"][0] | {"conditions": [{}]}]}, {"schemas": [CATALOG["schemas"][0] | {"id": "Nope"}]}):
        with pytest.raises(ValueError):
            Catalog.load(CATALOG | change)


def test_catalog_from_a_file(tmp_path, spark):
    import json

    p = tmp_path / "c.json"
    p.write_text(json.dumps(CATALOG))
    c = Catalog.load(str(p))
    assert repeatable(c.dim_field(spark)).count() == 2 and c.dim_schema_field(spark).count() == 14 and c.dim_condition(spark).count() == 3


DOCS = "doc_id long, sha256 string, canonical_key string, doi_key string, title_key string, year_key string, family_key string, stem_key string, variant_type string"


def test_variants(spark):
    long = "a study of many things in one place over the years and beyond"
    rows = [
        (1, "h1", "k1", "", long, "2020", "souza", "s1", "publisher_original"), (2, "h2", "k2", "", long + "x", "2020", "souza", "s2", "browser_print"), (3, "h3", "k3", "", long + "y", "2020", "souza", "s3", "publisher_original"),
        (4, "h4", "unknown", "10.1/a", "t4", "", "", "", "unknown"), (5, "h5", "unknown", "10.1/a", "t5", "", "", "", "unknown"), (6, "h6", "unknown", "", "same", "2019", "", "p", "unknown"), (7, "h7", "", "", "same", "2019", "", "q", "unknown"),
        (8, "h8", "k8", "", "u", "2018", "", "stem", "scanned"), (9, "h9", "k9", "", "v", "2018", "", "stem", "unknown"), (10, "h10", "k10", "", "w", "2018", "", "stem", "unknown"), (11, "h11", "k11", "", "x", "2017", "", "stem", "unknown"), (12, "h1", "z", "", "", "", "", "", "unknown"),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    labels = {r.vertex: r.component for r in components(link.variant_pairs(docs)).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 12: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 8}


def test_winner(spark):
    docs = spark.createDataFrame([(1, "h1", "k", "review_required", "publisher_original", 5, 9, 1), (2, "h2", "k", "processed", "browser_print", 3, 0, 2), (3, "h3", "k", "processed", "ris", 3, 0, 3), (4, "h3", "k", "processed", "scanned", 3, 0, 4), (5, "h5", "z", "failed", "unknown", 0, 0, 5)], "doc_id long, sha256 string, canonical_key string, status string, variant_type string, n_filled int, native_pages int, ord int")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "vertex long, component long")
    got = {r.doc_id: (r.winner_id, r.include) for r in link.winners(docs, labels).collect()}
    assert got == {1: (3, False), 2: (3, False), 3: (3, True), 4: (3, True), 5: (5, True)}


def test_greedy_assignment(spark):
    pairs = spark.createDataFrame([(1, 10, 1, "title", 0.95), (1, 11, 2, "title", 0.99), (2, 11, 2, "doi", 1.0), (2, 10, 1, "title", 0.93), (3, 11, 2, "title", 0.96), (4, 12, 3, "title", 0.92), (4, 13, 4, "title", 0.92)], "doc_id long, entry_id long, ord long, method string, score double")
    order = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "doc_id long, doc_ord long")
    assert {(r.doc_id, r.entry_id) for r in link.assign(pairs, order).collect()} == {(1, 11), (2, 10), (4, 12)}
    assert link.assign(pairs.limit(0), order).count() == 0
