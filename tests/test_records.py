from bibspark.operators import records
from bibspark.sources import bibtex, ris

BIB = r"""@PhdThesis{k1, title = {{Deep} roots}, author = {Souza, Ana and Lima, Bruno}, school = {Universidade X}, department = {Depto Y}, type = {Tese (Doutorado em Fitotecnia)}, pagetotal = {120 f.}, year = 2019, doi = {https://doi.org/10.1/AB.}}
@book{k2, title = "A book", author = {}, pagetotal = {88}, publisher = {P}, url = {https://x.org}}
@book{k3, title = {B}, pagetotal = {9 v.}}
@inproceedings{k4, title = {C}, author = {{Universidade}}}
"""
RIS = "TY  - THES\nID  - r1\nAU  - Souza\nTI  - T\nPB  - Press\nM3  - Master thesis\nPY  - 2001/7/1\nSP  - 5\nEP  - 5\nC2  - Course\nER  -\nTY  - ELEC\nTI  - E\nUR  - http://e\nER  -\n"


def ledger_of(rows):
    return {(r.source_record_id, r.field_id): (r.value, r.method, round(r.confidence, 6), r.raw_field_name) for r in sorted(rows, key=lambda r: -r.ord) if r.sequence in (None, 1)}  # the first of a field stands


def test_bibtex_records(spark):
    files = spark.createDataFrame([("d/a.bib", bytearray(BIB.encode())), ("d/bad.bib", bytearray(b"@a{"))], "path string, content binary")
    metadata = records.from_bibtex(bibtex.parse(files))
    got = ledger_of(records.records(metadata, "bibtex").collect())
    assert got["k1", "title"][0] == "Deep roots" and got["k1", "authors"][0] == "Ana Souza" and got["k1", "url"][0] == "https://doi.org/10.1/AB"
    assert got["k1", "academic_affiliation"] == ("Depto Y, Universidade X", "academic_affiliation_combined", 1.0, "department+institution")
    assert got["k1", "degree_course"] == ("Doutorado em Fitotecnia", "derived_from_work_type", 0.97, "degree")
    assert got["k1", "pagination"][0] == "120 f." and ("k1", "physical_description") not in got
    assert got["k2", "physical_description"][0] == "88 p." and ("k2", "authors") not in got
    assert got["k3", "physical_description"][0] == "9 v."
    assert got["k4", "authors"] == ("Universidade", "bibtex_structured_metadata", 0.99, None) and got["k4", "corporate_author"][0] == "Universidade"
    types = {(r.source_record_id, r.family, r.medium, r.confidence) for r in records.type_candidates(metadata, "bibtex").collect()}
    assert types == {("k1", "academic_work", "electronic", 0.92), ("k1", "academic_work", "electronic", 0.99), ("k2", "monograph", "electronic", 0.92), ("k2", "monograph", "electronic", 0.99), ("k3", "monograph", "print", 0.92), ("k3", "monograph", "print", 0.99), ("k4", "event_part", "print", 0.99)}


def test_ris_records(spark):
    metadata = records.from_ris(ris.parse(spark.createDataFrame([("d/a.ris", RIS)], "path string, text string")))
    rows = records.records(metadata, "ris").collect()
    got = ledger_of(rows)
    assert got["r1", "work_type"][0] == "Dissertação" and got["r1", "publication_month"][0] == "7" and got["r1", "publication_year"][0] == "2001"
    assert got["r1", "article_pages"][0] == "5" and got["r1", "academic_affiliation"][:2] == ("Press", "ris_structured_metadata") and got["r1", "degree_course"][0] == "Course"
    types = {(r.source_record_id, r.family, r.medium) for r in records.type_candidates(metadata, "ris").collect()}
    assert types == {("r1", "academic_work", "print"), ("record-2", "exclusive_electronic", "electronic")}
    assert records.records(metadata.limit(0), "ris").count() == 0
