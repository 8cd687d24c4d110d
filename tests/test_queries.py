"""Every query against its SQL, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__
from bibspark.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: ("f", round(v, 6)) if isinstance(v, float) and not math.isnan(v) else v
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_fuzzy_link_finds_each_item(spark, sf_dir):
    got = QUERIES["fuzzy_link"](spark, sf_dir).collect()
    assert got and sum(r.doc_id == r.entry_id for r in got) >= 0.9 * len(got)


def test_fuzzy_link_reads_documents_and_whole_texts(spark, sf_dir, tmp_path):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half = " ".join(items[0].split()[:12])
    new = [(-1, items[0]), (-2, max(items, key=len).replace("e", "", 3)), (-3, f"{half} and then something else that no item of the benchmark has")]
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in new], docs.schema)
    docs.unionByName(made).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.source, r.doc_id): r for r in QUERIES["fuzzy_link"](spark, str(tmp_path)).collect()}
    assert got["documents", -1].entry_id == 0 and got["documents", -1].score == 1.0
    assert items[got["documents", -2].entry_id] == max(items, key=len) and ("documents", -3) not in got
    assert {i for s, i in got if s == "benchmark"} == set(range(len(items)))


def test_doi_link_has_every_document(spark, sf_dir, db):
    got = {r.doc_id: r for r in QUERIES["doi_link"](spark, sf_dir).collect()}
    assert sorted(got) == [r[0] for r in db.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    items = {r[0] for r in db.execute("SELECT item_id FROM benchmark").fetchall()}
    assert all((r.item_id, r.method) == ((k % 70, "doi") if k % 70 in items else (None, "none")) for k, r in got.items())
    assert all(tuple(got[r[0]]) == r for r in db.execute(ORACLES["doi_link"]).fetchall())


def test_signals_and_variants_read_the_text(spark, tmp_path):
    long = "word " * 5000
    texts = [
        (1, "plain words", set(), "publisher_original"),
        (11, long + "\nKeywords: a\nResearch article\nreceived 1 May, accepted 2 May\nISSN 1\nworkshop\nISBN 1\nReferências\nAbstract\n10.1234/x", None, "publisher_original"),
        (13, "Brasil - notas\n" + long, set(), "browser_print"),
        (17, "Dissertação apresentada ao programa", set(), "publisher_original"),
        (19, None, set(), "publisher_original"),
    ]
    spark.createDataFrame([(i, t) for i, t, _, _ in texts], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["line_signals"](spark, str(tmp_path)).collect()}
    kinds = {r.doc_id: r.variant for r in QUERIES["variant_kinds"](spark, str(tmp_path)).collect()}
    names = [c for c in got[1].asDict() if c.startswith("has_")]
    assert len(names) == 9 and all(got[11][n] for n in names)
    for i, _, signs, kind in texts:
        assert kinds[i] == kind and (signs is None or {n for n in names if got[i][n]} == signs)
    assert got[17].document_type == "dissertation" and got[1].document_type == "unknown"


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderkey", "reference"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
