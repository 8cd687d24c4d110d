import math
import zlib

import corpus_pipeline
from helpers import ODD, documents
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_near
from test_packing import check_packed
from test_quality import plain_names
from test_secrets import brute_base

from bibspark.llm import quality


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = stage["quality"](spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    model = quality.fit(docs, labels)
    score = lambda text: sum(model.weights.get(s, 0) for s in {zlib.crc32(x.encode()) % 2**18 for x in plain_names(text or "")})
    want = {r.doc_id for r in docs.collect() if 1 / (1 + math.exp(model.thresholds[1] - score(r.text))) >= 0.5}
    assert {r.doc_id for r in good.collect()} == want and len(want) < docs.count()
    clean = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    assert len(clean & want) >= 0.95 * len(clean)

    lined = stage["line_dedup"](spark, good, sf_dir).cache()
    expected = {k: t for k, n, gone, t in brute_lines([(r.doc_id, r.text) for r in good.collect()]) if not (gone and gone == n)}
    assert {str(r.doc_id): r.text for r in lined.collect()} == expected

    single = stage["near_duplicates"](spark, lined, sf_dir).cache()
    near = brute_near([(r.doc_id, r.text) for r in lined.collect()])
    assert {r.doc_id for r in single.collect()} == {v[0] for v in near.values()}

    safe = stage["secrets"](spark, single, sf_dir).cache()
    assert safe.columns == docs.columns and safe.count() == single.count()
    assert not any(s[2] != "assign" for r in safe.collect() for s in brute_base(r.text))

    packed = stage["packing"](spark, safe, sf_dir).collect()
    check_packed(packed, 1024)
    assert {r.doc_id for r in packed} == {r.doc_id for r in safe.collect()}


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_odd_rows_pass_every_stage(spark, sf_dir):
    stage = dict(corpus_pipeline.STAGES)
    odd = documents(spark, ODD)
    lined = stage["line_dedup"](spark, odd, sf_dir).collect()
    assert sorted((str(r.doc_id), r.text) for r in lined) == sorted((k, t) for k, n, gone, t in brute_lines(ODD) if not (gone and gone == n))
    single = stage["near_duplicates"](spark, odd, sf_dir).collect()
    keep = {v[0] for v in brute_near(ODD).values()} | {None}
    assert sorted(str(r.doc_id) for r in single) == sorted(str(k) for k, _ in ODD if k in keep)
    assert sorted((str(r.doc_id), r.text) for r in stage["secrets"](spark, odd, sf_dir).collect()) == sorted((str(k), t) for k, t in ODD)
    packed = stage["packing"](spark, odd, sf_dir).collect()
    check_packed(packed, 1024)
    assert {r.doc_id for r in packed} == {k for k, _ in ODD}
    kept = stage["quality"](spark, odd, sf_dir).collect()
    assert {(r.doc_id, r.text) for r in kept} <= set(ODD)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, documents(spark, []), sf_dir)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
