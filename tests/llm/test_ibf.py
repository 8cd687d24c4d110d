import hashlib
import random
import re

import pytest
from bibspark.llm import ibf
from helpers import ODD, documents
from pyspark.sql import functions as F


def paragraphs(text):
    return {p.strip(" \t\r\x0b\f") for p in re.findall(r"(?:[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*){1,16}", text)}


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = [(k, t or "") for k, t in rows]
    order = sorted({k for k, _ in rows if k is not None}, reverse=True)
    follows = dict(zip(order, order[1:] + order[:1]))
    text_of = {k: min(t for x, t in rows if x == k) for k in order}
    out = []
    for k, t in rows:
        n = len(t)
        nxt = text_of[follows[k]] if k is not None else ""
        edited = t[: n - n // 3] + nxt[: n // 3]
        out.append((str(k), n, hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(t, edited), 9), round(jaccard(t, nxt), 9)))
    return sorted(out)


def compare(spark, rows, clash=False):
    got = ibf.compare_versions(documents(spark, rows, clash=clash)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == brute(rows)
    seen = {}
    for r in got:
        t = next((t for k, t in rows if k == r.doc_id), None) or ""
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    return got


def test_odd_rows(spark):
    # Next documents with equal ids have equal texts here: of different ones any may stand.
    compare(spark, [r for r in ODD if r[0] != 10], clash=True)
    compare(spark, [(7, "a b\nc d\ne f\ng")])
    assert ibf.compare_versions(documents(spark, [])).count() == 0


def test_large_differences_are_tried_again(spark):
    rows = [(i, "\n".join(f"line {j * (i + 1)} of {i % 2}" for j in range(60 * i + 1))) for i in range(12)]
    compare(spark, rows)


def test_white_space_around_paragraphs(spark):
    lines = [f"a{i} b c" for i in range(30)]
    sets = spark.createDataFrame([("\n".join(lines), "\r\n".join(lines), "\n".join(" \t" + x + "\t \x0b\f" for x in lines))], "a string, b string, c string")
    got = sets.select(*[ibf.digests_of(F.col(c)).alias(c) for c in "abc"]).first()
    assert got.a == got.b == got.c and len(got.a) == 30


def test_small_sketches_in_a_row(spark):
    """What peels is exact; what doesn't is null; sketches subtract to that of the difference."""
    rng = random.Random(4)
    rows = []
    for i in range(200):
        common, left, right = ([rng.randrange(-(2**63), 2**63) for _ in range(rng.randint(0, n))] for n in (60, rng.choice([0, 3, 8, 30]), rng.choice([0, 3, 8, 30])))
        rows.append((i, [*common, *left], [*right, *common]))
    got = spark.createDataFrame(rows, "row long, a array<long>, b array<long>").select("row", F.expr(ibf.small_difference("a", "b")).alias("apart"), F.expr(f"exists({ibf.subtracted(ibf.sketch('a'), ibf.sketch('a'))}, x -> x.c <> 0 OR x.k <> 0)").alias("left")).collect()
    peeled = 0
    for r in got:
        a, b = (set(x) for x in rows[r.row][1:])
        assert r.left is False
        if r.apart is not None:
            assert r.apart == len(a ^ b)
            peeled += 1
        else:
            assert len(a ^ b) > 4
    assert 60 < peeled < 200


def test_small_tables(spark, sf_dir):
    got = compare(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got)


def test_peeling_recovers_the_difference(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3], [2, 3, 4, 5], []), (2, [7], [], [7]), (3, list(range(500)), list(range(250, 900)), list(range(499))), (4, [], [], [])], "row long, a array<long>, b array<long>, c array<long>")
    got = {r.row: (r.x, r.y) for r in ibf.likeness(sets, {"x": ("a", "b"), "y": ("a", "c")}).collect()}
    assert got == {1: pytest.approx((2 / 5, 0)), 2: pytest.approx((0, 1)), 3: pytest.approx((250 / 900, 499 / 500)), 4: pytest.approx((1, 1))}


def test_order_of_documents(spark):
    ids = [5, 1, 9, 9, None, -3, *range(100, 2000, 7)]
    got = {r.id: r.next_id for r in ibf.following(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    order = sorted({i for i in ids if i is not None}, reverse=True)
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_no_python_on_the_executors(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = ibf.compare_versions(docs.filter(F.col("doc_id") < 20))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
