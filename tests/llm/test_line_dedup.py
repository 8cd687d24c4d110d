import random

import xxhash
from bibspark.llm import line_dedup
from helpers import ODD, documents


def place(k, t):
    """Order of documents: by key, null first; texts of one key by their hash."""
    h = xxhash.xxh64_intdigest((t or "").encode(), seed=42)
    return (float("-inf") if k is None else k, h - 2**64 if h >= 2**63 else h)


def brute(rows, size=3):
    docs = [(place(k, t), k, None if t is None else t.split("\n")) for k, t in rows]
    first = {}
    for k, _, lines in docs:
        for a in range(len(lines or ()) - size + 1):
            w = tuple(lines[a : a + size])
            first[w] = min(first.get(w, (k, a)), (k, a))
    out = []
    for k, key, lines in docs:
        if lines is None:
            out.append((str(key), 0, 0, None))
            continue
        gone = set()
        for a in range(len(lines) - size + 1):
            if first[tuple(lines[a : a + size])] < (k, a):
                gone.update(range(a, a + size))
        out.append((str(key), len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def compare(spark, rows, clash=False, **options):
    got = line_dedup.dedup_lines(documents(spark, rows, clash=clash), **options).collect()
    assert sorted(((str(r.doc_id), r.n_lines, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows, options.get("lines", 3))


def test_random_lines(spark):
    for seed in range(4):
        rng = random.Random(seed)
        lines = ["a", "b", "", "c c", "a\r"][: rng.randint(2, 5)]
        compare(spark, [(rng.randint(0, 30), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for _ in range(40)])


def test_odd_rows(spark):
    compare(spark, [*ODD, (40, "line two\nline three\nline four\nlast")], clash=True)
    compare(spark, ODD, lines=2)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_hot_keys(spark):
    """Many rows without a key or with one key: they are documents by their texts."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 7]), "\n".join(rng.choice(["a", "b", "c", f"u{i}"]) for _ in range(8))) for i in range(120)]
    compare(spark, [*rows, *rows[:40], *[(None, "a\nb\nc")] * 30])


def test_long_text(spark):
    """One text of some tens of MB, most of it in repeated lines, and one line of many MB."""
    long = "\n".join(f"line {i % 5000} of the long text, with some words that make it longer" for i in range(300_000))
    rows = [(1, long), (2, "x" * 12_000_000 + "\nb\nc"), (3, "x" * 12_000_000 + "\nb\nc\nd")]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "n_lines", "n_removed").collect()}
    assert got == {1: (300_000, 295_000), 2: (3, 0), 3: (4, 3)}


def test_overlap_counts_once_and_first_stays(spark):
    compare(spark, [(1, "x\ny\nz\nw"), (2, "q\nx\ny\nz\nw\nr"), (3, "a\na\na\na\na")])
    rows = line_dedup.dedup_lines(documents(spark, [(1, "x\ny\nz\nw"), (2, "q\nx\ny\nz\nw\nr")])).collect()
    assert {r.doc_id: r.kept_text for r in rows} == {1: "x\ny\nz\nw", 2: "q\nr"}


def test_small_tables(spark, sf_dir):
    compare(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
