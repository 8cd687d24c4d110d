import random
from collections import defaultdict

import numpy as np
import pytest
from bibspark.llm import ngram_join
from bibspark.llm.common import components
from helpers import ODD, documents


def ngrams(text, size=5):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(rows, threshold=0.8):
    texts = {}
    for k, t in rows:
        if k is not None:
            texts[k] = min(texts.get(k, t or ""), t or "")
    sets = {k: ngrams(t) for k, t in texts.items()}
    near = defaultdict(set)
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                near[a].add(b)
                near[b].add(a)
    label = {}
    for k in keys:
        if k not in label:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = k
                    todo += near[x]
    return {k: (label[k], len(near[k]), min([k, *[x for x in keys if sets[x] == sets[k] and sets[k]]])) for k in keys}


def compare(spark, rows, clash=False, **options):
    got = ngram_join.near_duplicates(documents(spark, rows, clash=clash), **options).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in rows)
    want = brute(rows)
    for r in got:
        assert (r.class_id, r.n_links, r.copy_of) == (want[r.doc_id] if r.doc_id is not None else (None, 0, None)), r
    return want


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def group(rng, n, words=120, edits=3):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    return [edited(rng, base, rng.randint(0, edits)) for _ in range(n)]


def test_banding():
    plan = ngram_join.banding()
    assert plan.recall(0.8) >= 0.9999 and plan.rows * plan.bands <= 192
    with pytest.raises(ValueError):
        ngram_join.banding(0.1, 0.9999999, 8)


@pytest.mark.parametrize("block_shingles", [400_000, 700])
def test_groups(spark, block_shingles):
    rng = random.Random(3)
    texts = [t for _ in range(12) for t in group(rng, rng.randint(1, 9))] + group(rng, 60, edits=2) + ["the same text of some words here"] * 20 + [edited(rng, [f"z{i}" for i in range(90)], 0)] * 2
    rng.shuffle(texts)
    want = compare(spark, list(enumerate(texts)), block_shingles=block_shingles)
    assert sum(n for _, n, _ in want.values()) > 500


def test_odd_rows(spark):
    compare(spark, [*ODD, (60, "a b c d"), (61, "A  b\tc d"), (11, "y")], clash=True)
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0


def test_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = compare(spark, rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v[0] for v in want.values()})


def test_recall_at_the_threshold():
    plan = ngram_join.banding()
    rng = np.random.default_rng(1)
    met = n = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 200).astype(np.uint64)
        a = np.concatenate([common, rng.integers(0, 2**63, 24).astype(np.uint64)])
        b = np.concatenate([common, rng.integers(0, 2**63, 24).astype(np.uint64)])
        x, y = ngram_join.band_hashes(np.unique(a), plan), ngram_join.band_hashes(np.unique(b), plan)
        met += bool((x == y).any())
        n += 1
    assert met >= n - 1
    same = [ngram_join.signature(np.unique(np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)])), 192) for _ in range(2)]
    assert abs((same[0] == same[1]).mean() - 0.5) < 0.12


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1080)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(260)] + [(5, 5), (None, 3)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
