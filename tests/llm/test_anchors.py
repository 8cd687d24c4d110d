import hashlib
import random
import re

import numpy as np
import pytest
from bibspark.llm import anchors
from bibspark.llm.wordhash import Words
from helpers import ODD, documents


def brute(rows, window):
    """(n_words, n_removed, kept) of each row."""
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    order = [float("-inf") if k is None else k for k, _ in rows]
    low = {}
    for k, ws in zip(order, words):
        for a in range(len(ws) - window + 1):
            w = tuple(ws[a : a + window])
            low[w] = min(low.get(w, k), k)
    out = []
    for k, ws in zip(order, words):
        gone = set()
        for a in range(len(ws) - window + 1):
            if low[tuple(ws[a : a + window])] < k:
                gone.update(range(a, a + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def compare(spark, rows, window=50, **options):
    clash = options.pop("clash", False)
    got = anchors.dedup(documents(spark, rows, clash=clash), window=window, **options).collect()
    assert sorted((str(k), *b) for (k, _), b in zip(rows, brute(rows, window), strict=True)) == sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_word_hashes():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "é", "ccc\x85"]) for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", "\n", "\x0b"]) for _ in range(60)]
    words = Words([t.encode() for t in texts])
    at = 0
    seen = {}
    for i, t in enumerate(texts):
        own = t.encode().split()
        assert words.bounds[i + 1] - words.bounds[i] == len(own)
        for w in own:
            assert seen.setdefault(w, words.hash[at]) == words.hash[at]
            at += 1
    assert len(set(seen.values())) == len(seen)
    assert len(Words([b"", b" "])) == 0


def thue_morse(n, zero, one):
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


def test_regular_words_and_runs_differ():
    """Strings that make polynomial hashes modulo powers of two collide."""
    words = ["".join(thue_morse(n, *letters)) for n in (64, 512, 1024, 4096) for letters in ("ab", "ba")]
    for which in (0, 1):
        assert len(set(Words([" ".join(words).encode()]).hashes[which].tolist())) == len(words)
        runs = [Words([" ".join(thue_morse(1024, *pair)).encode()]).runs(1024, which)[0] for pair in (("a", "b"), ("b", "a"))]
        assert runs[0] != runs[1]
    ends = Words([b"x" * n + b" " + b"x" * (n - 1) + b"\x00" for n in range(1, 140)])
    assert len(set(ends.hash.tolist())) == len(ends)


def test_runs_are_those_of_their_words():
    rng = random.Random(2)
    words = [rng.choice(["a", "b", "c"]) for _ in range(400)]
    got = Words([" ".join(words).encode()])
    for size in (1, 2, 3, 5, 7, 8, 50):
        for which in (0, 1):
            seen = {}
            for i, h in enumerate(got.runs(size, which).tolist()):
                assert seen.setdefault(tuple(words[i : i + size]), h) == h
            assert len(set(seen.values())) == len(seen)


def test_no_word_goes_that_no_other_document_has(spark):
    a, b = ("".join(thue_morse(1024, *letters)) for letters in ("ab", "ba"))
    filler = [f"f{i}" for i in range(59)]
    compare(spark, [(1, " ".join([*filler[:30], a, *filler[30:]])), (2, " ".join([*filler[:30], b, *filler[30:]]))])


@pytest.mark.parametrize("seed", range(4))
def test_random_passages(spark, seed):
    """Copied passages at random places, within and over groups, with few different words so that chance repeats abound."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 40]))]
    rows = []
    for k in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rows and rng.random() < 0.7:
            source = rng.choice(rows)[1].split()
            a = rng.randint(0, max(0, len(source) - 5))
            words[rng.randint(0, len(words)) : 0] = source[a : a + rng.randint(1, 40)]
        rows.append((rng.randint(0, 60), " ".join(words)))
    compare(spark, rows, window=12, block=3, group_chars=rng.choice([200, 100_000]), bucket_chars=rng.choice([30, 6000]))


def test_odd_rows_and_defaults(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [*ODD, *[(100 + i, f"x{i} y{i} {passage} z{i}") for i in range(30)], (20, " ".join(f"p{i}" for i in range(20, 75)) + "\n tail"), (21, passage), (300, " ".join(rng.choice("ab") for _ in range(500)))]
    compare(spark, rows, clash=True)
    assert anchors.dedup(documents(spark, [])).count() == 0


def test_sizes_grow_with_the_square_root():
    assert anchors.sizes(1000) == (2_000_000, 3_000_000)
    assert anchors.sizes(4 * anchors.EVEN_CHARS) == (4_000_000, 6_000_000)
    assert anchors.sizes(10**14) == (16_000_000, 72_000_000)


def test_many_rows_of_one_id(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(rng.choice([None, 7]), " ".join([f"a{i}", *passage[rng.randint(0, 9) :], f"b{i}"])) for i in range(60)]
    compare(spark, [*rows, *rows[:20], *[(None, " ".join(passage))] * 25, (9, " ".join(passage))], group_chars=2000, bucket_chars=100)


def test_long_text(spark):
    """A text of some tens of MB beside one that holds a part of it."""
    words = [f"w{i * 7919 % 1000003}" for i in range(3_000_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[1_000_000:1_200_000], "y"]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in anchors.dedup(documents(spark, rows), with_text=False).collect()}
    assert got == {1: (3_000_000, 0), 2: (200_002, 200_000)}


def test_exactly_fifty_words(spark):
    a = [f"a{i}" for i in range(50)]
    rows = [(1, " ".join(["u", "v", *a, "w"])), (2, " ".join([*a, "x"])), (3, " ".join([*a[:49], "x"])), (4, "\t".join(["q"] * 7 + a))]
    for shift in range(9):
        compare(spark, [(k, " ".join(["s"] * shift) + " " + t) for k, t in rows])


def test_selection_keeps_an_anchor_for_every_window():
    rng = np.random.default_rng(0)
    for block in (3, 8):
        run = anchors.blocks_in(50, block)
        base = [str(x) for x in rng.integers(0, 1000, 50)]
        for shift in range(block * 2):
            a = [f"l{i}" for i in range(shift)] + base + ["r"] * 5
            b = ["k"] * 3 + base
            wa, wb = Words([" ".join(a).encode()]), Words([" ".join(b).encode()])
            pa_, ha, ia, _ = anchors.anchors(wa, 50, block)
            pb, hb, ib, _ = anchors.anchors(wb, 50, block)
            indexed = set(ha[ia].tolist())
            assert run >= 1 and any(h in indexed for h in hb.tolist())


def test_blocks_too_large(spark):
    with pytest.raises(ValueError):
        anchors.dedup(documents(spark, ODD), window=10, block=8)


def test_small_tables_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare(spark, rows)
