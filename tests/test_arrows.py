"""Python steps hold one value, or a piece, at a time: the memory of a worker doesn't grow with the rows of an Arrow batch."""

import tracemalloc

import pyarrow as pa
import pytest
from bibspark.functions import fold
from bibspark.functions.arrows import mapped, texts
from bibspark.operators import link
from bibspark.sources import bibtex
from pyspark.sql import functions as F


def peak_of(work):
    tracemalloc.start()
    try:
        got = work()
        return got, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_texts():
    for values in ([], ["a"], [None], ["é", None, "", "𝒳"] * 5):
        got = texts(values)
        assert got.to_pylist() == values and got.type == pa.string()
        got.validate(full=True)


@pytest.mark.parametrize("key", ["title_key", "match_text"])
def test_folding_holds_no_batch_of_objects(key):
    own = ["Ação  e Reação, №5 ™ "[i % 3 :] * 100 for i in range(2000)]
    column = pa.array([*own, None])
    got, peak = peak_of(lambda: getattr(fold, key).func(column))
    assert got.to_pylist() == [*map(getattr(fold, f"{key}_of"), own), None]
    assert peak < 1.5 * got.nbytes


def test_capitals_of_compatibility_are_no_letters_of_a_title_key():
    assert fold.title_key_of("a™ Ⅳ b") == "a iv b" and fold.word_key_of("a™") == "atm"


def test_lists(spark):
    split = mapped(lambda v: v.split(","), pa.list_(pa.string()), size=lambda v: 1 << 17)
    rows = spark.createDataFrame([(i, None if i == 7 else f"{i},x") for i in range(20)], "i int, v string").coalesce(1)
    assert {r.i: r.p for r in rows.select("i", split(F.col("v")).alias("p")).collect()} == {i: None if i == 7 else [str(i), "x"] for i in range(20)}


def test_entries_leave_in_pieces():
    file = "\n".join(f"@book{{k{i}, title = {{T {i}}}, note = {{{'x' * 200}}}}}" for i in range(50)).encode()
    files = pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(400)] + ["bad", "none"], "content": [file] * 400 + [b"@a{", None]})
    held = []

    def run():
        for piece in bibtex.parsed(iter([files])):
            held.append((piece.num_rows, set(piece["path"].to_pylist()), piece["error"].null_count))

    _, peak = peak_of(run)
    assert sum(n for n, _, _ in held) == 400 * 50 + 1 and len(held) > 10 and sum(n - e for n, _, e in held) == 1
    assert sum(len(p) for _, p, _ in held) == 401 and peak < 4_000_000


def test_batches_of_files_hold_few_bytes_however_large_the_files(spark, monkeypatch):
    kind = type(spark.range(1))
    plain = kind.mapInArrow

    def watched(self, step, *more):
        def run(batches):
            def few(batch):
                assert batch.nbytes < 12_000_000, f"a batch of {batch.nbytes} bytes"
                return batch

            return step(map(few, batches))

        return plain(self, run, *more)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    n = F.col("id").cast("string")
    files = spark.range(40, numPartitions=1).select(n.alias("path"), F.encode(F.concat(F.lit("@book{k"), n, F.lit(", note = {"), F.repeat(F.lit("é"), F.lit(1 << 19) + F.col("id").cast("int")), F.lit("}}")), "UTF-8").alias("content"))
    got = bibtex.parse(files).select("path", "entry_key", F.length(F.col("fields")["note"]).alias("n"), "error").collect()
    assert sorted(map(tuple, got)) == sorted((str(i), f"k{i}", (1 << 19) + i, None) for i in range(40))


@pytest.mark.parametrize("size", [0, 1, 1023, 1024, 1025, 2048, 2049])
def test_files_are_whole_after_the_cut(spark, size):
    content = bytes(i % 251 for i in range(size))
    rows = bibtex.cut(spark.createDataFrame([("a", content), ("b", None), ("c", b"x")], "path string, content binary").coalesce(1))
    batches = (pa.RecordBatch.from_pylist([r.asDict()]) for r in rows.collect())
    assert list(bibtex.joined(batches)) == [("a", content)] * (size > 0) + [("c", b"x")]


def test_ratios_hold_no_batch_of_counts():
    own = [f"{i} " + "".join(chr(97 + (i * j * j + j) % 26) for j in range(220)) for i in range(1500)]
    left, right = pa.array([*own, None, own[0]]), pa.array([*own[1:], own[0], "a", own[0]])
    got, peak = peak_of(lambda: link.text_ratio.func(left, right))
    assert got.to_pylist()[-2:] == [None, 1.0] and len(got) == 1502 and peak < 15_000_000
    assert link.title_ratio.func(left[:3], right[:3]).to_pylist() == [link.title_ratio_of(a, b) for a, b in zip(own[:3], own[1:4], strict=True)]
