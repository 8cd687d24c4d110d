import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from bibspark.llm import packing
from helpers import ODD, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = P.path("byte_bpe_50k.json")


def check_packed(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end = a + n
        assert end <= capacity
    return at


def test_pieces_are_those_of_the_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(documents(spark, [(10_000 + n, t) for n, (_, t) in enumerate(ODD)]).select("doc_id", "text"))
    tok = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack_documents(docs, PATH).collect()
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    assert own.keys() == texts.keys()
    total = 0
    for key, text in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        total += len(ids)
        pieces = sorted(own[key], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 1024)))
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == 1024 for r in pieces[1:])
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    at = check_packed(rows, 1024)
    assert len(at) <= total / 1024 * 1.02 + 1


def test_all_code_points_have_the_same_ids():
    fast, _, whole = packing._tokenizer(PATH)
    points = [c for c in range(0x3100)] + list(range(0x10400, 0x10500)) + list(range(0x1F300, 0x1F400))
    for first in range(0, len(points), 50):
        text = "".join(f" a{chr(c)}b1{chr(c)}2 {chr(c)}! " for c in points[first : first + 50])
        assert fast(text) == whole(text)


def test_best_fit_against_plain_search():
    rng = random.Random(5)
    for _ in range(50):
        sizes = np.array([rng.randint(1, 60) for _ in range(rng.randint(1, 80))])
        bin_of, offset, fill = packing.best_fit(sizes, 64)
        plain, where = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            fits = [b for b, f in enumerate(plain) if f + sizes[i] <= 64]
            if fits:
                b = max(fits, key=lambda b: plain[b])
            else:
                b = len(plain)
                plain.append(0)
            plain[b] += sizes[i]
            where[i] = b
        assert sorted(fill) == sorted(plain)


def test_tree_of_nodes(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 1024) for _ in range(3000)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "item long, length int")
    rows = packing.pack(items, node_items=20, fan_in=3).collect()
    assert sorted(r.item for r in rows) == list(range(3000))
    check_packed(rows, 1024)
    whole = len(check_packed(packing.pack(items).collect(), 1024))
    assert whole <= sum(sizes) / 1024 * 1.02 + 1


def test_odd_items(spark):
    items = spark.createDataFrame([(1, None), (2, 0), (3, 1024), (3, 1024), (4, 5), (4, 5)], "doc_id long, length int").withColumn("sequence_id", F.lit("old"))
    rows = packing.pack(items).collect()
    assert len(rows) == 6
    assert sorted(r.doc_id for r in rows if r.sequence_id is None) == [1, 2]
    assert len({r.sequence_id for r in rows if r.sequence_id is not None}) == 3
    assert packing.pack(items.limit(0)).count() == 0
    with pytest.raises(Exception, match="longer than a sequence"):
        packing.pack(spark.createDataFrame([(1, 1025)], "doc_id long, length int")).collect()
