import base64
import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken
from bibspark.llm import bytebpe
from helpers import ODD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = bytebpe.ByteBpe(RANKS)


def test_pieces_equal_the_pattern():
    rng = random.Random(3)
    signs = ["'", "'s", "'re", "'ll", "'ve", "r", "e", "l", "v", " ", "  ", "\n", "\t", "a", "1", "é", "!", "　", "''", "s", "t", "R", "'S", ".", "東"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert bytebpe.pieces(text) == regex.findall(P.PATTERN, text)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_round_trip(text):
    ids = BPE.encode_batch([text])[0]
    assert list(memoryview(ids).cast("I")) == ENCODING.encode_ordinary(text)
    back, offsets = BPE.decode(ids)
    assert back == text.encode()
    assert len(offsets) == len(ids) // 4


def test_long_pieces_merge_alike():
    rng = random.Random(1)
    for n in (199, 200, 201, 3000):
        piece = bytes(rng.choice(b"abcdest") for _ in range(n))
        assert BPE.merge(piece) == BPE._merge_long(piece) == ENCODING.encode_ordinary(piece.decode())


def test_cache_bound():
    bpe = bytebpe.ByteBpe(RANKS)
    bpe.CACHE = 50
    texts = [f"alpha{i} beta{i % 7}" for i in range(500)]
    assert bpe.encode_batch(texts) == BPE.encode_batch(texts)
    assert len(bpe.young) <= 51 and len(bpe.old) <= 51


def test_query_rows(spark):
    got = {(r.doc_id, r.decoded_sha256): r for r in bytebpe.digests(documents(spark, ODD, clash=True), PATH).collect()}
    for key, text in ODD:
        ids = ENCODING.encode_ordinary(text or "")
        r = got[key, hashlib.sha256((text or "").encode()).hexdigest()]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert bytebpe.digests(documents(spark, []), PATH).count() == 0


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bytebpe.encode_decode(docs, PATH).collect():
        assert list(memoryview(bytes(r.ids)).cast("I")) == ENCODING.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]
