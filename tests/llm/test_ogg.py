import hashlib
import random
import zlib

import pytest
from bibspark.llm import ogg
from helpers import ODD, documents
from hypothesis import given, settings
from hypothesis import strategies as st


def crc_by_bits(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def back(media):
    return b"".join(p.data for p in ogg.timed_packets(ogg.read(media))[2])


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_checksum(data):
    assert ogg.page_crc(data) == crc_by_bits(data)


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 4095, 4096, 4097, 8192, 65_025, 200_000, 1_000_003])
@pytest.mark.parametrize("streams", [1, 2, 3])
def test_round_trip(n, streams):
    data = random.Random(n).randbytes(n)
    media = ogg.write(data, streams=streams)
    assert back(media) == data
    assert ogg.write(data, streams=streams) == media


def test_packets_over_pages_and_times():
    data = bytes(range(256)) * 4000
    for packet in (255, 510, 70_000, 1000):
        media = ogg.write(data, packet=packet)
        assert back(media) == data
        _, total, packets = ogg.timed_packets(ogg.read(media))
        assert [p.start for p in packets] == list(range(0, len(data), packet))
        assert total == len(data)


def test_damage_is_found():
    media = ogg.write(b"abc" * 10_000)
    for at in range(0, len(media), 997):
        with pytest.raises(ogg.OggError):
            back(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
        with pytest.raises(ogg.OggError):
            back(media[: at or 1])


def test_query_rows(spark):
    got = ogg.digests(documents(spark, ODD, clash=True)).collect()
    assert len(got) == len(ODD)
    seen = {}
    for r in got:
        texts = [t for k, t in ODD if k == r.doc_id]
        data = (texts[0] or "").encode()
        padded = data + b"\0" * (-len(data) % 64)
        padded = padded or b"\0" * 64
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        media = ogg.write(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert seen.setdefault(data, r.feature) == r.feature
    assert ogg.digests(documents(spark, [])).count() == 0


def ordinary(identity, packets, serial=7):
    """A stream of another codec: header, then (data, granule) packets on pages."""
    return b"".join(page for _, page in ogg._paged(serial, [(identity, 0), *packets]))


def test_other_codecs_are_timed_by_granules(spark):
    vorbis = b"\x01vorbis" + (0).to_bytes(4, "little") + b"\x02" + (44_100).to_bytes(4, "little") + b"\0" * 14
    opus = b"OpusHead\x01\x02" + (312).to_bytes(2, "little") + b"\0" * 7
    media = [
        (1, ordinary(vorbis, [(b"setup", 0), (b"a" * 100, 22_050), (b"b" * 70_000, 44_100), (b"c" * 10, 88_200)])),
        (2, ordinary(opus, [(b"tags", 0), (b"d" * 50, 48_312)])),
        (3, ordinary(b"something", [(b"e", 16_000)])),
        (4, ordinary(vorbis, [(b"x" * 70_000, 10), (b"y" * 70_000, 5)])),
    ]
    rows = ogg.packets(spark.createDataFrame([(k, bytearray(m)) for k, m in media], "doc_id long, media binary"), rate=8000).collect()
    of = lambda k: [(r.packet, bytes(r.data)[:1], round(r.start_s, 6), round(r.end_s, 6)) for r in rows if r.doc_id == k and r.error is None]
    # The first three packets after the header share the first page that has a position where one ends: the page's is the last one's.
    assert [x[:2] for x in of(1)] == [(1, b"s"), (2, b"a"), (3, b"b"), (4, b"c")] and of(1)[-1][3] == 2.0 and of(1)[0][2] == 0.0
    assert all(a[3] == b[2] for a, b in zip(of(1), of(1)[1:]))
    assert of(2)[-1][3] == 1.0 and of(3) == [(1, b"e", 0.0, 2.0)]
    assert [r.error for r in rows if r.doc_id == 4] == ["granule positions go back"]


def test_features_worked_out_apart():
    data = random.Random(5).randbytes(20_000) + b"a" * 1000
    streams = ogg.read(ogg.write(data))
    rate, _, found = ogg.timed_packets(streams)
    got = dict(x.split("=") for x in ogg.features(rate, streams, found).split(";"))
    mean = sum(data) / len(data)
    spread = (sum((x - mean) ** 2 for x in data) / len(data)) ** 0.5
    turns = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
    starts = [p * 1000 // 8000 for p in range(0, len(data), 4096)]
    assert (float(got["mean"]), float(got["spread"])) == pytest.approx((mean, spread), abs=1e-4) and int(got["turns"]) == turns
    assert int(got["ms"]) == len(data) * 1000 // 8000 and int(got["packets"]) == len(starts) and int(got["streams"]) == 2
    assert got["times"] == hashlib.md5(",".join(map(str, starts)).encode()).hexdigest()[:8]


def test_packet_rows(spark):
    docs = documents(spark, ODD)
    rows = ogg.packets(ogg.stored(docs)).collect()
    for key, text in ODD:
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start_s)
        assert bytes().join(bytes(r.data) for r in {r.start_s: r for r in own}.values()) == ogg.payload_of(text or "")[1]
    broken = spark.createDataFrame([(1, bytearray(b"OggS")), (2, None), (3, bytearray(b""))], "doc_id long, media binary")
    assert {(r.doc_id, r.error is None) for r in ogg.packets(broken).collect()} == {(1, False), (2, False)}
