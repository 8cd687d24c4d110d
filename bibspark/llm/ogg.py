"""Operator 4: Ogg media columns (RFC 3533).

A payload is stored as 8-bit samples in two multiplexed logical streams that take turns packet by packet.
A page's granule position is the number of samples, on the clock that both streams share, at the end of the last
packet that ends on the page, or -1 where none ends.  Reading verifies each page's checksum and sequence number, puts
packets together from the lacing values (over pages too), separates the streams by serial number, and takes
each packet's time from the granule positions; the payload is the packets of all streams in order of time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import text_batches, text_or_empty

HEADER = struct.Struct("<4sBBqIIIB")
IDENTITY = struct.Struct("<8sBBIQ")  # magic, version, number of streams, sample rate, samples in all
MAGIC = b"\x80PCM8raw"
PACKET = 4096
RATE = 8000
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes aren't a whole Ogg bitstream."""


def page_crc(data: bytes) -> int:
    """Ogg's CRC-32 (generator 04c11db7, most significant bit first, start and final value 0).

    zlib has the same generator with bits reversed and both values inverted, so it is fed reversed bits.
    """
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def _paged(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of a stream, each with the granule at which it is due in the multiplex; the first packet is the identity."""
    identity, _ = packets[0]
    pages = [(-1, _page(FIRST | (LAST if len(packets) == 1 else 0), 0, serial, 0, _lacing(len(identity)), identity))]
    segments = bytearray()
    ends: list[tuple[int, int]] = []  # (segments so far, granule) after each packet
    for data, granule in packets[1:]:
        segments += _lacing(len(data))
        ends.append((len(segments), granule))
    body, at, k, last = b"".join(d for d, _ in packets[1:]), 0, 0, 0
    for first in range(0, len(segments), 255):
        lacing = bytes(segments[first : first + 255])
        granule, done = -1, k
        while done < len(ends) and ends[done][0] <= first + len(lacing):
            granule = ends[done][1]
            done += 1
        size = sum(lacing)
        flags = (CONTINUED if first and segments[first - 1] == 255 else 0) | (LAST if first + len(lacing) == len(segments) else 0)
        last = granule if granule >= 0 else last
        pages.append((last, _page(flags, granule, serial, len(pages), lacing, body[at : at + size])))
        at, k = at + size, done
    return pages


def write(payload: bytes, *, streams: int = 2, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg bitstream of the payload; equal payloads give equal bytes."""
    identity = IDENTITY.pack(MAGIC, 1, streams, rate, len(payload))
    own = [[(identity, 0)] for _ in range(streams)]
    for k, at in enumerate(range(0, len(payload), packet)):
        own[k % streams].append((payload[at : at + packet], min(at + packet, len(payload))))
    base = zlib.crc32(payload)
    pages = [(due, s, i, page) for s in range(streams) for i, (due, page) in enumerate(_paged((base + s) & 0xFFFFFFFF, own[s]))]
    return b"".join(page for *_, page in sorted(pages, key=lambda p: p[:3]))


@dataclass
class Stream:
    serial: int
    packets: list[tuple[bytes, int | None]] = field(default_factory=list)  # with the end on the sample clock, where known
    part: list[bytes] | None = None
    pages: int = 0
    ended: bool = False


def read(media: bytes) -> list[Stream]:
    """The logical streams in order of appearance; raises OggError where a checksum, a number or a packet doesn't hold."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("a page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page starts here")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError("a page is cut off")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError("a page's checksum is wrong")
        if flags & FIRST:
            if serial in streams:
                raise OggError("a stream begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages:
            raise OggError("a page is missing")
        if bool(flags & CONTINUED) != (s.part is not None):
            raise OggError("a packet isn't continued")
        s.pages += 1
        body, first = at + 27 + n, len(s.packets)
        run = 0
        for v in lacing:
            run += v
            if v < 255:
                piece = media[body : body + run]
                s.packets.append((b"".join([*s.part, piece]) if s.part else piece, None))
                s.part, body, run = None, body + run, 0
        if lacing and lacing[-1] == 255:
            s.part = [*(s.part or []), media[body : body + run]]
        if len(s.packets) > first:
            if granule < 0:
                raise OggError("a page ends a packet but has no granule position")
            s.packets[-1] = (s.packets[-1][0], granule)
        s.ended = bool(flags & LAST)
        at = end
    if any(not s.ended or s.part is not None for s in streams.values()):
        raise OggError("a stream doesn't end")
    return list(streams.values())


@dataclass
class Timed:
    serial: int
    number: int
    start: int
    end: int
    data: bytes


def timed_packets(streams: list[Stream]) -> tuple[int, int, list[Timed]]:
    """(sample rate, samples in all, data packets of all streams in order of time).

    Where several packets end on one page only the last has the page's granule position; those before it are
    timed backwards from it: the streams take turns, so a stream's packets lie one round of packets apart.
    """
    rate = total = count = 0
    out = []
    for s in streams:
        if not s.packets or len(s.packets[0][0]) != IDENTITY.size or not s.packets[0][0].startswith(MAGIC):
            raise OggError("a stream has no identity header")
        _, _, count, rate, total = IDENTITY.unpack(s.packets[0][0])
        end = None
        later: Timed | None = None
        for k in range(len(s.packets) - 1, 0, -1):
            data, granule = s.packets[k]
            if granule is not None:
                end = granule
            elif later is not None:
                end = later.start - (count - 1) * len(data)
            if end is None:
                raise OggError("a packet has no time")
            later = Timed(s.serial, k, end - len(data), end, data)
            out.append(later)
    if len(streams) != count:
        raise OggError("a stream is missing")
    out.sort(key=lambda p: p.start)
    if [p.start for p in out] != [0, *[p.end for p in out]][: len(out)] or (out[-1].end if out else 0) != total:
        raise OggError("the packets don't cover the time")
    return rate, total, out


def clock_of(identity: bytes) -> tuple[int, int] | None:
    """(granules a second, granules before the start) that a stream's first packet states: the own format, Vorbis or Opus; else null."""
    if len(identity) == IDENTITY.size and identity.startswith(MAGIC):
        return IDENTITY.unpack(identity)[3], 0
    if identity.startswith(b"\x01vorbis") and len(identity) >= 16:
        return int.from_bytes(identity[12:16], "little"), 0
    if identity.startswith(b"OpusHead") and len(identity) >= 12:
        return 48_000, int.from_bytes(identity[10:12], "little")
    return None


def by_granules(stream: Stream, rate: int, before: int = 0) -> list[tuple[int, float, float, bytes]]:
    """(packet, start, end, data) of every packet after the first, in seconds, from granule positions alone.

    The last packet that ends on a page ends at the page's position; packets before it on the page share the time since the
    position before evenly.  Header packets end at 0.  Raises OggError where positions go back.
    """
    out, last, waiting = [], 0, []
    for k, (data, granule) in enumerate(stream.packets[1:], 1):
        waiting.append((k, data))
        if granule is None:
            continue
        if granule < last:
            raise OggError("granule positions go back")
        ends = [last + (granule - last) * (i + 1) / len(waiting) for i in range(len(waiting))]
        for (n, d), a, b in zip(waiting, [last, *ends], ends, strict=False):
            out.append((n, max(0.0, (a - before) / rate), max(0.0, (b - before) / rate), d))
        last, waiting = granule, []
    return out


def features(rate: int, streams: list[Stream], packets: list[Timed]) -> str:
    """Counts and times of the container, then mean, spread and sign changes of the samples about the middle value."""
    wave = np.frombuffer(b"".join(p.data for p in packets), np.uint8)
    n = max(1, len(wave))
    s1, s2 = int(wave.sum(dtype=np.int64)), int(np.square(wave.astype(np.int64)).sum())
    high = wave >= 128
    turns = int((high[1:] != high[:-1]).sum())
    ms = len(wave) * 1000 // rate if rate else 0
    starts = hashlib.md5(",".join(str(p.start * 1000 // rate) for p in packets).encode()).hexdigest()[:8]
    return f"streams={len(streams)};pages={sum(s.pages for s in streams)};packets={len(packets)};ms={ms};times={starts};mean={s1 / n:.4f};spread={(max(0.0, s2 / n - (s1 / n) ** 2)) ** 0.5:.4f};turns={turns}"


def payload_of(text: str) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and these with bytes 0 up to a positive multiple of 64."""
    data = text.encode()
    return len(data), data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def stored(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, media (binary): each whole text's payload as an Ogg bitstream.  A null text counts as empty (64 bytes 0)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([write(payload_of(t)[1]) for t in texts], pa.binary())], names=["key", "media"])

    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, f"key {kind}, media binary").withColumnRenamed("key", key)


def packets(media: DataFrame, *, column: str = "media", key: str = "doc_id", rate: int = RATE) -> DataFrame:
    """One row per packet after a stream's first: key, serial, packet, start_s, end_s, data, error.

    Streams of the own format are timed as they were cut; Vorbis, Opus and other streams by granules alone, the others at `rate`.
    A null or broken bitstream gives one row with its error and nulls besides; an empty one has no stream and gives none.
    """
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k, m in zip(batch.column("key"), batch.column("media").to_pylist(), strict=True):
                try:
                    if m is None:
                        raise OggError("no bitstream")
                    streams = read(m)
                    if all(s.packets and s.packets[0][0].startswith(MAGIC) for s in streams):
                        own, _, found = timed_packets(streams) if streams else (1, 0, [])
                        rows += [(k, p.serial, p.number, p.start / own, p.end / own, p.data, None) for p in found]
                    else:
                        timed = [(s.serial, *t) for s in streams if s.packets for t in by_granules(s, *(clock_of(s.packets[0][0]) or (rate, 0)))]
                        rows += [(k, *t, None) for t in sorted(timed, key=lambda t: (t[2], t[0], t[1]))]
                except OggError as e:
                    rows.append((k, None, None, None, None, None, str(e)))
                if len(rows) > 2000:
                    yield _packet_batch(rows, batch.schema.field("key").type)
                    rows = []
            yield _packet_batch(rows, batch.schema.field("key").type)

    return media.select(F.col(key).alias("key"), F.col(column).alias("media")).mapInArrow(run, f"key {kind}, serial long, packet long, start_s double, end_s double, data binary, error string").withColumnRenamed("key", key)


def _packet_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.string())
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in c], t) for c, t in zip(columns, types, strict=True)], names=["key", "serial", "packet", "start_s", "end_s", "data", "error"])


def digests(docs: DataFrame) -> DataFrame:
    """Per document: the payload stored as Ogg, read back from the stored bytes, and its features (the bytes don't leave the task).

    A null text counts as empty; rows stand alone, so null or equal ids are no matter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_batches(batches):
            out: list[list] = [[] for _ in range(7)]
            for text in texts:
                n, payload = payload_of(text)
                media = write(payload)
                streams = read(media)
                rate, _, found = timed_packets(streams)
                back = b"".join(p.data for p in found)
                for column, value in zip(out, (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(rate, streams, found)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in out)], names=NAMES)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
