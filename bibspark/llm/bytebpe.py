"""Operator 7: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The split of a text into pieces is that of the usual byte-level pattern
('s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|blank+(?!non-blank)|blank+), found without a regex engine:

* every code point becomes a class (one table gather);
* a class acts on the states of a small automaton as a function state -> state.  The functions that
  compositions of classes can form are enumerated once, with their composition table, so composing is one
  gather.  Composition is associative, so the texts of a whole batch are scanned at once: blocks are reduced
  to one function each, the blocks' functions are scanned by doubling, and each block is replayed from its
  start state;
* a piece starts where a table over (state before, class, next class, class after that) says so.

Pieces go through a bounded cache of merged pieces; a miss runs the pair merges by rank.  Token ids keep
their byte offsets, and decoding gathers the tokens' bytes into those offsets.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import text_batches, text_or_empty

# Classes of code points.
SEP, SPACE, BLANK, OTHER, APOS, DIGIT, LETTER, LONE, R, V, L, E = range(12)
N_CLASSES = 12
# States: what the piece that holds the last code point is.  Q* are an apostrophe that began a piece and what followed it.
FRESH, S_SPACE, S_BLANK, S_OTHER, S_DIGIT, S_LETTER, Q, QR, QV, QL = range(10)
N_STATES = 10
LETTERS = (LETTER, LONE, R, V, L, E)
BLOCK = 128


def _step(state: int, cls: int) -> int:
    if cls == SEP:
        return FRESH
    if cls == SPACE:
        return S_SPACE
    if cls == BLANK:
        return S_BLANK
    if cls == DIGIT:
        return S_DIGIT
    if cls == OTHER:
        return S_OTHER
    if cls == APOS:  # begins a piece of its own unless a space or a run of other signs takes it in
        return S_OTHER if state in (S_OTHER, S_SPACE, Q) else Q
    if state == Q:
        return {LONE: FRESH, R: QR, V: QV, L: QL}.get(cls, S_LETTER)
    if (state, cls) in ((QR, E), (QV, E), (QL, L)):
        return FRESH  # 're 've 'll are complete
    return S_LETTER


def _starts(state: int, cls: int, after: int, later: int) -> bool:
    """Whether a piece starts at a code point of class cls; state is that before it, after and later the next two classes."""
    if cls == SEP or state == FRESH:
        return True
    blank_before = state in (S_SPACE, S_BLANK)
    if cls in (SPACE, BLANK):
        return not blank_before or after not in (SPACE, BLANK, SEP)  # the last blank before a sign stands apart
    if blank_before:
        return state == S_BLANK  # a space joins what follows it
    if cls == DIGIT:
        return state != S_DIGIT
    if cls == OTHER:
        return state not in (S_OTHER, Q)
    if cls == APOS:
        return state not in (S_OTHER, Q)
    if state == Q:  # letters after an apostrophe: a contraction goes on, else the letters are a piece
        return not (cls == LONE or (cls in (R, V) and after == E) or (cls == L and after == L))
    return state not in (S_LETTER, QR, QV, QL)


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, composition table, function applied to state, start table)."""
    gens = [tuple(_step(s, c) for s in range(N_STATES)) for c in range(N_CLASSES)]
    ident = tuple(range(N_STATES))
    ids, todo = {ident: 0}, [ident]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    funcs = sorted(ids, key=ids.get)
    table = np.array([[ids[tuple(g[x] for x in f)] for g in funcs] for f in funcs], np.int16)
    starts = np.zeros(N_STATES * N_CLASSES**3, bool)
    for s, a, b, c in product(range(N_STATES), *[range(N_CLASSES)] * 3):
        starts[((s * N_CLASSES + a) * N_CLASSES + b) * N_CLASSES + c] = _starts(s, a, b, c)
    return np.array([ids[g] for g in gens], np.int16), table, np.array(funcs, np.int16), starts


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        cat = unicodedata.category(chr(cp))[0]
        if cat == "L":
            t[cp] = LETTER
        elif cat == "N":
            t[cp] = DIGIT
    # White space: the code points of Unicode's White_Space property.
    for cp in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        t[cp] = BLANK
    t[0x20], t[0x27] = SPACE, APOS
    for ch, c in (("s", LONE), ("t", LONE), ("m", LONE), ("d", LONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        t[ord(ch)] = c
    return t


def scan_states(cls: np.ndarray) -> np.ndarray:
    """State before each code point, by an associative scan over the classes' functions."""
    gens, table, apply, _ = _automaton()
    n = len(cls)
    if not n:
        return np.zeros(0, np.int16)
    rows = -(-n // BLOCK)
    f = np.zeros(rows * BLOCK, np.int16)  # the identity fills the last block
    f[:n] = gens[cls]
    f = np.ascontiguousarray(f.reshape(rows, BLOCK).T)
    total = f[0]
    for k in range(1, BLOCK):
        total = table[total, f[k]]
    shift = 1
    while shift < rows:  # inclusive scan of the blocks' functions by doubling
        total = np.concatenate([total[:shift], table[total[:-shift], total[shift:]]])
        shift *= 2
    state = apply[np.concatenate([np.zeros(1, np.int16), total[:-1]]), FRESH]
    out = np.empty((BLOCK, rows), np.int16)
    for k in range(BLOCK):
        out[k] = state
        state = apply[f[k], state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def piece_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by one sign each, where its pieces start, and each text's separator (a piece of its own)."""
    joined = "\U0010ffff".join(texts) + "\U0010ffff"
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    cls = class_table()[cps]
    seps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    cls[seps] = SEP
    _, _, _, starts = _automaton()
    ahead = np.concatenate([cls, [SEP, SEP]]).astype(np.int32)
    key = ((scan_states(cls).astype(np.int32) * N_CLASSES + ahead[:-2]) * N_CLASSES + ahead[1:-1]) * N_CLASSES + ahead[2:]
    return joined, np.flatnonzero(starts[key]), seps


def pieces(text: str) -> list[str]:
    joined, at, _ = piece_starts([text])
    at = at.tolist()
    return [joined[a:b] for a, b in zip(at, at[1:], strict=False)]


class ByteBpe:
    """Encoder and decoder over a rank table bytes -> id."""

    CACHE = 250_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.vocab = [b""] * size
        for k, v in ranks.items():
            self.vocab[v] = k
        self.lengths = np.fromiter(map(len, self.vocab), np.int64, size)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.vocab), np.uint8)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def from_tiktoken(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank is merged, the leftmost first, until no pair has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.vocab)
        pair = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for a long piece with a heap, so the cost stays near linear."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _miss(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = np.array(self.merge(piece.encode()), "<u4").tobytes()
            if len(piece) > 64:
                return got
        if len(self.young) >= self.CACHE:
            self.old, self.young = self.young, {}
        self.young[piece] = got
        return got

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        joined, at, seps = piece_starts(texts)
        cuts = np.searchsorted(at, seps).tolist()
        at = at.tolist()
        out, first, miss = [], 0, self._miss
        for cut in cuts:
            get = self.young.get
            found = [get(w) or miss(w) for w in [joined[a:b] for a, b in zip(at[first:cut], at[first + 1 : cut + 1], strict=True)]]
            out.append(b"".join(found))
            first = cut + 1
        return out

    def decode(self, ids: bytes) -> tuple[bytes, np.ndarray]:
        """The bytes of the tokens, and the offset in them at which each token starts."""
        t = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.lengths[t]
        offsets = np.cumsum(size) - size
        where = np.repeat(self.begins[t] - offsets, size) + np.arange(int(size.sum()))
        return self.blob[where].tobytes(), offsets


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBpe:
    return ByteBpe.from_tiktoken(path)


def encode_decode(docs: DataFrame, ranks_path: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text.

    Returns one row per input row: key, n_tokens, ids (binary, little-endian unsigned 32-bit), token_offsets
    (binary, little-endian unsigned 64-bit byte offsets), decoded (binary).  A null text counts as empty and
    gives no tokens; rows with equal keys, null keys and extra columns are no matter, as rows stand alone.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))

    def run(batches):
        bpe = encoder(ranks_path)
        for batch, texts in text_batches(batches):
            ids = bpe.encode_batch(texts)
            back = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([o.astype("<u8").tobytes() for _, o in back], pa.binary()), pa.array([b for b, _ in back], pa.binary())],
                names=["key", "n_tokens", "ids", "token_offsets", "decoded"],
            )

    return rows.mapInArrow(run, f"key {kind.simpleString()}, n_tokens long, ids binary, token_offsets binary, decoded binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """encode_decode reduced to doc_id, n_tokens, ids_sha256, decoded_sha256 inside the same task (ids and bytes don't travel)."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def run(batches):
        bpe = encoder(ranks_path)
        for batch, texts in text_batches(batches):
            ids = bpe.encode_batch(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x)[0]).hexdigest() for x in ids])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
