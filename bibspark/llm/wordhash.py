"""Hashes of words and of runs of words for a batch of texts at once.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D).  Each has two independent 64-bit hashes: words
of up to LONG bytes mix their length and eight bytes at a time, each step a permutation of 64 bits; longer ones take
theirs from a BLAKE2 digest.  Runs of words combine their words' hashes pairwise, in blocks of doubling width, so any
window length costs a few passes.  No step is linear, so texts of a regular build (two letters in a Thue-Morse
sequence, say) don't collide more often than others.
"""

from __future__ import annotations

import hashlib

import numpy as np

from bibspark.llm.common import mix64

LONG = 64
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_FACTORS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))  # odd
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _words_of(raw: np.ndarray, start: np.ndarray, size: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the words that begin at start; raw has eight bytes to spare at its end."""
    hashes = [mix64(size.astype(np.uint64) * np.uint64(s) + np.uint64(s)) for s in _SEEDS]
    eights = np.lib.stride_tricks.as_strided(raw, (len(raw) - 8, 8), (1, 1))
    short = np.flatnonzero(size <= LONG)
    for done in range(0, LONG, 8):
        if done:
            short = short[size[short] > done]
        if not len(short):
            break
        value = np.ascontiguousarray(eights[start[short] + done]).view("<u8")[:, 0] & _MASKS[np.minimum(size[short] - done, 8)]
        for h, f in zip(hashes, _FACTORS, strict=True):
            h[short] = mix64((h[short] ^ value) * f)
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : start[i] + size[i]], digest_size=16).digest()
        hashes[0][i], hashes[1][i] = np.frombuffer(digest, "<u8")
    return hashes[0], hashes[1]


def combined(left: np.ndarray, right: np.ndarray, which: int) -> np.ndarray:
    """Hash of two neighbouring runs from theirs."""
    return mix64(left * _FACTORS[which] + right)


class Words:
    """The words of several texts: both hashes of each, and where each text's words begin (bounds has one entry more than texts)."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(data + bytes(8), np.uint8)
        body = raw[: len(data)]
        blank = (body == 32) | ((body >= 9) & (body <= 13))
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.bounds = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.hashes = _words_of(raw, self.start, self.end - self.start, data)

    @property
    def hash(self) -> np.ndarray:
        return self.hashes[0]

    def __len__(self) -> int:
        return len(self.start)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def runs(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of the run of `size` words that starts at each word, over all texts; those that pass a text's end are void.

        which chooses one of two independent hashes, of words and runs alike.
        """
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        block, width, at, out = self.hashes[which], 1, 0, None
        while True:
            if size & width:
                part = block[at : at + n]
                out, at = part if out is None else combined(out, part, which), at + width
            if 2 * width > size:
                return mix64(out)
            block, width = combined(block[:-width], block[width:], which), 2 * width
