"""Operator 6: secret scans.

Base rules find assignments, access keys and long hexadecimal runs.  Beside them, candidate strings (long runs of
key-like signs) are searched for windows of high Shannon entropy: for each character class a window slides over
the candidate's runs of that class, its counts change by one sign in and one sign out, and the entropy follows
from a running sum.  A run with a window over the class's threshold is a span as a whole, as a secret's quiet parts belong to it,
unless the allow-list lets it through: fixed patterns, and what reads as words (joined words, paths, names in camel
case).  Within a URL each part between slashes is a candidate of its own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import text_batches, text_or_empty

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the longest run from the leftmost start: shorter runs fail with every start inside them
HEX = re.compile(r"[0-9a-f]{24,}")
JOINED = re.compile(r"^(?!(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/]*$)")  # not just words and numbers joined by separators
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PART = re.compile(r"[^/]+")
URL_BEGUN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]*$")
URL_SIGNS = 2_000  # how far back a URL's beginning is looked for
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper", "entropy_mixed")


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    runs: re.Pattern
    window: int
    threshold: float  # bits a sign
    needs: tuple[re.Pattern, ...] = ()  # each must be found in a span; what an earlier class's span holds is not given again


@dataclass(frozen=True)
class EntropyRules:
    """What counts as a candidate, the classes with their windows and thresholds, and what is let through."""

    candidate: re.Pattern = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
    classes: tuple[CharacterClass, ...] = (
        CharacterClass("entropy_hex", re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0),
        CharacterClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 4.0),
        # 20 random signs of 36 have 3.9 bits on average, of 32 3.8, of 64 4.1; words have no digits.
        CharacterClass("entropy_lower", re.compile(r"[a-z0-9]{20,}"), 20, 3.3, (re.compile("[0-9]"), re.compile("[a-z]"))),
        CharacterClass("entropy_upper", re.compile(r"[A-Z0-9]{20,}"), 20, 3.3, (re.compile("[0-9]"), re.compile("[A-Z]"))),
        CharacterClass("entropy_mixed", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.6, (re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]"), JOINED)),
    )
    #: A span is let through if one of these matches the whole span or the whole candidate around it.
    allow: tuple[re.Pattern, ...] = (
        re.compile(r"[0-9]+"),  # plain numbers
        re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),  # UUIDs
        re.compile(r"[A-Za-z]?[a-z]+([-_/][A-Za-z]?[a-z]+)*"),  # words, also joined ones
        re.compile(r"[A-Z]+([-_/][A-Z]+)*"),
        re.compile(r"(?i)(abcdefghijklmnopqrstuvwxyz|0123456789|abcdef|[+/_=-])+"),  # alphabets
    )
    #: A span of both cases is let through too if its pieces (a capital with small letters, capitals, digits) have so many signs on average.
    word_length: float = 3.5
    steps: tuple[float, ...] = field(default_factory=lambda: tuple(c * log2(c) if c else 0.0 for c in range(257)))


RULES = EntropyRules()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules; leftmost matches, not overlapping within a kind, those that fail the length dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def hot_windows(run: str, window: int, threshold: float, steps: tuple[float, ...]) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy reaches the threshold.

    The entropy of a window of w signs is log2(w) - sum(c log2 c)/w over its counts c; the sum is kept from window to window.
    """
    most = (log2(window) - threshold) * window + 1e-9  # what the sum may be
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, sign in enumerate(run):
        c = counts.get(sign, 0)
        total += steps[c + 1] - steps[c]
        counts[sign] = c + 1
        if i >= window:
            gone = run[i - window]
            c = counts[gone]
            total += steps[c - 1] - steps[c]
            counts[gone] = c - 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def reads_as_words(text: str, least: float) -> bool:
    """Whether capitals and small letters take turns, and give way to digits and other signs, as seldom as they do in words."""
    pieces = PIECE.findall(text)
    return not text.islower() and not text.isupper() and bool(pieces) and sum(map(len, pieces)) >= least * len(pieces)


def candidates(text: str, rules: EntropyRules):
    """(start, candidate) of a text; of one within a URL the parts between slashes."""
    for m in rules.candidate.finditer(text):
        head = text[max(0, m.start() - URL_SIGNS) : m.start()]
        if "/" in m.group() and URL_BEGUN.search(head):
            yield from ((m.start() + p.start(), p.group()) for p in PART.finditer(m.group()) if rules.candidate.fullmatch(p.group()))
        else:
            yield m.start(), m.group()


def entropy_spans(text: str, rules: EntropyRules = RULES) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the runs of a class's signs that hold a hot window and aren't let through, those within another's span once."""
    out = []
    allowed = lambda x: any(a.fullmatch(x) for a in rules.allow) or reads_as_words(x, rules.word_length)
    for at, candidate in candidates(text, rules):
        if allowed(candidate):
            continue
        held = len(out)
        for c in rules.classes:
            for r in c.runs.finditer(candidate):
                run, start, end = r.group(), at + r.start(), at + r.end()
                if not all(x.search(run) for x in c.needs) or (c.needs and any(s[0] <= start and end <= s[1] for s in out[held:])):
                    continue
                if not allowed(run) and hot_windows(run, c.window, c.threshold, rules.steps):
                    out.append((start, end, c.kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id", rules: EntropyRules = RULES, replacement: str | None = None) -> DataFrame:
    """One row per input row: key, n_assign, n_access, n_hex, base_sha256, spans and, with `replacement`, the text with its spans replaced.

    Offsets count code points, ends exclusive.  A null text counts as empty: no spans (and it stays null where
    texts are replaced).  Overlapping spans are replaced as one.
    """
    kind = docs.schema[key].dataType.simpleString()
    wanted = replacement is not None

    def run(batches):
        for batch, texts in text_batches(batches):
            counts, sha, spans, clean = ([], [], []), [], [], []
            for value in texts:
                base = base_spans(value)
                for column, name in zip(counts, KINDS, strict=False):
                    column.append(sum(1 for s in base if s[2] == name))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found = base + entropy_spans(value, rules)
                spans.append(joined(found))
                if wanted:
                    clean.append(replaced(value, found, replacement))
            columns = [batch.column("key"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(clean, pa.string())] * wanted, names=["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["clean_text"] * wanted)

    out = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", clean_text string" * wanted)
    return out.withColumnRenamed("key", key)


def replaced(text: str, spans: list[tuple[int, int, str]], replacement: str) -> str:
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= end:
            out += [text[at:a], replacement]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text", replacement: str = "[SECRET]", rules: EntropyRules = RULES) -> DataFrame:
    """The table with its texts' secrets replaced; null texts stay null, other columns and their order stay."""
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches):
        for batch, texts in text_batches(batches, text):
            null = batch.column(text).is_null().to_pylist()
            clean = [None if n else replaced(t, base_spans(t) + entropy_spans(t, rules), replacement) for t, n in zip(texts, null, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, schema)
