"""Unicode folding.  Spark has no normalisation function, so these few are Arrow-batched Python; everything else is native.

The keys differ in the order of case folding and decomposition and in what they keep; they aren't interchangeable.
"""

from __future__ import annotations

import re
import unicodedata

from bibspark.functions.arrows import mapped

_NON_WORD = re.compile(r"\W+")
# Bytes: a to z and digits stay, all else becomes a space (capitals too, which only decomposition brings after case folding).
_KEPT = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _bare(text: str) -> str:
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text)
    for c in set(text):
        if unicodedata.combining(c):
            text = text.replace(c, "")
    return text


def _letters(text: str) -> str:
    """Runs of anything but a to z and digits become a space; none at the ends."""
    return b" ".join(text.encode("ascii", "replace").translate(_KEPT).split()).decode()


def _udf(step):
    return mapped(step)


def title_key_of(text: str) -> str:
    return _letters(_bare(text.casefold()))


def word_key_of(text: str) -> str:
    return _letters(_bare(text).casefold())


def match_text_of(text: str) -> str:
    return " ".join(_bare(text.casefold()).split())


def plain_words_of(text: str) -> str:
    return _NON_WORD.sub(" ", _bare(text)).strip().casefold()


def clean_of(text: str) -> str | None:
    return " ".join(unicodedata.normalize("NFKC", text).split()) or None


def correction_key_of(text: str) -> str:
    return (clean_of(text.replace(" ", " ")) or "").casefold()


#: Case folded, then decomposed; letters and digits only.
title_key = _udf(title_key_of)
#: Decomposed, then case folded; letters and digits only.
word_key = _udf(word_key_of)
#: Accents go, punctuation stays; also the order of the final list.
match_text = _udf(match_text_of)
#: Runs of signs that aren't word characters become a space; case goes last.
plain_words = _udf(plain_words_of)
#: NFKC with single spaces; null if nothing is left.
clean = _udf(clean_of)
#: As clean, case folded, accents kept.
correction_key = _udf(correction_key_of)
#: Case folding alone (not lower: it widens the sharp s).
casefold = _udf(str.casefold)
