"""Operator 1: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the text is shared by all grades; ordered thresholds cut the score:
P(grade <= k) = logistic(threshold_k - score).  From it follow the expected grade and the tail probability
P(grade >= k) by which documents are selected.

Features are present or not: the lower-case words and their beginnings, the signs a word ends in, and coarse shares over the whole text
(upper case, signs, digits, repeated words, word length, size).  An L1 penalty leaves weight only where a feature tells
grades apart, so a long clean text doesn't gather noise.  The model is fitted on a bounded sample of the
labelled rows (documented below); everything else runs over all rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibspark.llm.common import text_batches, text_or_empty

#: Bound of the sample that is fitted on: so many labelled documents at most, chosen by a hash of their id.
SAMPLE_ROWS = 10_000
HASH_BITS = 18
TAIL_GRADE = 2
KEEP_AT = 0.5
STEM = 4  # signs of a word's beginning that stand for its inflected forms
_EDGES = ".,;:!?\"'()[]{}*$%&#"
_TAIL = re.compile(r"[^\w\s]+$")


def grade_of(quality: Column, toxic: Column) -> Column:
    """Three grades: 0 poor, 1 good but toxic, 2 good; null where quality isn't rated."""
    return F.when(quality.isNotNull(), F.when(quality <= 0, 0).when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(2))


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


def word_names(word: str) -> list[str]:
    """Features of one word: itself in small letters without signs at its edges, its beginning, the signs it ends in."""
    name = word.lower().strip(_EDGES)
    tail = None if word[-1].isalnum() else _TAIL.search(word)
    return [name, *["\0start=" + name[:STEM]] * (len(name) > STEM), *(["\0tail=" + tail.group()[:4]] if tail else [])]


#: What is counted over a text's different words; a word's counts stand in one number, FIELD bits for each.
COUNTED = ("letters", "upper", "tailed", "twice", "digits", "signs")
FIELD = 40


def word_counts(word: str) -> int:
    tailed = not word[-1].isalnum()
    values = (len(word), word.isupper(), tailed, tailed and len(word) > 1 and not word[-2].isalnum(), any(map(str.isdigit, word)), len(word) < 4 and not any(map(str.isalnum, word)))
    return sum(int(v) << (FIELD * i) for i, v in enumerate(values))


def shape_names(n: int, distinct: int, counts: int, bars: bool) -> list[str]:
    """Features of a whole text from its number of words, of different words, and the sum of the latter's word_counts."""
    if not n:
        return []
    of = {name: (counts >> (FIELD * i)) & ((1 << FIELD) - 1) for i, name in enumerate(COUNTED)}
    shares = {k: of[k] / distinct for k in COUNTED[1:]} | {"repeat": 1 - distinct / n}
    names = [f"\0{k}>{i}" for k, v in shares.items() for i in range(1, 11) if v * 10 >= i]
    names += [f"\0density>{i}" for i in range(1, 9) if n >= 20 and n / distinct >= 2**i / 2]
    names += [f"\0words>{i}" for i in range(1, 20) if log2(n) >= i]
    names += [f"\0length>{i}" for i in range(1, 16) if of["letters"] / distinct >= i]
    return names + ["\0bars"] * bars


class Features(dict):
    """word -> (slots of its features, its counts), worked out once for each word; with `wanted`, only the slots in it."""

    MOST = 100_000

    def __init__(self, wanted=None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[tuple[int, ...], int]:
        slots = {slot(x) for x in word_names(word)}
        self[word] = found = (tuple(slots if self.wanted is None else slots & self.wanted.keys()), word_counts(word))
        return found

    def __call__(self, text: str) -> set[int]:
        """The slots of a text's features."""
        if len(self) > self.MOST:
            self.clear()
        words = text.split()
        distinct = set(words)
        facts = list(map(self.__getitem__, distinct))
        shape = shape_names(len(words), len(distinct), sum(f[1] for f in facts), "|" in distinct)
        found = {slot(x) for x in shape}
        if self.wanted is not None:
            found &= self.wanted.keys()
        return found.union(*[f[0] for f in facts if f[0]])


@dataclass(frozen=True)
class CumulativeLink:
    weights: dict[int, float]  # by hashed slot, those that aren't 0
    thresholds: tuple[float, ...]

    def score(self, slots) -> float:
        return sum(self.weights.get(s, 0.0) for s in sorted(slots))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - np.asarray(score)[:, None], -500, 500)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.tails(score).sum(axis=1)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _log_logistic(x):
    return -np.logaddexp(0.0, -x)


class _Likelihood:
    """Mean negative log likelihood of grades 0..k, each with rows, under ordered thresholds; convex in scores and thresholds together.

    P(grade = g) is written as F(t[g] - s) F(s - t[g-1]) (1 - exp(t[g-1] - t[g])) with the logistic F, so nothing is divided by a
    difference of probabilities, and equal thresholds around a grade that has rows cost infinitely much.
    """

    def __init__(self, grades: np.ndarray):
        self.n, self.k, self.grades = len(grades), int(grades.max()), grades
        self.sizes = np.bincount(grades, minlength=self.k + 1)
        self.below, self.above = np.flatnonzero(grades < self.k), np.flatnonzero(grades > 0)
        shares = np.cumsum(self.sizes)[:-1] / self.n
        self.start = np.log(shares / (1 - shares))  # best where all scores are 0; strictly ordered as each grade has rows

    def loss(self, theta: np.ndarray, s: np.ndarray) -> float:
        gaps = np.diff(theta)
        if (gaps <= 0).any():
            return np.inf
        up = _log_logistic(theta[self.grades[self.below]] - s[self.below]).sum()
        down = _log_logistic(s[self.above] - theta[self.grades[self.above] - 1]).sum()
        return -(up + down + (self.sizes[1:-1] * np.log(-np.expm1(-gaps))).sum()) / self.n

    def slope(self, theta: np.ndarray, s: np.ndarray) -> np.ndarray:
        """By each row's score; within -1/n and 1/n, and its derivative at most 1/(2n)."""
        ends = np.concatenate([[-np.inf], theta, [np.inf]])
        return (1 - _logistic(ends[self.grades + 1] - s) - _logistic(ends[self.grades] - s)) / self.n

    def newton(self, theta: np.ndarray, s: np.ndarray, loss: float) -> tuple[np.ndarray, float]:
        """A Newton step on the thresholds, halved until it lowers the loss and keeps the order."""
        slope, bend = np.zeros(self.k), np.zeros((self.k, self.k))
        for j in range(self.k):
            f = _logistic(theta[j] - s)
            own, next_ = self.grades == j, self.grades == j + 1
            slope[j] = f[next_].sum() - (1 - f[own]).sum()
            bend[j, j] = (f * (1 - f))[own | next_].sum()
        for j, (gap, size) in enumerate(zip(np.diff(theta), self.sizes[1:-1], strict=True)):
            r = size / np.expm1(gap)
            slope[j] += r
            slope[j + 1] -= r
            bend[j : j + 2, j : j + 2] += r / -np.expm1(-gap) * np.array([[1, -1], [-1, 1]])
        step = np.linalg.solve(bend + 1e-9 * np.eye(self.k) * max(1.0, bend.max()), slope)
        for _ in range(40):
            new = theta - step
            if (got := self.loss(new, s)) <= loss:
                return new, got
            step = step / 2
        return theta, loss


class _Columns:
    """Sums over rows and over columns of a 0/1 matrix given by its entries, each by one pass over sorted entries."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, d: int):
        self.n, self.d = n, d
        by_row, by_col = np.lexsort((cols, rows)), np.lexsort((rows, cols))
        self.cols, self.rows = cols[by_row].astype(np.int32), rows[by_col].astype(np.int32)
        self.row_ids, self.row_at = np.unique(rows[by_row], return_index=True)
        self.col_ids, self.col_at = np.unique(cols[by_col], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.row_at):
            out[self.row_ids] = np.add.reduceat(w[self.cols], self.row_at)
        return out

    def transposed(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.d)
        if len(self.col_at):
            out[self.col_ids] = np.add.reduceat(v[self.rows], self.col_at)
        return out


def fit_arrays(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, *, l1: float = 1e-4, steps: int = 300, least: int = 3) -> CumulativeLink:
    """Minimise the mean negative log likelihood plus l1 times the weights' absolute sum, which is convex.

    rows and cols are the present features (document, slot).  Slots in fewer than `least` documents are left
    out.  Steps on the weights are proximal with momentum, begun anew where the objective would rise, and each is followed by a Newton step
    on the thresholds; only slots whose gradient the penalty doesn't hold at 0 are worked on, and the others are looked at
    again until none is missing.  A grade without rows gets no room between its thresholds; with fewer than two different
    grades the model gives every text the one grade (or 0 without rows).  Raises ArithmeticError if the objective doesn't fall.
    """
    found = np.unique(grades)
    if len(found) < 2:
        top = int(found[0]) if len(found) else 0
        return CumulativeLink({}, tuple(-50.0 for _ in range(top)) + (50.0,) * (TAIL_GRADE - top))
    n = len(grades)
    used, inverse = np.unique(cols, return_inverse=True)
    often = np.bincount(inverse) >= least
    place = np.cumsum(often) - 1
    take = often[inverse]
    rows, slots, cols = rows[take], used[often], place[inverse[take]]
    d = len(slots)
    whole = _Columns(rows, cols, n, d)
    # Each weight has its own step: with features of 0 and 1, X'X is at most the diagonal of the columns' sums of row sizes.
    step = 2 * n / np.maximum(whole.transposed(np.bincount(rows, minlength=n).astype(float)), 1.0) if d else np.ones(0)
    fitted = _Likelihood(np.searchsorted(found, grades))
    theta, w, s = fitted.start.copy(), np.zeros(d), np.zeros(n)
    first = objective = fitted.loss(theta, s)
    left, active = steps, np.zeros(d, bool)
    while left > 0:
        missing = (np.abs(whole.transposed(fitted.slope(theta, s))) > l1) & ~active
        if not missing.any() and left < steps:
            break
        active |= missing
        own = np.flatnonzero(active)
        inside = active[cols]
        part = _Columns(rows[inside], np.searchsorted(own, cols[inside]), n, len(own))
        x, size = w[own], step[own]
        y, ys, momentum = x.copy(), s, 1.0
        for _ in range(left):
            left -= 1
            new = y - size * part.transposed(fitted.slope(theta, ys))
            new = np.sign(new) * np.maximum(np.abs(new) - size * l1, 0)
            news = part.times(new)
            loss = fitted.loss(theta, news)
            got = loss + l1 * np.abs(new).sum()
            if got > objective and momentum > 1:
                y, ys, momentum = x.copy(), s, 1.0
                continue
            theta, loss = fitted.newton(theta, news, loss)
            got = loss + l1 * np.abs(new).sum()
            nxt = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            ahead = (momentum - 1) / nxt
            y, ys = new + ahead * (new - x), news + ahead * (news - s)
            fell, objective, x, s, momentum = objective - got, min(objective, got), new, news, nxt
            if fell < 1e-9:
                break
        w[own] = x
    if not objective <= first:
        raise ArithmeticError("the fit doesn't lower the objective")
    ends = np.concatenate([[-50.0], theta, [50.0]])
    thresholds = tuple(float(ends[np.searchsorted(found, g, side="right")]) for g in range(TAIL_GRADE if found[-1] <= TAIL_GRADE else int(found[-1])))
    keep = np.flatnonzero(w)
    return CumulativeLink({int(slots[i]): float(w[i]) for i in keep}, thresholds)


def _slots_of(batches):
    features = Features()
    for batch, texts in text_batches(batches):
        found = [np.fromiter(features(t), np.int32) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([np.sort(x) for x in found], pa.list_(pa.int32()))], names=["doc_id", "grade", "slots"])


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, l1: float = 1e-4) -> CumulativeLink:
    """Fit on at most sample_rows labelled documents; features are computed where the texts are, only slots reach the driver.

    Labels without a rating or a document are left out, as are documents without a text.  A document with several
    labels counts once with the lowest grade; of rows with one id the least text speaks.  The sample is put in order of
    id, so the model doesn't depend on how rows are dealt out.
    """
    rated = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")).filter("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    joined = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    kind = joined.schema["doc_id"].dataType.simpleString()
    got = joined.mapInArrow(_slots_of, f"doc_id {kind}, grade int, slots array<int>").toArrow().sort_by("doc_id")
    slots = got["slots"].combine_chunks()
    if isinstance(slots, pa.ChunkedArray):
        slots = pa.concat_arrays(slots.chunks) if slots.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = slots.value_lengths().to_numpy(zero_copy_only=False)
    return fit_arrays(np.repeat(np.arange(len(sizes)), sizes), slots.flatten().to_numpy().astype(np.int64), got["grade"].to_numpy().astype(np.int64), l1=l1)


def rated(docs: DataFrame, model: CumulativeLink, *, keep_at: float = KEEP_AT, tail_grade: int = TAIL_GRADE) -> DataFrame:
    """docs with score, expected_grade, tail_probability (of tail_grade or better) and keep added (columns of these names are replaced).

    A null text counts as empty; it has no features, so its score is 0.
    """
    docs = docs.drop("score", "expected_grade", "tail_probability", "keep")
    kept = docs.columns
    schema = docs.select(F.struct(*kept).alias("row"), text_or_empty().alias("text"))

    def run(batches):
        features = Features(model.weights)
        for batch, texts in text_batches(batches):
            s = np.array([model.score(features(t)) for t in texts], np.float64)
            tail = model.tails(s)[:, tail_grade - 1]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(s), pa.array(model.expected(s)), pa.array(tail), pa.array(tail >= keep_at)], names=["row", "score", "expected_grade", "tail_probability", "keep"])

    out = T.StructType([schema.schema["row"], *(T.StructField(c, T.DoubleType()) for c in ("score", "expected_grade", "tail_probability")), T.StructField("keep", T.BooleanType())])
    return schema.mapInArrow(run, out).select("row.*", "score", "expected_grade", "tail_probability", "keep")
