"""Operator 8: n-gram Jaccard self-join with MinHash banding.

* Each text becomes the set of its word five-grams (64-bit hashes) and a MinHash signature.  The number of rows in a band and of bands
  follow from the wanted recall at the threshold.
* Documents with the same set form a class (128-bit hash of the set); one representative goes on.
* Band hashes are shuffled.  Buckets of one representative end there.  A bucket's members are known by count, total
  size and two order-free sums over their ids, so of equal buckets in several bands only the first stays.
* Bucket members get their text and meet in tasks of bounded size: a large bucket is cut into blocks and every two blocks meet
  in a task of their own.  There the full sets are intersected, by matrix products over the shingles that they share.  What leaves a task is a
  count of links for each representative and at most one edge for each (to the least one connected), never the pairs.  A pair that meets in several
  bands counts in the first.
* Edges give the groups of near-duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import checkpointed, components, mix64, text_batches, text_or_empty
from bibspark.llm.wordhash import Words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
BLOCK_SHINGLES = 4_000_000


@dataclass(frozen=True)
class Banding:
    rows: int
    bands: int

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 192) -> Banding:
    """The most rows a band, so the fewest false candidates, for which the bands that the recall at the threshold needs stay within most_hashes."""
    best = None
    for rows in range(1, 33):
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows)))))
        if rows * bands <= most_hashes:
            best = Banding(rows, bands)
    if best is None:
        raise ValueError("no banding within most_hashes has this recall")
    return best


@lru_cache(maxsize=4)
def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams (lower case); fewer words than n make one n-gram, no words none."""
    words = Words([t.lower().encode() for t in texts])
    runs = words.runs(size)
    out = []
    for a, b in zip(words.bounds.tolist(), words.bounds[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            mixed = np.uint64(b - a)
            for h in words.hash[a:b]:
                mixed = mix64(np.array([mixed], np.uint64) ^ h)[0]
            out.append(np.array([mixed], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    a, b = _hashers(n)
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(low), 4096):
        part = low[first : first + 4096]
        grid = np.multiply.outer(a, part)
        grid += b[:, None]
        # The product's high bits are the well mixed ones, and they decide the least value.
        np.minimum(out, grid.min(axis=1), out=out)
    return out


def band_hashes(shingles: np.ndarray, plan: Banding) -> np.ndarray:
    if not len(shingles):
        return np.zeros(0, np.int64)
    grid = signature(shingles, plan.rows * plan.bands).reshape(plan.bands, plan.rows).astype(np.uint64)
    h = np.arange(1, plan.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(plan.rows):
        h = mix64(h ^ grid[:, k])
    return h.view(np.int64)


def signatures(docs: DataFrame, plan: Banding, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc, n_shingles, s1, s2 (hash of the set), bands (array of a hash for each band; empty for a text without words)."""

    def run(batches):
        for batch, texts in text_batches(batches, most=1 << 19):
            sets = shingle_sets(texts, size)
            s1 = [int((mix64(s).sum(dtype=np.uint64) if len(s) else np.uint64(0)).view(np.int64)) for s in sets]
            s2 = [int((mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) if len(s) else np.uint64(0)).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([band_hashes(s, plan) for s in sets], pa.list_(pa.int64()))], names=["doc", "n_shingles", "s1", "s2", "bands"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc long, n_shingles long, s1 long, s2 long, bands array<long>")


def connected(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the pairs (x, y) connect it with."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        # Roots take the smaller root; then every row looks past its root.
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        while (label != (up := label[label])).any():
            label = up
        if (label == before).all():
            break
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return label


class _Strip:
    """Some sets as sorted (shingle, set) entries, to be met with other strips."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.sizes = np.fromiter(map(len, sets), np.float64, self.n)
        values, owners = np.concatenate(sets), np.repeat(np.arange(self.n), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]
        self.distinct = np.unique(self.values)

    def common(self, other: _Strip, most: int = 8_000_000) -> np.ndarray:
        """Sizes of the intersections of all own with all of the other's sets; only shingles on both sides are looked at, some columns at a time."""
        shared = np.intersect1d(self.distinct, other.distinct, assume_unique=True)
        out = np.zeros((self.n, other.n), np.float32)
        width = max(256, most // max(self.n, other.n, 1))
        for first in range(0, len(shared), width):
            part = shared[first : first + width]
            x = self._present(part)
            out += x @ (x if other is self else other._present(part)).T
        return out

    def _present(self, part: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.values, part[0]), np.searchsorted(self.values, part[-1], side="right")
        values = self.values[low:high]
        at = np.searchsorted(part, values)
        hit = part[at] == values
        out = np.zeros((self.n, len(part)), np.float32)
        out[self.owners[low:high][hit], at[hit]] = 1
        return out


def _verify(copies: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float, step: int = 1024):
    """(links of each row, least connected row of each) over the pairs of one task: within one block, or between block 0 and block 1.

    bands holds each row's hashes of the bands before this task's; a pair that has one of them in common counted there.
    """
    links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    within = not side.any()
    left = np.flatnonzero(side == 0)
    lefts = [left[i : i + step] for i in range(0, len(left), step)]
    right = np.flatnonzero(side == 1)
    rights = lefts if within else [right[i : i + step] for i in range(0, len(right), step)]
    strips = [_Strip([sets[r] for r in q]) for q in rights]
    for i, p in enumerate(lefts):
        own = strips[i] if within else _Strip([sets[r] for r in p])
        for j in range(i if within else 0, len(rights)):
            q, other = rights[j], strips[j]
            inter = own.common(other)
            near = inter >= threshold * (own.sizes[:, None] + other.sizes[None, :] - inter) - 1e-9
            if within and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            x, y = p[x], q[y]
            for band in bands.T:
                new = band[x] != band[y]
                x, y = x[new], y[new]
            links += np.bincount(x, copies[y], len(sets)).astype(np.int64) + np.bincount(y, copies[x], len(sets)).astype(np.int64)
            found = connected(len(sets), x, y)
            rows = np.arange(len(sets))
            label = connected(len(sets), np.concatenate([rows, rows]), np.concatenate([label, found]))
    return links, label


def _verify_partition(size: int, threshold: float):
    """mapInArrow over rows sorted by task: consecutive rows of a task are put together."""

    def flush(rows: list[dict], out: list):
        if len(rows) < 2:
            return
        band, side = rows[0]["band"], np.array([r["side"] for r in rows])
        if rows[0]["i"] != rows[0]["j"] and (side == side[0]).all():
            return
        if len(rows) == 2:
            x, y = rows
            inter = len(np.intersect1d(x["set"], y["set"], assume_unique=True))
            if inter >= threshold * (len(x["set"]) + len(y["set"]) - inter) - 1e-9 and all(p != q for p, q in zip(x["bands"][:band], y["bands"][:band], strict=True)):
                low, high = sorted((x["doc"], y["doc"]))
                out.append(([x["doc"], y["doc"], high], [-1, -1, low], [y["copies"], x["copies"], 0], [True, True, False]))
            return
        bands = np.array([r["bands"][:band] for r in rows], np.int64).reshape(len(rows), band)
        docs = np.array([r["doc"] for r in rows])
        order = np.argsort(docs)  # so the least row is the least document
        rows, docs = [rows[k] for k in order.tolist()], docs[order]
        links, label = _verify(np.array([r["copies"] for r in rows]), bands[order], [r["set"] for r in rows], side[order], threshold)
        linked, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rows)))
        empty = np.full(len(linked), -1)
        out.append((np.concatenate([docs[linked], docs[tied]]), np.concatenate([empty, docs[label[tied]]]), np.concatenate([links[linked], np.zeros(len(tied), np.int64)]), np.repeat([True, False], [len(linked), len(tied)])))

    def batch(out):
        a, b, n, void = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 4))
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64), mask=void.astype(bool)), pa.array(n.astype(np.int64))], names=["a", "b", "links"])

    def run(batches):
        rows: list[dict] = []
        out: list[tuple] = []
        task = None
        for got, texts in text_batches(batches):
            sets = shingle_sets(texts, size)
            for r, shingles in zip(got.drop_columns(["text"]).to_pylist(), sets, strict=True):
                r["set"] = shingles
                k = (r["band"], r["h"], r["i"], r["j"])
                if k != task:
                    flush(rows, out)
                    rows, task = [], k
                rows.append(r)
            if len(out) > 1000:
                yield batch(out)
                out = []
        flush(rows, out)
        yield batch(out)

    return run


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of docs: key, copy_of, class_id, n_links.

    copy_of is the smallest id with the same n-gram set, class_id the smallest id of the group that links connect,
    n_links the number of other documents whose n-gram sets have a Jaccard similarity of at least `threshold` (copies
    of the document included).  A text without words (null, empty, blank) is alone.  A row without an id has no
    class (nulls) and links with nothing; rows with equal ids count as one document, for which the least text speaks.
    Ids are integers.
    """
    plan = banding(threshold, recall)
    kind = docs.schema[key].dataType.simpleString()
    ids = docs.select(F.col(key).cast("long").alias("doc"))
    texts = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    if not ids.filter("doc IS NOT NULL").groupBy("doc").count().filter("count > 1").isEmpty():
        texts = texts.groupBy("doc").agg(F.min("text").alias("text"))
    own = checkpointed(signatures(texts, plan, key="doc", size=size))
    sets = own.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    sets = checkpointed(sets)
    members = sets.select("rep", "n_shingles", F.posexplode("bands").alias("band", "h"))
    buckets = members.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.hash("rep").cast("long")).alias("y")).filter("n > 1")
    first = buckets.groupBy("n", "total", "x", "y").agg(F.min(F.struct("band", "h")).alias("v")).select("v.band", "v.h", F.ceil(F.col("total") / block_shingles).cast("int").alias("blocks"))
    meets = members.join(first, ["band", "h"]).select("rep", "band", "h", "blocks", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks"))).otherwise(0).cast("int").alias("block"))
    tasks = meets.select("rep", "band", "h", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("rep", "band", "h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    rows = tasks.join(sets.select("rep", "copies", "bands"), "rep").join(texts.withColumnRenamed("doc", "rep"), "rep")
    rows = rows.select(F.col("rep").alias("doc"), "copies", "bands", "band", "h", "i", "j", "side", "text")
    rows = rows.repartition("band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j")
    found = checkpointed(rows.mapInArrow(_verify_partition(size, threshold), "a long, b long, links long"))
    links = found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    groups = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("vertex", "rep")
    reps = sets.select("s1", "s2", "rep", "copies").join(links, "rep", "left").join(groups, "rep", "left").select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), "rep", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    chosen = own.select("doc", "s1", "s2", "n_shingles").join(reps, (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")) & (F.col("n_shingles") > 0), "left")
    chosen = chosen.select(F.col("doc").alias("own_doc"), F.coalesce("rep", "doc").alias("copy_of"), F.coalesce("component", "doc").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    out = ids.join(chosen, F.col("doc") == F.col("own_doc"), "left")
    return out.select(F.col("doc").cast(kind).alias(key), "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near-duplicates (the smallest id); rows without an id stay, rows with equal ids stay or go together."""
    found = near_duplicates(docs, **options)
    key = options.get("key", "doc_id")
    gone = found.filter(F.col(key).isNotNull() & (F.col("class_id") != F.col(key))).select(F.col(key).alias("gone_id")).distinct()
    return docs.join(gone, F.col(key) == F.col("gone_id"), "left_anti")
