"""Operator 5: substring dedup with fixed-block anchors.

A window is `window` (50) consecutive words of one document; the words of each window whose sequence of words also starts in
a document with a smaller id go.

1. Anchors.  Each document is cut into non-overlapping blocks of BLOCK words, which are indexed, and every rolling window of BLOCK
   words probes the index.  Any 50 words hold at least RUN whole consecutive blocks of their document, so it is
   enough to index, out of each RUN consecutive blocks, the one of least hash; and a rolling window probes only if it is the
   least of some RUN windows BLOCK words apart, as only then can it meet an indexed block.  Nothing is lost by
   this, but index and probes shrink to a third.
2. Hits.  A hash whose smallest indexed document is smaller than its largest document is a hit for all its places.
3. Extension.  In each document the 50-word windows that hold a hit are hashed exactly (96 bits), and the smallest
   document of each hash decides; neighbouring windows merge into maximal repeats.

What travels are packed columns, one binary per (group of documents, bucket of hashes).  A group (some MB of text)
combines its own rows first: of a hash that it holds several times only the smallest document's places leave it, the others
being decided on the spot, so a passage in a third of all documents sends one entry for each group.  Documents
themselves move once, into their groups.  Groups and buckets both grow with the square root of the table's size, so packed
rows grow in proportion to it, up to sizes that a worker holds; beyond (some 60 TB) rows hold one hash, never less.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import shuffle_width, text_or_empty
from bibspark.llm.wordhash import Words

WINDOW = 50
BLOCK = 8
#: Characters of text in a group and in a bucket's share: the first up to EVEN_CHARS of table, then growing with its square root up to the second.
GROUP_CHARS = (2_000_000, 16_000_000)
BUCKET_CHARS = (3_000_000, 72_000_000)
EVEN_CHARS = 500_000_000
TASK_CHARS = 128_000_000  # of text that one task shuffles at most, where the session's number of partitions would make it more
SMALL = np.iinfo(np.int64).min  # stands for a null id, which comes first


def blocks_in(window: int, block: int) -> int:
    """Whole aligned blocks that any `window` words hold."""
    return (window - block + 1) // block


def _selected(h: np.ndarray, inside: np.ndarray, block: int, run: int) -> np.ndarray:
    """Places whose hash is the least of some `run` hashes `block` apart; inside[i]: all run windows from i lie in one text."""
    n = len(h)
    reach = block * (run - 1)
    out = np.zeros(n, bool)
    m = n - reach
    if m <= 0:
        return out
    least = h[:m].copy()
    for j in range(1, run):
        np.minimum(least, h[j * block : j * block + m], out=least)
    for j in range(run):
        out[j * block : j * block + m] |= inside[:m] & (h[j * block : j * block + m] == least)
    return out


def _least_only(h: np.ndarray, inside: np.ndarray, aligned: np.ndarray, block: int, run: int) -> np.ndarray:
    """Aligned places that are the least of `run` consecutive blocks of their text."""
    n = len(h)
    reach = block * (run - 1)
    out = np.zeros(n, bool)
    first = np.flatnonzero(aligned[: max(0, n - reach)] & inside[: max(0, n - reach)])
    if len(first):
        grid = h[first[:, None] + np.arange(run) * block]
        out[first + np.argmin(grid, axis=1) * block] = True
    return out


def anchors(words: Words, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, whether indexed) of the block windows that may meet, and each word's text."""
    run = blocks_in(window, block)
    h = words.runs(block)
    text = words.text_of_word()
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), h, np.zeros(0, bool), text
    at = np.arange(n)
    reach = block * run - 1
    last = np.minimum(at + reach, len(text) - 1)
    inside = (text[last] == text[:n]) & (at + reach < len(text))
    aligned = (at - words.bounds[text[:n]]) % block == 0
    probe = _selected(h, inside, block, run)
    index = _least_only(h, inside, aligned, block, run)
    place = np.flatnonzero(probe | index)
    return place, h[place], index[place], text


def _u(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a.astype(kind)).tobytes()


def _tasks(column: list, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column]) if column else np.zeros(0, kind)


def _split(bucket: np.ndarray, *arrays: np.ndarray):
    """(bucket, slices) for each bucket, in order of bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    arrays = [a[order] for a in arrays]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[a]), [x[a:b] for x in arrays]


def _group_bytes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(order of the rows by id and text, ids, texts), the last two in that order: words are numbered alike whenever a group is read."""
    ids = table["doc"].to_numpy()
    texts = [t.encode() for t in table["text"].to_pylist()]
    order = np.argsort(ids, kind="stable")
    if len(ids) and (ids[order][1:] == ids[order][:-1]).any():
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])))
    return order, ids[order], [texts[i] for i in order.tolist()]


def _heads(sorted_values: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, bool)


def _probe_group(table: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """A group's anchors: for each bucket the hashes with, for each, the smallest indexed document and the largest document, and a row for each document that asks."""
    _, ids, texts = _group_bytes(table)
    words = Words(texts)
    place, h, indexed, text = anchors(words, window, block)
    doc = ids[text[place]] if len(place) else np.zeros(0, np.int64)
    order = np.lexsort((~indexed, doc, h))
    h, doc, indexed = h[order], doc[order], indexed[order]
    keep = _heads(h) | np.concatenate([[True], doc[1:] != doc[:-1]]) if len(h) else np.zeros(0, bool)  # one row for each hash and document, indexed first
    h, doc, indexed = h[keep], doc[keep], indexed[keep]
    # Not all documents of a hash need to ask: the group keeps them, and asks once, with its smallest indexed and its largest document.
    head = np.flatnonzero(_heads(h))
    big = np.iinfo(np.int64).max
    low = np.minimum.reduceat(np.where(indexed, doc, big), head) if len(head) else np.zeros(0, np.int64)
    high = np.maximum.reduceat(doc, head) if len(head) else np.zeros(0, np.int64)
    h = h[head]
    group = table["grp"][0].as_py()
    rows = list(_split((h >> np.uint64(40)) % np.uint64(buckets), h, low, high))
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "grp": pa.array([group] * len(rows), pa.int64()), "h": pa.array([_u(x[0], "<u8") for _, x in rows], pa.binary()), "low": pa.array([_u(x[1], "<i8") for _, x in rows], pa.binary()), "high": pa.array([_u(x[2], "<i8") for _, x in rows], pa.binary())})


def _meet(table: pa.Table) -> pa.Table:
    """A bucket: the hashes that hit, for each group that asked."""
    groups = table["grp"].to_numpy()
    columns = [table[c].to_pylist() for c in ("h", "low", "high")]
    h, low, high = (_tasks(c, k) for c, k in zip(columns, ("<u8", "<i8", "<i8"), strict=True))
    group = np.repeat(groups, [len(x) // 8 for x in columns[0]])
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(_heads(h[order]))
    if not len(head):
        return pa.table({"grp": pa.array([], pa.int64()), "h": pa.array([], pa.binary())})
    hit = np.minimum.reduceat(low[order], head) < np.maximum.reduceat(high[order], head)
    take = order[np.repeat(hit, np.diff(np.append(head, len(h))))]
    rows = list(_split(group[take], h[take]))
    return pa.table({"grp": pa.array([g for g, _ in rows], pa.int64()), "h": pa.array([_u(x[0], "<u8") for _, x in rows], pa.binary())})


def _extend_group(docs: pa.Table, hits: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """Exact windows around a group's hits, by bucket: 96-bit hash, document and place; decided ones go to the group's own bucket -1."""
    void = pa.table({"bucket": pa.array([], pa.int64()), "grp": pa.array([], pa.int64()), "a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "doc": pa.array([], pa.binary()), "pos": pa.array([], pa.binary())})
    if not docs.num_rows or not hits.num_rows:
        return void
    _, ids, texts = _group_bytes(docs)
    words = Words(texts)
    found = np.unique(_tasks(hits["h"].to_pylist(), "<u8"))
    h = words.runs(block)
    n = len(words) - window + 1
    if not len(found) or n <= 0:
        return void
    where = np.searchsorted(found, h)
    hit = found[np.minimum(where, len(found) - 1)] == h
    # A window from s holds a hit if one starts in s .. s + window - block.
    seen = np.concatenate([[0], np.cumsum(hit)])
    text = words.text_of_word()
    s = np.arange(n)
    at = np.flatnonzero((seen[np.minimum(s + window - block + 1, len(h))] > seen[s]) & (text[:n] == text[window - 1 :]))
    a, b, doc = words.runs(window, 0)[at], words.runs(window, 1)[at], ids[text[at]]
    pos = at - words.bounds[text[at]]
    order = np.lexsort((doc, b, a))
    a, b, doc, pos, at = a[order], b[order], doc[order], pos[order], at[order]
    new = _heads(a) | _heads(b)
    head = np.flatnonzero(new)
    lowest = doc[head][np.cumsum(new) - 1] if len(head) else doc
    decided = doc > lowest
    group = docs["grp"][0].as_py()
    out = [(bucket, x) for bucket, x in _split((a[~decided] >> np.uint64(40)) % np.uint64(buckets), a[~decided], b[~decided] & np.uint64(0xFFFFFFFF), doc[~decided], at[~decided])]
    if decided.any():
        out.append((-1 - group, [np.zeros(0), np.zeros(0), np.zeros(0), np.sort(at[decided])]))
    return pa.table({"bucket": pa.array([k for k, _ in out], pa.int64()), "grp": pa.array([group] * len(out), pa.int64()), "a": pa.array([_u(x[0], "<u8") for _, x in out], pa.binary()), "b": pa.array([_u(x[1], "<u4") for _, x in out], pa.binary()), "doc": pa.array([_u(x[2], "<i8") for _, x in out], pa.binary()), "pos": pa.array([_u(x[3], "<u4") for _, x in out], pa.binary())})


def _decide(table: pa.Table) -> pa.Table:
    """A bucket: for each group the places (word numbers in the group) of windows that a smaller document has too."""
    groups = table["grp"].to_numpy()
    if table["bucket"][0].as_py() < 0:
        return pa.table({"grp": table["grp"], "pos": table["pos"]})
    columns = [table[c].to_pylist() for c in ("a", "b", "doc", "pos")]
    a, b, doc, pos = (_tasks(c, k) for c, k in zip(columns, ("<u8", "<u4", "<i8", "<u4"), strict=True))
    group = np.repeat(groups, [len(x) // 8 for x in columns[0]])
    order = np.lexsort((doc, b, a))
    a, b, doc, pos, group = a[order], b[order], doc[order], pos[order], group[order]
    new = _heads(a) | _heads(b)
    lowest = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else doc
    later = doc > lowest
    rows = list(_split(group[later], pos[later]))
    return pa.table({"grp": pa.array([g for g, _ in rows], pa.int64()), "pos": pa.array([_u(x[0], "<u4") for _, x in rows], pa.binary())})


def _cover(docs: pa.Table, places: pa.Table, window: int, with_text: bool) -> pa.Table:
    """Merge the windows of a group into the words to remove, and what is left of each row's text."""
    order, _, texts = _group_bytes(docs)
    lists = [t.split() for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = _tasks(places["pos"].to_pylist(), "<u4").astype(np.int64) if places.num_rows else np.zeros(0, np.int64)
    step = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    gone = np.cumsum(step)[:-1] > 0
    removed, kept = [], []
    for i, words in enumerate(lists):
        mask = gone[bounds[i] : bounds[i + 1]]
        r = int(mask.sum())
        removed.append(r)
        kept.append(b" ".join(words) if not r else b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g]))
    order = pa.array(order)
    out = {"row": docs["row"].take(order), "times": docs["times"].take(order), "n_words": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
    if with_text:
        out["kept_text"] = pa.array([k.decode() for k in kept], pa.string())
    return pa.table(out)


def sizes(chars: int) -> tuple[int, int]:
    """(characters in a group, characters for each bucket) of a table of so many characters."""
    grown = max(1.0, (chars / EVEN_CHARS) ** 0.5)
    return tuple(int(min(most, least * grown)) for least, most in (GROUP_CHARS, BUCKET_CHARS))


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, group_chars: int | None = None, bucket_chars: int | None = None, with_text: bool = True) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and, if asked for, kept_text for every row of docs.

    A null text has no words.  A null id counts as the smallest; rows with equal ids are one document's as far as "smaller" goes, and
    each is judged by its own words.  A text of fewer than `window` words keeps all.  Ids are integers.  Where ids are
    null or repeated, equal rows are worked on once, and rows of one id are dealt out by their texts.
    """
    if blocks_in(window, block) < 1:
        raise ValueError("a window must hold a whole block wherever the blocks begin")
    table = docs.groupBy(F.col(key).alias("doc")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).alias("chars"))
    seen = table.agg(F.sum("chars").alias("chars"), F.max("rows").alias("most"), F.count_if(F.col("doc").isNull()).alias("nulls")).first()
    chars = seen["chars"] or 0
    even = sizes(chars)
    groups, buckets = max(1, -(-chars // (group_chars or even[0]))), max(1, -(-chars // (bucket_chars or even[1])))
    width = max(shuffle_width(docs.sparkSession), -(-chars // TASK_CHARS))
    rows = docs.select(F.col(key).alias("row"), text_or_empty(text).alias("text"))
    repeated = (seen["most"] or 0) > 1
    rows = rows.groupBy("row", "text").agg(F.count(F.lit(1)).alias("times")) if repeated else rows.withColumn("times", F.lit(1).cast("long"))
    dealt = F.xxhash64("row", "text") if repeated or seen["nulls"] else F.xxhash64("row")
    rows = rows.select(F.pmod(dealt, F.lit(groups)).alias("grp"), F.coalesce(F.col("row").cast("long"), F.lit(SMALL)).alias("doc"), "row", "times", "text").repartition(width, "grp")
    kind = docs.schema[key].dataType.simpleString()
    anchored = rows.groupBy("grp").applyInArrow(lambda t: _probe_group(t, window, block, buckets), "bucket long, grp long, h binary, low binary, high binary")
    hits = anchored.repartition(width, "bucket").groupBy("bucket").applyInArrow(_meet, "grp long, h binary")
    windows = rows.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(lambda d, h: _extend_group(d, h, window, block, buckets), "bucket long, grp long, a binary, b binary, doc binary, pos binary")
    places = windows.repartition(width, "bucket").groupBy("bucket").applyInArrow(_decide, "grp long, pos binary")
    out = rows.groupBy("grp").cogroup(places.groupBy("grp")).applyInArrow(lambda d, p: _cover(d, p, window, with_text), f"row {kind}, times long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    if repeated:
        out = out.withColumn("times", F.explode(F.sequence(F.lit(1), "times")))
    return out.drop("times").withColumnRenamed("row", key)


#: DuckDB on small tables: the windows spelled out.
SQL = r"""
WITH cut AS (SELECT doc_id, string_split_regex(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w FROM documents),
numbered AS (SELECT doc_id, w, len(w) AS n, unnest(range(greatest(len(w) - 49, 0))) AS pos FROM cut),
windows AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY array_to_string(list_slice(w, pos + 1, pos + 50), ' ')) AS low FROM numbered),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM windows, (SELECT unnest(range(50)) AS k) WHERE low < doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM cut),
kept AS (
  SELECT w.doc_id, count(*) FILTER (WHERE w.word <> '') AS n_words,
    coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.pos = c.pos GROUP BY w.doc_id)
SELECT k.doc_id, k.n_words, coalesce(g.n, 0) AS n_removed, sha256(k.text) AS kept_sha256 FROM kept k LEFT JOIN gone g ON k.doc_id = g.doc_id
"""
