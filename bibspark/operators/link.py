"""Linkage of documents with structured entries, and clustering of variants of one work."""

from __future__ import annotations

import difflib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibspark.functions.arrows import mapped

LINK_RATIO = 0.92
VARIANT_RATIO = 0.96
# Ranks of status and of kind of variant.
STATUS_RANK = {"processed": 4, "processed_with_warnings": 3, "review_required": 2, "failed": 1}
VARIANT_RANK = {"publisher_original": 5, "institutional_repository": 4, "bibtex": 4, "ris": 4, "scanned": 3, "browser_print": 2, "unknown": 1}
SECONDARY = ("browser_print", "scanned")


def title_ratio_of(left: str, right: str) -> float:
    """Ratio of difflib's matcher in this order of arguments (it isn't symmetric)."""
    return difflib.SequenceMatcher(None, left, right).ratio()


@lru_cache(256)
def _pairs_of_letters(text: str) -> Counter:
    return Counter(zip(text, text[1:], strict=False))


def text_ratio_of(left: str, right: str) -> float:
    """title_ratio_of for long texts: difflib's default passes over frequent letters from 200 on, which are nearly all.  0 where LINK_RATIO is out of reach.

    With m matched letters of la + lb there are at most la + lb - 2m + 1 matched runs, so at least m - (la + lb - 2m + 1) pairs of neighbours are in common.
    """
    both = len(left) + len(right)
    m = LINK_RATIO * both / 2
    if (_pairs_of_letters(left) & _pairs_of_letters(right)).total() < m - (both - 2 * m + 1) - 1e-6:
        return 0.0
    return difflib.SequenceMatcher(None, left, right, autojunk=False).ratio()


title_ratio = mapped(title_ratio_of, pa.float64(), size=lambda _: 16)
text_ratio = mapped(text_ratio_of, pa.float64(), size=lambda _: 16)


def ratio_bound(left, right):
    """No ratio exceeds 2 * shorter / (shorter + longer): a native test that spares most of the Python calls."""
    a, b = F.length(left), F.length(right)
    return F.try_divide(2 * F.least(a, b), a + b)


def letters_bound(left, right):
    """Tighter native bound: letters in common count at most as often as both have them."""
    parts = [F.least(F.length(left) - F.length(F.replace(left, F.lit(c), F.lit(""))), F.length(right) - F.length(F.replace(right, F.lit(c), F.lit("")))) for c in "abcdefghijklmnopqrstuvwxyz0123456789 "]
    return F.try_divide(2 * sum(parts[1:], parts[0]), F.length(left) + F.length(right))


def candidate_pairs(docs: DataFrame, entries: DataFrame, *, ratio=title_ratio) -> DataFrame:
    """Scored pairs (doc_id, entry_id, ord, method, score).  docs: doc_id, doi_key, title_key, year; entries: entry_id, ord, doi_key, title_key, year.

    Equal DOIs link at 1.0.  Else titles link from a ratio of 0.92 where the years don't differ.  Titles meet by blocks that no
    such pair can miss: a ratio of 0.92 leaves at most 8 % of both titles unmatched, so of nine equal parts of the document's title one stands whole
    in the entry's within the shift that those unmatched letters allow; parts join by equality and year goes into no key, as it may be absent.
    """
    doi = docs.filter("doi_key <> ''").join(entries.filter("doi_key <> ''").select("entry_id", "ord", F.col("doi_key").alias("entry_doi")), F.col("doi_key") == F.col("entry_doi")).select("doc_id", "entry_id", "ord", F.lit("doi").alias("method"), F.lit(1.0).alias("score"))
    left = docs.filter("title_key <> ''").select("doc_id", F.col("title_key").alias("doc_title"), F.col("year").alias("doc_year"))
    right = entries.filter("title_key <> ''").select("entry_id", "ord", F.col("title_key").alias("entry_title"), F.col("year").alias("entry_year"))
    met = blocked(left, right, "doc_title", "entry_title", ["doc_id", "entry_id"], LINK_RATIO)
    met = met.filter((F.col("doc_year").isNull()) | (F.col("entry_year").isNull()) | (F.col("doc_year") == F.col("entry_year")))
    scored = met.withColumn("score", ratio("doc_title", "entry_title")).filter(F.col("score") >= LINK_RATIO)
    return doi.unionByName(scored.select("doc_id", "entry_id", "ord", F.lit("title").alias("method"), "score"))


def blocked(left: DataFrame, right: DataFrame, a: str, b: str, keys: list[str], ratio: float) -> DataFrame:
    """Pairs of rows whose texts could reach the ratio.

    With matched letters m and ratio 2m/(la+lb) >= r, the unmatched ones are la+lb-2m <= (1-r)(la+lb), so with k = ceil of that limit + 1
    equal parts of the left text, one lies whole inside a matched run, at a place shifted by at most that limit.  Signature: part number's text;
    the right text offers all its substrings of the parts' lengths within the shift.  Short texts have few parts, so k is capped at the text's length.
    """
    la = F.length(a)
    # Texts that are too long or short for every right one leave before they are cut into parts.
    ends = right.agg(F.min(F.length(b)).alias("shortest"), F.max(F.length(b)).alias("longest"))
    left = left.join(F.broadcast(ends), (la >= F.floor(F.col("shortest") * ratio / (2 - ratio))) & (la <= F.ceil(F.col("longest") * (2 - ratio) / ratio))).drop("shortest", "longest")
    slack = F.ceil((1 - ratio) * 2 * la / ratio)  # of the longest text that may match
    parts = F.greatest(F.lit(1), F.least(la, slack + 1)).cast("int")
    lefts = left.withColumn("parts", parts).withColumn("slack", slack.cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    begin = F.floor(F.col("p") * la / F.col("parts")).cast("int")
    end = F.floor((F.col("p") + 1) * la / F.col("parts")).cast("int")
    lefts = lefts.withColumn("begin", begin).withColumn("size", end - begin).withColumn("token", F.substring(a, F.col("begin") + 1, F.col("size")))
    lb = F.length(b)
    # The right side offers every substring of each size that left texts of fitting lengths can have.
    low, high = F.floor(lb * ratio / (2 - ratio)).cast("int"), F.ceil(lb * (2 - ratio) / ratio).cast("int")
    size = lambda n: F.floor(n / F.least(F.greatest(n, F.lit(1)), F.ceil((1 - ratio) * 2 * n / ratio) + 1)).cast("int")
    sizes = F.flatten(F.transform(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1))), lambda n: F.array(size(n), size(n) + 1)))
    rights = right.withColumn("size_r", F.explode(F.array_distinct(sizes))).filter(F.col("size_r") <= lb).withColumn("at", F.explode(F.sequence(F.lit(0), lb - F.col("size_r")))).withColumn("token_r", F.substring(b, F.col("at") + 1, F.col("size_r")))
    met = lefts.join(rights, (F.col("token") == F.col("token_r")) & (F.col("size") == F.col("size_r"))).filter(F.abs(F.col("begin") - F.col("at")) <= F.col("slack"))
    met = met.dropDuplicates(keys).drop("parts", "slack", "p", "begin", "size", "token", "size_r", "at", "token_r")
    return met.filter((ratio_bound(a, b) >= ratio) & (letters_bound(a, b) >= ratio))


def best_match(pairs: DataFrame) -> DataFrame:
    """Each document's own best entry: DOI before title, then the higher ratio, then the earlier entry."""
    order = W.partitionBy("doc_id").orderBy((F.col("method") == "doi").desc(), F.when(F.col("method") == "doi", 0.0).otherwise(F.col("score")).desc(), "ord")
    return pairs.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def assign(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment: documents in order of path take their best entry of those left; order: doc_id, doc_ord.

    Each round gives every document its best remaining entry and lets stand the pairs whose entry no earlier unsettled document
    could still take; so the result is that of the sequential walk, in rounds that shrink the pairs.
    """
    from bibspark.operators.rounds import checkpointed

    left = checkpointed(pairs.join(order, "doc_id"))
    taken = None
    while True:
        best = W.partitionBy("doc_id").orderBy((F.col("method") == "doi").desc(), F.when(F.col("method") == "doi", 0.0).otherwise(F.col("score")).desc(), "ord")
        ranked = left.withColumn("nth", F.row_number().over(best)).withColumn("earliest", F.min("doc_ord").over(W.partitionBy("entry_id")))
        settled = checkpointed(ranked.filter("nth = 1 AND earliest = doc_ord").select("doc_id", "entry_id", "method", "score"))
        if settled.isEmpty():
            return taken if taken is not None else settled
        taken = settled if taken is None else taken.unionByName(settled)
        left = checkpointed(left.join(settled.select("doc_id"), "doc_id", "left_anti").join(settled.select("entry_id"), "entry_id", "left_anti"))


def variant_pairs(docs: DataFrame) -> DataFrame:
    """Edges (a, b) between documents of one work, a > b; docs: doc_id (long), sha256, canonical_key, doi_key, title_key, year_key, family_key, stem_key, variant_type.

    Equal hash, key, DOI, or title and year; with a print or scan on one side and the same year also equal stems, or equal first surnames
    with titles of a ratio of 0.96.  Equal values chain each document to the least of its group, so a group of n gives n - 1 edges.
    """
    titled = (F.col("title_key") != "") & (F.col("year_key") != "")

    def chain(rows: DataFrame, *keys: str) -> DataFrame:
        low = rows.groupBy(*keys).agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        return rows.join(low, list(keys)).filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b")

    edges = chain(docs.filter("sha256 IS NOT NULL"), "sha256")
    edges = edges.unionByName(chain(docs.filter("canonical_key <> '' AND canonical_key <> 'unknown'"), "canonical_key")).unionByName(chain(docs.filter("doi_key <> ''"), "doi_key")).unionByName(chain(docs.filter(titled), "title_key", "year_key"))
    # Stems: a secondary variant links with every document of its stem and year, so one secondary carries the whole group.
    second = F.col("variant_type").isin(*SECONDARY)
    stems = docs.filter(titled)
    hubs = stems.filter(second).groupBy("year_key", "stem_key").agg(F.min("doc_id").alias("hub"))
    edges = edges.unionByName(stems.join(hubs, ["year_key", "stem_key"]).filter("doc_id <> hub").select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b")))
    # Fuzzy titles: one row for each different title of a surname and year.
    fuzzy = docs.filter(titled & (F.col("family_key") != "")).groupBy("year_key", "family_key", "title_key").agg(F.min(F.when(second, F.col("doc_id"))).alias("print"), F.min("doc_id").alias("any"))
    x, y = fuzzy.filter("print IS NOT NULL"), fuzzy.select("year_key", "family_key", F.col("title_key").alias("other_title"), F.col("any").alias("other"))
    pairs = x.join(y, ["year_key", "family_key"]).filter((F.col("title_key") != F.col("other_title")) & (ratio_bound("title_key", "other_title") >= VARIANT_RATIO) & (letters_bound("title_key", "other_title") >= VARIANT_RATIO))
    first = F.col("print") < F.col("other")
    near = pairs.withColumn("l", F.when(first, F.col("title_key")).otherwise(F.col("other_title"))).withColumn("r", F.when(first, F.col("other_title")).otherwise(F.col("title_key"))).filter(title_ratio("l", "r") >= VARIANT_RATIO)
    return edges.unionByName(near.select(F.greatest("print", "other").alias("a"), F.least("print", "other").alias("b"))).distinct()


def winners(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with cluster, winner_id, include and cluster_key; labels: (vertex, component) of the edges.

    The winner has the greatest (status rank, variant rank, filled fields, native pages), then the earliest place.  Copies of the winner's
    file stay included.  docs need status, variant_type, n_filled, native_pages, ord, sha256, canonical_key.
    """
    rank = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col(c)), F.lit(0))
    rows = docs.join(labels, F.col("doc_id") == F.col("vertex"), "left").withColumn("cluster", F.coalesce("component", "doc_id")).drop("vertex", "component")
    score = F.struct(rank(STATUS_RANK, "status"), rank(VARIANT_RANK, "variant_type"), F.col("n_filled"), F.col("native_pages"), -F.col("ord"))
    best = rows.groupBy("cluster").agg(F.max_by(F.struct("doc_id", "sha256", "canonical_key"), score).alias("w"), F.count(F.lit(1)).alias("members"))
    return rows.join(best, "cluster").select(*docs.columns, "cluster", F.col("members"), F.col("w.doc_id").alias("winner_id"), (F.col("sha256") == F.col("w.sha256")).alias("include"), F.col("w.canonical_key").alias("cluster_key"))
