"""Caches, run control and reports over keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAMILY_UNKNOWN = "other"


def cache_key(version, sha256, signature):
    return F.sha2(F.concat_ws("|", version, sha256, signature), 256)


def cache_lookup(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): wanted rows with the cached payload, and those without; corrupt payloads (null) count as missing."""
    good = cache.filter("payload IS NOT NULL").dropDuplicates(keys)
    return wanted.join(good, keys), wanted.join(good.select(*keys), keys, "left_anti")


def prune(cache: DataFrame, keep: int, *, order: list[str]) -> DataFrame:
    """The `keep` entries used last; order names the columns, the latest last.  Only the top is sorted (a bounded heap in each task)."""
    return cache.orderBy(*[F.col(c).desc() for c in order]).limit(keep)


def pruned_per_group(cache: DataFrame, keep: int, *, group: list[str], order: list[str]) -> DataFrame:
    walk = W.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    return cache.withColumn("nth", F.row_number().over(walk)).filter(F.col("nth") <= keep).drop("nth")


def cache_summary(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("payload_bytes"))


def run_counts(works: DataFrame) -> DataFrame:
    """Counts for each run over its included works: total, ready, review, blocked."""
    return works.filter(F.coalesce("include", F.lit(True))).groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("readiness") == r).alias(n) for r, n in (("ready", "ready"), ("review_required", "review"), ("blocked", "blocked"))])


def manifest(docs: DataFrame) -> DataFrame:
    """One row: documents, distinct works (key or hash), failed, pages by method."""
    pages = lambda m: F.coalesce(F.sum(F.size(F.filter("pages", lambda p: p["method"] == m))), F.lit(0)).alias(f"{m}_pages")
    work = F.coalesce(F.nullif(F.col("canonical_key"), F.lit("")), F.col("sha256"))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(work).alias("works"), F.count_if(F.col("status") == "failed").alias("failed"), *[pages(m) for m in ("native", "ocr", "skipped", "unavailable")])


def work_status(include, readiness):
    """Status of a work in a list: excluded goes before readiness."""
    return F.when(~F.coalesce(include, F.lit(True)), "excluded").otherwise(readiness)


def family_groups(works: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by label of family; labels: family, label, position.  Families without a label come last."""
    named = works.join(F.broadcast(labels), "family", "left")
    return named.groupBy(F.coalesce("label", F.lit(FAMILY_UNKNOWN)).alias("label"), F.coalesce("position", F.lit(999)).alias("position")).agg(F.count(F.lit(1)).alias("works"))


def latest_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), "run_id").limit(limit)


def recovered(runs: DataFrame, *, interrupted: tuple[str, ...] = ("queued", "running"), message: str = "interrupted") -> DataFrame:
    """Runs that stood unfinished become failed, with a message unless they have one, and their revision grows."""
    open_run = F.col("status").isin(*interrupted)
    return runs.withColumn("error_message", F.when(open_run, F.coalesce("error_message", F.lit(message))).otherwise(F.col("error_message"))).withColumn("revision", F.when(open_run, F.col("revision") + 1).otherwise(F.col("revision"))).withColumn("status", F.when(open_run, "failed").otherwise(F.col("status")))
