"""Iteration: checkpoints in the shared folder, and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where none is set and all runs in one process.

    A machine's own folder is no use to other machines, so without the setting a cluster's master is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="bibspark-")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage, in the shared folder; spark.cleaner.referenceTracking.cleanCheckpoints says whether files go with their table."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join each vertex's larger (or smaller) neighbours to its least neighbour (itself included); no list of neighbours is gathered."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for each vertex of the edges (a, b); component is its component's least vertex.

    Large-star and small-star rounds until nothing changes: labels only ever fall, a round costs a few shuffles of the edges
    that are left, and the number of rounds grows with the logarithm of a component's size.  Each round's edges are cut
    loose.  A hub's edges meet one row of its least neighbour, which a skewed join splits.  Null ends and loops are left
    out; repeated edges are no matter.
    """
    edges = checkpointed(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        edges = checkpointed(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    labels = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select("b").distinct().select(F.col("b").alias("a"), F.col("b").alias("component"))
    return labels.unionByName(roots).groupBy("a").agg(F.min("component").alias("component")).withColumnRenamed("a", "vertex")
