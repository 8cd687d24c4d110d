"""Inventory of input files, its fingerprint, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Types of sources and the globs of their names, in any case.
TYPES = {"pdf": "*.[pP][dD][fF]", "bibtex": "*.{[bB][iI][bB],[bB][iI][bB][tT][eE][xX]}", "ris": "*.[rR][iI][sS]"}


def inventory(spark: SparkSession, directory: str, *, recursive: bool = False) -> DataFrame:
    """(relative_path, source_type, size_bytes, sha256) of the PDF, BibTeX and RIS files."""
    out = None
    for kind, glob in TYPES.items():
        read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(directory)
        base = directory.rstrip("/") + "/"
        rows = read.select(F.regexp_replace("path", "^.*?" + _literal(base), "").alias("relative_path"), F.lit(kind).alias("source_type"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: n_files, total_bytes, fingerprint (hash over path, type and hash of every file in order of the lower-case path).

    The order is global but what is ordered is a line for each file, not its content.
    """
    line = F.concat("relative_path", F.char(F.lit(0)), "source_type", F.char(F.lit(0)), "sha256", F.char(F.lit(0)))
    rows = files.select(F.struct(F.lower("relative_path").alias("k"), F.col("relative_path").alias("p"), line.alias("l")).alias("r"), "size_bytes")
    out = rows.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.array_sort(F.collect_list("r")).alias("rs"))
    return out.select("n_files", "total_bytes", F.sha2(F.array_join(F.transform("rs", lambda r: r["l"]), ""), 256).alias("fingerprint"))


def changes(before: DataFrame, after: DataFrame, *, key: str = "relative_path", compared: tuple[str, ...] = ("sha256", "size_bytes", "source_type")) -> DataFrame:
    """(key, change): added, removed or modified; unchanged rows are left out.  Keys are unique in each table; a null key matches none."""
    a = before.select(F.col(key).alias("k"), F.struct(*compared).alias("was"))
    b = after.select(F.col(key).alias("k2"), F.struct(*compared).alias("now"))
    both = a.join(b, F.col("k") == F.col("k2"), "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return both.select(F.coalesce("k", "k2").alias(key), change.alias("change")).filter("change IS NOT NULL")
