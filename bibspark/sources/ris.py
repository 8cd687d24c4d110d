"""RIS files, natively: a file is cut into records where they end, and each record is read inside its own row, so nothing is shuffled.  Values are normalised in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.functions.fold import clean_of

TAG = r"(?s)^\s*([A-Z0-9]{2})\s*-\s?(.*)$"
LINE_END = r"\r\n|\n|\r"
RECORD_END = r"(?m)^[ \t]*ER[ \t]*-[^\r\n]*$"
ANY_TAG = r"(?m)^[ \t]*[A-Z0-9]{2}[ \t]*-"


def files(spark: SparkSession, directory: str, *, recursive: bool = False) -> DataFrame:
    """(path, text) of .ris files in any case."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[rR][iI][sS]").load(directory)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "windows-1252"))
    return read.select("path", F.regexp_replace(text, "^﻿", "").alias("text"))


def _by_tag(batches):
    """Records' (tag, value) pairs as maps of clean values; those that hold nothing are left out."""
    for batch in batches:
        maps = []
        for told in batch.column("told").to_pylist():
            fields: dict[str, list[str]] = {}
            for pair in told:
                if value := clean_of(pair["value"] or ""):
                    fields.setdefault(pair["tag"], []).append(value)
            maps.append(list(fields.items()))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("entry_no"), pa.array(maps, pa.map_(pa.string(), pa.list_(pa.string())))], names=["path", "entry_no", "fields"])


def parse(sources: DataFrame) -> DataFrame:
    """(path, entry_no, entry_type, entry_key, fields map<string, array<string>>, error) of files (path, text).

    ER ends a record.  A line without a tag goes on with the one before, after a space.  A file whose last record doesn't end, or without any
    record, gives one row with its error.
    """
    parts = F.split(F.coalesce("text", F.lit("")), RECORD_END, -1)
    cut = sources.select("path", F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda r: r.rlike(ANY_TAG)).alias("records"), F.element_at(parts, -1).rlike(ANY_TAG).alias("open"))
    wrong = F.when(F.col("open"), "a record doesn't end").when(F.size("records") == 0, "no record")
    cut = cut.select("path", "records", wrong.alias("error"))
    errors = cut.filter("error IS NOT NULL").select("path", F.lit(None).cast("int").alias("entry_no"), F.lit(None).cast("string").alias("entry_type"), F.lit(None).cast("string").alias("entry_key"), F.lit(None).cast("map<string,array<string>>").alias("fields"), "error")
    rows = cut.filter("error IS NULL").select("path", F.posexplode("records").alias("at", "record"))
    line = F.transform(F.split("record", LINE_END), lambda x: F.struct(F.regexp_extract(x, TAG, 1).alias("tag"), F.when(x.rlike(TAG), F.trim(F.regexp_extract(x, TAG, 2))).otherwise(F.trim(x)).alias("value")))
    none = F.expr("cast(array() as array<struct<tag:string,value:string>>)")
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["tag"].alias("tag"), F.trim(F.concat_ws(" ", last(acc)["value"], x["value"])).alias("value"))))
    told = F.aggregate(line, none, lambda acc, x: F.when(x["tag"] != "", F.concat(acc, F.array(x))).when((x["value"] != "") & (F.size(acc) > 0), longer(acc, x)).otherwise(acc))
    rows = rows.select("path", (F.col("at") + 1).cast("int").alias("entry_no"), told.alias("told")).mapInArrow(_by_tag, "path string, entry_no int, fields map<string,array<string>>")
    first = lambda *tags: F.coalesce(*[F.try_element_at(F.try_element_at(F.col("fields"), F.lit(t)), F.lit(1)) for t in tags])
    good = rows.select("path", "entry_no", F.upper(F.coalesce(first("TY"), F.lit("GEN"))).alias("entry_type"), F.coalesce(first("ID", "AN"), F.concat(F.lit("record-"), F.col("entry_no").cast("string"))).alias("entry_key"), "fields", F.lit(None).cast("string").alias("error"))
    return good.unionByName(errors)
