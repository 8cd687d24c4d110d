"""From resolved records to the ordered list of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibspark.functions.fold import match_text
from bibspark.functions.text import letters
from bibspark.operators.resolve import resolve
from bibspark.operators.rounds import checkpointed
from bibspark.plans import render as layouts


def field_maps(fields: DataFrame) -> DataFrame:
    """(record_id, fields map<field_id, array<string>>)."""
    return fields.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "values"))).alias("fields"))


def year_letters(rows: DataFrame, *, group: list[str], order: list[str], eligible: str = "ready", name: str = "year_suffix") -> DataFrame:
    """Letters a, b, ... within groups of more than one eligible row, in the given order; other rows get an empty string.

    Ineligible rows are dealt out by their order columns, so they don't gather in one task.
    """
    able = F.coalesce(F.col(eligible), F.lit(False))
    spread = [F.when(able, F.lit(0)).otherwise(F.xxhash64(*order)), able]
    keys = W.partitionBy(*spread, *group)
    n = F.count(F.lit(1)).over(keys)
    nth = F.row_number().over(keys.orderBy(*order))
    return rows.withColumn(name, F.when(able & (n > 1), letters(nth - 1)).otherwise(F.lit("")))


def with_sort_keys(records: DataFrame, *, fallback: str | None = None) -> DataFrame:
    """Adds sort_name, sort_title (folded), sort_year and authorship.  Records without a schema sort by the fallback column, lower case."""
    view = layouts.Fields(F.col("fields"))
    known = F.col("schema_id").isNotNull() if "schema_id" in records.columns else F.lit(True)
    other = F.lower(F.col(fallback)) if fallback else F.lit("")
    return records.withColumn("sort_name", F.when(known, match_text(layouts.sort_responsibility(view))).otherwise(other)).withColumn("sort_title", F.when(known, match_text(layouts.sort_title(view))).otherwise(F.lit(""))).withColumn("sort_year", F.when(known, layouts.year_value(view)).otherwise(F.lit(""))).withColumn("authorship", layouts.authorship(view))


def compile_references(ledger: DataFrame, types: DataFrame, catalog, *, access_date: str, headers: DataFrame | None = None, overrides: DataFrame | None = None, excluded: DataFrame | None = None, all_names: bool = True, strict: bool = True, families: list[str] | None = None) -> DataFrame:
    """Resolve, letter and render; one row per record with its sort keys, to be ordered by sort_name, sort_title, sort_year, record_id.

    families names the layouts that can occur (without it the catalog's), which keeps the plan small.
    headers (record_id, source_name, include, status) says which records count; a failed or left-out record has no reference.
    """
    fields, records = resolve(ledger, types, catalog, access_date=access_date, overrides=overrides, excluded=excluded, strict=strict)
    rows = records.join(field_maps(fields), "record_id", "left").withColumn("fields", F.coalesce("fields", F.expr("cast(map() as map<string,array<string>>)")))
    if headers is not None:
        rows = rows.join(headers.select("record_id", "source_name", "include", "status"), "record_id", "left")
    else:
        rows = rows.withColumn("source_name", F.col("record_id")).withColumn("include", F.lit(True)).withColumn("status", F.lit("processed"))
    usable = F.coalesce("include", F.lit(True)) & (F.coalesce("status", F.lit("processed")) != "failed")
    rows = with_sort_keys(rows, fallback="source_name").withColumn("eligible", F.col("ready") & usable)
    rows = year_letters(rows, group=["authorship", "sort_year"], order=["sort_name", "sort_title", "sort_year", "record_id"], eligible="eligible")
    families = families or sorted({s["family"] for s in catalog.schemas} & set(layouts.LAYOUTS))
    rendered = layouts.render(rows.withColumn("was_ready", F.col("ready")).withColumn("ready", F.col("eligible")), access_date=access_date, families=families, all_names=all_names, policy=catalog.policy)
    return rendered.withColumn("ready", F.col("was_ready")).drop("was_ready")


def numbered(rows: DataFrame, *, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Places 1, 2, ... of the rows of each group in order, without a task that holds a whole group.

    Ranges of the whole order are numbered by themselves; each range then adds how many rows of the group lie in ranges before it.
    The number of ranges, so of the counts that are summed up, is that of the shuffle partitions.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(width, *group, *order).withColumn("_part", F.spark_partition_id()))  # a range is where it was cut once
    counts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = ranged.withColumn("_own", F.row_number().over(W.partitionBy("_part", *group).orderBy(*order)))
    return own.join(before, [*group, "_part"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("sort_name", "sort_title", "sort_year", "record_id")
