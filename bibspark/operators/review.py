"""Human review: merging structured metadata, stored corrections, suggestions, and keyed tables without a MERGE target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibspark.functions.fold import clean, correction_key

# Fixed values.
MERGED_FIELDS = ("title", "journal", "place", "year", "publication_month", "volume", "issue", "pages", "article_number", "doi", "url", "institution", "degree", "program", "publisher", "total_pages", "corporate_author", "department")
COMPARED_FIELDS = ("title", "journal", "year", "volume", "issue", "pages", "article_number", "doi")
MEMORABLE_FIELDS = ("authors", "title", "journal", "place", "institution", "degree", "program", "department", "publisher", "corporate_author")


def plain_key(c: Column) -> Column:
    """Lower case, dashes as hyphens, single spaces: the comparison of conflicting values."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "–—", "--"), r"(?U)\s+", " "))


def merge_structured(docs: DataFrame, entries: DataFrame, key: str, *, fields: tuple[str, ...] = MERGED_FIELDS, compared: tuple[str, ...] = COMPARED_FIELDS) -> DataFrame:
    """docs with the linked entry's values over their own, and the flags applied and conflict (a compared field that both state differs)."""
    have = [f for f in fields if f in docs.columns and f in entries.columns]
    own = docs.alias("d").join(entries.select(key, *[F.col(f).alias(f"_{f}") for f in have], F.lit(True).alias("_applied")).alias("e"), key, "left")
    differs = [F.coalesce((F.col(f"_{f}") != "") & (F.col(f) != "") & (plain_key(F.col(f"_{f}")) != plain_key(F.col(f))), F.lit(False)) for f in have if f in compared]
    conflict = differs[0] if differs else F.lit(False)
    for d in differs[1:]:
        conflict = conflict | d
    out = own.withColumn("conflict", conflict).withColumn("applied", F.coalesce("_applied", F.lit(False)))
    for f in have:
        out = out.withColumn(f, F.coalesce(F.nullif(F.col(f"_{f}"), F.lit("")), F.col(f)))
    return out.drop("_applied", *[f"_{f}" for f in have])


def upserted(old: DataFrame, new: DataFrame, keys: list[str], *, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows in place of those with the same keys; keep_first columns keep the old row's value where it isn't null.

    Of several new rows with one key the last by the column ord stands, if there is one.
    """
    order = F.col("ord").desc() if "ord" in new.columns else F.lit(1)
    last = new.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("nth = 1").drop("nth")
    if keep_first:
        was = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep_first])
        last = last.join(was, keys, "left")
        for c in keep_first:
            last = last.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def overlay(docs: DataFrame, corrections: DataFrame, *, key: str = "sha256") -> DataFrame:
    """(key, field_name, value, corrected) for the stored corrections of known documents; a null value clears its field."""
    return corrections.join(docs.select(key).distinct(), key, "left_semi").select(key, "field_name", F.col("replacement_value").alias("value"), F.lit(True).alias("corrected"))


def correction_candidates(changes: DataFrame) -> DataFrame:
    """Reusable corrections of (field_name, source_value, replacement_value, document_type): remembered fields, at least three signs, a change that folding doesn't undo."""
    rows = changes.filter(F.col("field_name").isin(*MEMORABLE_FIELDS)).withColumn("source_value", clean("source_value")).withColumn("replacement_value", clean("replacement_value")).filter("source_value IS NOT NULL AND replacement_value IS NOT NULL AND length(source_value) >= 3")
    rows = rows.withColumn("source_key", correction_key("source_value")).withColumn("replacement_key", correction_key("replacement_value"))
    return rows.filter("source_key <> replacement_key")


def confirmed(candidates: DataFrame, *, order: str = "ts") -> DataFrame:
    """One row for each (field, source key, replacement key, type): confirmation_count, and the values last confirmed."""
    keys = ["field_name", "source_key", "replacement_key", "document_type"]
    return candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("confirmation_count"), F.max_by("replacement_value", order).alias("replacement_value"), F.max(order).alias("updated"))


def suggestions(values: DataFrame, memory: DataFrame) -> DataFrame:
    """(doc_id, field_name, suggestions) for values (doc_id, field_name, source_key, document_type); the most confirmed first, then the latest."""
    met = values.join(memory, ["field_name", "source_key", "document_type"])
    listed = F.array_sort(F.collect_list(F.struct((-F.col("confirmation_count")).alias("rank"), (-F.col("updated").cast("double")).alias("age"), F.col("replacement_value").alias("value"))))
    return met.groupBy("doc_id", "field_name").agg(F.transform(listed, lambda s: s["value"]).alias("suggestions"))


def reviewed_values(text: Column, *, repeatable: bool) -> Column:
    """The values that a reviewer typed: of a list one a line, semicolons being allowed too; no text has none."""
    whole = F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))
    parts = F.transform(F.split(whole, r"(?U)(?:\r?\n)+|\s*;\s*"), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")) if repeatable else F.array(whole)
    return F.coalesce(F.when(whole.isNotNull(), F.filter(parts, lambda v: v != "")), F.expr("cast(array() as array<string>)"))


def typed_text(values: Column) -> Column:
    """A list of values as a reviewer sees it, one a line."""
    return F.array_join(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), "\n")


def reviewed_changes(ledger: DataFrame, overrides: DataFrame, excluded: DataFrame) -> DataFrame:
    """(record_id, field_id, replacement_value): what review has decided on each record, to be stored.

    Values typed by a reviewer in their order, one a line; null for fields that were cleared; the schema where it was chosen, as
    __schema_id__.
    """
    typed = ledger.filter("method = 'api_review'").groupBy("record_id", "field_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("sequence", F.lit(10_000)).alias("at"), "value"))).alias("v"))
    typed = typed.select("record_id", "field_id", F.array_join(F.transform("v", lambda x: x["value"]), "\n").alias("replacement_value"))
    cleared = excluded.join(typed.select("record_id", "field_id"), ["record_id", "field_id"], "left_anti").select("record_id", "field_id", F.lit(None).cast("string").alias("replacement_value"))
    chosen = overrides.filter("schema_override IS NOT NULL").select("record_id", F.lit("__schema_id__").alias("field_id"), F.col("schema_override").alias("replacement_value"))
    return typed.unionByName(cleared).unionByName(chosen)
