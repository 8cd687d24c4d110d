"""The candidate ledger: one row for each value that a source states for a field of a record.

Columns: record_id, field_id, value, normalized_value, source_format, source_file, source_record_id, method, confidence,
page_number, raw_field_name, sequence, ord.  ord is the order of appearance within a record and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibspark.functions.fold import clean, title_key

COLUMNS = ["record_id", "field_id", "value", "normalized_value", "source_format", "source_file", "source_record_id", "method", "confidence", "page_number", "raw_field_name", "sequence", "ord"]
HUMAN = ("api_review", "review_memory_exact")
DEDUP_KEY = ["record_id", "field_id", "normalized_value", "source_format", "source_file", "source_record_id", "sequence"]

# Names of fields in structured sources and the ledger's names for them.
BIBTEX_FIELDS = {
    "title": "title", "subtitle": "subtitle", "editor": "other_responsibility", "booktitle": "host_title", "journal": "periodical_title", "journaltitle": "periodical_title", "year": "publication_year", "date": "publication_date",
    "month": "publication_month", "volume": "volume", "number": "issue", "issue": "issue", "pages": "article_pages", "chapter": "chapter", "eid": "article_number", "articleno": "article_number", "doi": "doi", "url": "url",
    "isbn": "isbn", "issn": "issn", "publisher": "publisher", "address": "place", "location": "place", "edition": "edition", "series": "series", "note": "notes", "school": "academic_affiliation", "type": "work_type",
    "organization": "corporate_author", "pagetotal": "pagination",
}
RIS_FIELDS = {
    "A2": "other_responsibility", "A3": "corporate_author", "TI": "title", "T1": "title", "CT": "title", "T2": "host_title", "JF": "periodical_title", "JO": "periodical_title", "JA": "periodical_title", "PY": "publication_year",
    "Y1": "publication_date", "DA": "publication_date", "VL": "volume", "IS": "issue", "DO": "doi", "UR": "url", "L1": "url", "L2": "url", "SN": "issn", "PB": "publisher", "CY": "place", "PP": "place", "ET": "edition", "N1": "notes",
    "M3": "work_type", "NV": "pagination", "AD": "academic_affiliation", "C2": "degree_course", "C3": "degree_course",
}
LISTS = ("authors", "host_authors", "notes")


def record_id(source_file: Column, source_record_id: Column) -> Column:
    """First 24 hexadecimal digits of the hash of file, a zero byte and the record's key."""
    return F.left(F.sha2(F.concat(source_file, F.char(F.lit(0)), F.coalesce(source_record_id, F.lit(""))), 256), F.lit(24))


def unpivot(wide: DataFrame, fields: dict[str, str], *, keys: list[str], method: Column, confidence: Column) -> DataFrame:
    """Wide rows to candidates: fields names the columns and what the ledger calls them, keys the columns that stay.

    One pass over the table, no shuffle.  Null and blank values give no candidate.
    """
    entries = [F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field_id"), F.lit(c).alias("raw_field_name"), F.col(c).cast("string").alias("value")) for i, (c, f) in enumerate(fields.items())]
    long = wide.select(*keys, method.alias("method"), confidence.alias("confidence"), F.inline(F.array(*entries)))
    return long.filter(F.trim("value") != "")


def normalized(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Clean the values, add their keys, drop what is empty and, with the catalog's fields given, what isn't a field."""
    out = rows.withColumn("value", clean("value")).filter("value IS NOT NULL").withColumn("normalized_value", title_key("value"))
    return out if known is None else out.join(F.broadcast(known.select("field_id").distinct()), "field_id", "left_semi")


def from_maps(entries: DataFrame, mapping: dict[str, str], *, source_format: str) -> DataFrame:
    """Candidates of parsed entries (record_id, source_file, source_record_id, fields map<string, array<string>>) by their raw fields.

    Names that the mapping lacks are left out.  Only list fields keep the position of a value.
    """
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    spread = entries.select("record_id", "source_file", "source_record_id", F.explode("fields").alias("raw_field_name", "values"))
    spread = spread.withColumn("field_id", F.try_element_at(table, F.col("raw_field_name"))).filter("field_id IS NOT NULL")
    spread = spread.select("*", F.posexplode("values").alias("at", "value"))
    order = {name: i for i, name in enumerate(mapping)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return spread.select(
        "record_id", "field_id", "value", F.lit(source_format).alias("source_format"), "source_file", "source_record_id", F.lit(f"{source_format}_raw_field").alias("method"), F.lit(0.99).alias("confidence"),
        F.lit(None).cast("int").alias("page_number"), "raw_field_name", F.when(F.col("field_id").isin(*LISTS), F.col("at") + 1).alias("sequence"), (F.lit(1000) + F.try_element_at(rank, F.col("raw_field_name")) * 100 + F.col("at")).cast("long").alias("ord"),
    )


def deduplicated(ledger: DataFrame) -> DataFrame:
    """The first candidate by ord of each field, key, source and position; the method isn't part of what tells them apart."""
    first = W.partitionBy(*DEDUP_KEY).orderBy("ord", "method", "value")
    return ledger.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def merged(*ledgers: DataFrame) -> DataFrame:
    """Union of ledgers in the order given; ord restarts after each, so earlier ledgers come first."""
    out = None
    for i, one in enumerate(ledgers):
        one = one.withColumn("ord", F.col("ord") + F.lit(i * 10**9).cast("long"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def with_reviewed(ledger: DataFrame, reviews: DataFrame) -> DataFrame:
    """Replace earlier human values of (record_id, field_id) by the reviewed list; reviews: record_id, field_id, values, source_file, method.

    A null or empty list clears the field: its human values go and none comes (see excluded_fields).
    """
    human = F.col("method").isin(*HUMAN)
    keys = reviews.select("record_id", "field_id").distinct()
    replaced = ledger.filter(human).join(keys, ["record_id", "field_id"], "left_anti")
    new = reviews.select("record_id", "field_id", F.posexplode("values").alias("at", "value"), "source_file", "method")
    new = new.select("record_id", "field_id", "value", F.lit("catalog").alias("source_format"), "source_file", F.lit(None).cast("string").alias("source_record_id"), "method", F.lit(1.0).alias("confidence"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("raw_field_name"), (F.col("at") + 1).alias("sequence"), F.col("at").cast("long").alias("ord"))
    return ledger.filter(~F.coalesce(human, F.lit(False))).unionByName(replaced).unionByName(normalized(new))


def excluded_fields(reviews: DataFrame) -> DataFrame:
    """(record_id, field_id) tombstones of cleared fields."""
    return reviews.filter("values IS NULL OR size(values) = 0").select("record_id", "field_id").distinct()
