"""Classification of extracted metadata and the quality gate of references: boolean projections, no shuffle but the page join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
HEURISTIC_AUTHORS = ("generic_front_matter", "layout_block_after_title", "text_after_title")
HUMAN_METHODS = ("api_review", "review_memory_exact")
INFERRED_METHODS = ("doi_structure", "publisher_profile", "web_print_profile")
LOW_CONFIDENCE, AMBIGUOUS, OCR_WARNING, OCR_EVIDENCE = 0.9, 0.6, 0.65, 0.8


def codes(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in pairs]))


def classify_metadata(rows: DataFrame) -> DataFrame:
    """Adds errors and status from title, n_authors, corporate_author, authors_method, authors_confidence, year, journal, document_type."""
    authors, corporate = F.coalesce("n_authors", F.lit(0)) > 0, F.col("corporate_author").isNotNull()
    hidden = F.coalesce(F.col("authors_method") == "not_visible_in_print", F.lit(False))
    errors = codes(
        ("title_not_found", F.col("title").isNull()),
        ("authors_not_visible_in_source", ~authors & ~corporate & hidden),
        ("authors_ambiguous", (~authors & ~corporate & ~hidden) | (authors & (F.col("authors_confidence") < AMBIGUOUS))),
        ("year_ambiguous", F.col("year").isNull()),
        ("journal_not_found", (F.col("document_type") == "journal_article") & F.col("journal").isNull()),
    )
    out = rows.withColumn("errors", errors)
    return out.withColumn("status", F.when(F.col("title").isNull() & ~authors & ~corporate, "failed").when(F.size("errors") > 0, "review_required").otherwise("processed"))


def page_warnings(pages: Column, evidence_methods: Column, *, place: Column, document_type: Column, authors_method: Column) -> Column:
    """Warning codes from an array of page structs (method, confidence, diagnostic_code) and the evidence's methods."""
    page = lambda test: F.exists(pages, test)
    unavailable = lambda p: p["method"] == "unavailable"
    found = codes(
        ("ocr_not_available", page(lambda p: p["diagnostic_code"] == "ocr_not_available") | page(lambda p: unavailable(p) & p["diagnostic_code"].isNull())),
        ("ocr_language_missing", page(lambda p: p["diagnostic_code"] == "ocr_language_missing")),
        ("page_text_unavailable", page(unavailable)),
        ("ocr_low_confidence", page(lambda p: (p["method"] == "ocr") & (p["confidence"] < OCR_WARNING))),
        ("metadata_pages_only", page(lambda p: p["method"] == "skipped")),
        ("place_not_identified", place.isNull() & (document_type == "journal_article")),
        ("source_field_not_visible", authors_method == "not_visible_in_print"),
        ("human_review", F.exists(evidence_methods, lambda m: m.isin(*HUMAN_METHODS))),
        ("inferred_metadata", F.exists(evidence_methods, lambda m: F.contains(m, F.lit("inferred")) | m.isin(*INFERRED_METHODS))),
    )
    return F.array_distinct(found)


def with_warnings(status: Column, warnings: Column) -> Column:
    return F.when((status == "processed") & (F.size(warnings) > 0), "processed_with_warnings").otherwise(status)


def low_ocr_evidence(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_ids with a field found on an OCR page of confidence below 0.8; evidence: doc_id, value, page_number; pages: doc_id, page_number, method, confidence."""
    weak = pages.filter((F.col("method") == "ocr") & (F.col("confidence") < OCR_EVIDENCE)).select("doc_id", "page_number").distinct()
    return evidence.filter("value IS NOT NULL AND page_number IS NOT NULL").join(weak, ["doc_id", "page_number"], "left_semi").select("doc_id").distinct()


def human_approved(review_state: Column, has_override: Column, has_human_candidate: Column, has_exclusion: Column, has_human_evidence: Column) -> Column:
    return (review_state == "approved") | ((review_state == "corrected") & (has_override | has_human_candidate | has_exclusion | has_human_evidence))


def assess(rows: DataFrame, families: list[str]) -> DataFrame:
    """Adds readiness (ready, review_required, blocked) and issues.

    Columns: include, status, resolved (boolean), schema_id, family, missing, conflicting, reference, approved, native_pages, ocr_pages, n_authors,
    authors_method, authors_confidence, title, title_confidence, weak_ocr, metadata_conflict, has_suggestion, document_type.  The first blocking
    reason counts alone; approval passes what isn't blocked.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    resolved = yes("resolved")
    block = (
        F.when(~F.coalesce("include", F.lit(True)), "secondary_variant")
        .when(F.col("status") == "failed", "extraction_blocked")
        .when(resolved & F.col("schema_id").isNull(), "reference_schema_not_identified")
        .when(resolved & ~F.col("family").isin(*families), "reference_schema_not_implemented")
        .when(resolved & (F.size("missing") > 0), "required_reference_field_missing")
        .when(~resolved & (F.col("status") == "review_required"), "extraction_blocked")
        .when(F.coalesce("reference", F.lit("")) == "", "reference_not_generated")
    )
    authors = n("n_authors") > 0
    issues = codes(
        ("reference_field_conflict", resolved & (F.size("conflicting") > 0)),
        ("ocr_only_source", (n("native_pages") == 0) & (n("ocr_pages") > 0)),
        ("heuristic_author_extraction", authors & F.col("authors_method").isin(*HEURISTIC_AUTHORS)),
        ("low_title_confidence", F.col("title").isNotNull() & (F.col("title_confidence") < LOW_CONFIDENCE)),
        ("low_author_confidence", authors & (F.col("authors_confidence") < LOW_CONFIDENCE)),
        ("low_confidence_ocr_evidence", yes("weak_ocr")),
        ("structured_metadata_conflict", yes("metadata_conflict")),
        ("correction_suggestion_available", yes("has_suggestion")),
        ("unsupported_document_type", ~resolved & (F.col("document_type") == "unknown")),
    )
    out = rows.withColumn("issues", F.when(block.isNotNull(), F.array(block)).when(yes("approved"), F.expr("cast(array() as array<string>)")).otherwise(issues))
    return out.withColumn("readiness", F.when(block.isNotNull(), "blocked").when(F.size("issues") > 0, "review_required").otherwise("ready"))


def readiness_counts(assessed: DataFrame) -> DataFrame:
    """One row: physical, selected, generated, ready, review, blocked; secondary variants count as physical only."""
    selected = F.coalesce("include", F.lit(True))
    count = lambda c, name: F.count_if(c).alias(name)
    return assessed.agg(F.count(F.lit(1)).alias("physical"), count(selected, "selected"), count(selected & (F.coalesce("reference", F.lit("")) != ""), "generated"), *[count(selected & (F.col("readiness") == r), n) for r, n in (("ready", "ready"), ("review_required", "review"), ("blocked", "blocked"))])
