"""Records of works from their sources: parsed entries become metadata, metadata becomes candidates of the ledger and of the type.

Metadata is a wide row: record_id, source_file, source_record_id, document_type, authors (array of full names), and for each
attribute a struct(value, confidence, method, page_number), as extraction gives it.  All steps are projections; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions import names, text
from bibspark.operators import ledger
from bibspark.sources import bibtex

# Attributes of metadata and the ledger's names for them, in order of appearance.
ATTRIBUTES = {
    "title": "title", "journal": "periodical_title", "place": "place", "year": "publication_year", "publication_month": "publication_month", "volume": "volume", "issue": "issue", "pages": "article_pages",
    "article_number": "article_number", "doi": "doi", "url": "url", "degree": "work_type", "program": "degree_course", "publisher": "publisher", "corporate_author": "corporate_author", "access_date": "access_date",
}
DERIVED = ("institution", "department", "total_pages")
# A source's entry types with the type of document and the family of schemas that each stands for.
BIBTEX_DOCUMENTS = {"article": "journal_article", "phdthesis": "thesis", "thesis": "thesis", "mastersthesis": "dissertation", "masterthesis": "dissertation", "book": "book_manual", "manual": "book_manual", "techreport": "book_manual", "report": "book_manual", "online": "web_article", "webpage": "web_article"}
BIBTEX_FAMILIES = {
    "article": "periodical_article", "book": "monograph", "manual": "monograph", "inbook": "monograph_part", "incollection": "monograph_part", "inproceedings": "event_part", "conference": "event_part", "proceedings": "event_whole",
    "phdthesis": "academic_work", "mastersthesis": "academic_work", "thesis": "academic_work", "online": "exclusive_electronic", "webpage": "exclusive_electronic",
}
RIS_DOCUMENTS = {"JOUR": "journal_article", "MGZN": "journal_article", "NEWS": "journal_article", "THES": "thesis", "BOOK": "book_manual", "RPRT": "book_manual", "SER": "book_manual", "MANUAL": "book_manual", "ELEC": "web_article", "WEB": "web_article"}
RIS_FAMILIES = {"JOUR": "periodical_article", "BOOK": "monograph", "CHAP": "monograph_part", "THES": "academic_work", "CONF": "event_part", "CPAPER": "event_part", "ELEC": "exclusive_electronic", "WEB": "exclusive_electronic", "NEWS": "newspaper_article"}
DOCUMENT_FAMILIES = {"journal_article": "periodical_article", "thesis": "academic_work", "dissertation": "academic_work", "book_manual": "monograph", "web_article": "exclusive_electronic"}
DEGREE = r"(?i)\(((?:Doutorado|Mestrado|Especializa(?:ç|c)[aãa]o|Bacharelado|Licenciatura)\s+em\s+[^)]+)\)"


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def evidence(value: Column, method: str, confidence: float = 0.99) -> Column:
    """struct of a value that a structured source states; one that is absent has no confidence."""
    value = F.nullif(F.trim(value), F.lit(""))
    there = value.isNotNull()
    return F.struct(value.alias("value"), F.when(there, F.lit(confidence)).otherwise(0.0).alias("confidence"), F.when(there, F.lit(method)).otherwise("not_extracted").alias("method"), F.lit(None).cast("int").alias("page_number"))


def _metadata(entries: DataFrame, source: str, values: dict[str, Column], people: Column, spoken: Column, kind: Column) -> DataFrame:
    """Wide rows of parsed entries; spoken is the text of authors of whom none could be read."""
    file = F.element_at(F.split("path", "/"), -1)
    method = f"{source}_structured_metadata"
    absent = [n for n in (*ATTRIBUTES, *DERIVED) if n not in values]
    return entries.filter("error IS NULL").select(
        ledger.record_id(file, F.col("entry_key")).alias("record_id"), file.alias("source_file"), F.col("entry_key").alias("source_record_id"), "entry_type", "fields", F.coalesce(kind, F.lit("unknown")).alias("document_type"),
        F.transform(people, lambda p: p["full"]).alias("authors"), evidence(spoken, method).alias("authors_evidence"), *[evidence(v, method).alias(n) for n, v in values.items()], *[evidence(F.lit(None).cast("string"), method).alias(n) for n in absent],
    )


def _with_address(doi: Column, url: Column) -> Column:
    """The URL, or the DOI's where only that is given."""
    return F.coalesce(url, F.concat(F.lit("https://doi.org/"), doi))


def from_bibtex(entries: DataFrame) -> DataFrame:
    """Metadata of parsed BibTeX entries; rows of files that could not be read give none."""
    raw = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(F.col("fields"), F.lit(k)), F.lit("")) for k in keys])
    get = lambda *keys: bibtex.clean_bibtex(raw(*keys))
    spoken, doi = get("author"), text.doi_plain(get("doi"))
    people = F.coalesce(bibtex.authors(spoken), F.expr(names.NO_ONE))
    named = F.size(people) > 0
    kind = F.lower("entry_type")
    degree = F.coalesce(get("type"), F.when(kind.isin("phdthesis", "thesis"), "Tese").when(kind.isin("mastersthesis", "masterthesis"), "Dissertação"))
    values = {
        "title": get("title"), "journal": get("journal", "journaltitle"), "place": get("address", "location"), "year": get("year"), "publication_month": get("month"), "volume": get("volume"), "issue": get("number", "issue"), "pages": get("pages"),
        "article_number": get("articleno", "eid", "numberofarticle"), "doi": doi, "url": _with_address(doi, get("url")), "degree": degree, "program": get("program"), "publisher": get("publisher"), "corporate_author": F.when(~named, spoken),
        "institution": get("school", "institution"), "department": get("department"), "total_pages": get("pagetotal"),
    }
    return _metadata(entries, "bibtex", values, people, spoken, _looked_up(BIBTEX_DOCUMENTS, kind))


def page_span(first: Column, last: Column) -> Column:
    """first-last, or the one that is there."""
    return F.when(first.isNotNull() & last.isNotNull() & (first != last), F.concat(first, F.lit("-"), last)).otherwise(F.coalesce(first, last))


def _first_of(*tags: str) -> Column:
    """The first value that isn't blank of the first tag that has one."""
    of = lambda t: F.try_element_at(F.filter(F.transform(F.try_element_at(F.col("fields"), F.lit(t)), lambda v: F.trim(v)), lambda v: v != ""), F.lit(1))
    return F.coalesce(*map(of, tags))


def from_ris(entries: DataFrame) -> DataFrame:
    """Metadata of parsed RIS entries; rows of files that could not be read give none."""
    get, kind = _first_of, F.upper("entry_type")
    doi, dated = text.doi_plain(get("DO")), get("PY", "Y1", "DA")
    found = lambda c, p, g=0: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    document = _looked_up(RIS_DOCUMENTS, kind)
    stated = get("M3", "N1")
    has = lambda *marks: F.lower(stated).rlike("|".join(marks))
    degree = F.when(has("disser", "master"), "Dissertação").when(has("tese", "thesis", "doctoral"), "Tese").otherwise(F.coalesce(stated, F.when(kind == "THES", "Tese")))
    people = names.listed(F.coalesce(F.try_element_at(F.col("fields"), F.lit("AU")), F.try_element_at(F.col("fields"), F.lit("A1"))), family_only=True)
    values = {
        "title": get("TI", "T1", "CT"), "journal": get("JF", "JO", "JA", "T2"), "place": get("CY", "PP"), "year": F.coalesce(found(dated, r"\b(?:19|20)\d{2}\b"), dated), "publication_month": found(dated, r"(?:19|20)\d{2}[/-](\d{1,2})", 1),
        "volume": get("VL"), "issue": get("IS"), "pages": page_span(get("SP"), get("EP")), "article_number": get("AN", "M1"), "doi": doi, "url": _with_address(doi, get("UR", "L1", "L2")), "degree": degree, "program": get("C2", "C3"),
        "publisher": get("PB"), "corporate_author": get("A3"), "institution": F.when(document.isin("thesis", "dissertation"), get("IN", "PB")), "department": get("AD"), "total_pages": get("NV"),
    }
    return _metadata(entries, "ris", values, people, F.array_join(F.transform(people, lambda p: p["full"]), "; "), document)


def candidates(metadata: DataFrame, source_format: str) -> DataFrame:
    """Ledger rows of metadata: authors in order, the mapped attributes, then affiliation, course and extent that follow from others."""
    null = lambda kind: F.lit(None).cast(kind)

    def entry(at, field: Column | str, value: Column, source: Column, *, method=None, confidence=None, page=None, raw: Column | None = None, sequence: Column | None = None) -> Column:
        field = F.lit(field) if isinstance(field, str) else field
        of = lambda given, name: source[name] if given is None else given
        return F.struct(F.lit(at).cast("long").alias("ord") if isinstance(at, int) else at.cast("long").alias("ord"), field.alias("field_id"), value.alias("value"), of(method, "method").alias("method"), of(confidence, "confidence").cast("double").alias("confidence"), of(page, "page_number").cast("int").alias("page_number"), (null("string") if raw is None else raw).cast("string").alias("raw_field_name"), (null("int") if sequence is None else sequence).cast("int").alias("sequence"))

    said, c = F.col("authors_evidence"), F.col
    people = F.transform("authors", lambda a, i: entry(i, "authors", a, said, sequence=i + 1))
    unread = F.when(F.size("authors") == 0, entry(0, "authors", said["value"], said))
    plain = [entry(100 + i, f, c(a)["value"], c(a), raw=F.lit(a)) for i, (a, f) in enumerate(ATTRIBUTES.items())]
    place, part = c("institution"), c("department")
    both = part["value"].isNotNull()
    affiliation = F.when(place["value"].isNotNull(), entry(
        200, "academic_affiliation", F.concat_ws(", ", part["value"], place["value"]), place, method=F.when(both, "academic_affiliation_combined").otherwise(place["method"]),
        confidence=F.when(both, F.least(F.lit(1.0), F.greatest(place["confidence"], part["confidence"]) + 0.03)).otherwise(place["confidence"]), page=F.when(both, F.coalesce(part["page_number"], place["page_number"])).otherwise(place["page_number"]),
        raw=F.when(both, "department+institution").otherwise("institution"),
    ))
    course = F.nullif(F.regexp_extract(c("degree")["value"], DEGREE, 1), F.lit(""))
    derived = entry(201, "degree_course", course, c("degree"), method=F.lit("derived_from_work_type"), confidence=F.greatest(F.lit(0.0), c("degree")["confidence"] - 0.02), raw=F.lit("degree"))
    pages, academic, book = c("total_pages")["value"], c("document_type").isin("thesis", "dissertation"), c("document_type") == "book_manual"
    extent = entry(202, F.when(academic, "pagination").when(book, "physical_description"), F.when(book & ~pages.rlike(r"\b(?:p|f|v)\.$"), F.concat(pages, F.lit(" p."))).otherwise(pages), c("total_pages"), raw=F.lit("total_pages"))
    rows = F.filter(F.concat(people, F.array(unread, *plain, affiliation, derived, extent)), lambda e: e["field_id"].isNotNull() & e["value"].isNotNull())
    return metadata.select("record_id", F.lit(source_format).alias("source_format"), "source_file", "source_record_id", F.inline(rows))


def records(metadata: DataFrame, source_format: str) -> DataFrame:
    """The whole ledger of a source's metadata: its candidates and, of entries (with fields), the raw fields' and of RIS the page range's.

    Normalised, and of equal candidates the first.
    """
    out = candidates(metadata, source_format)
    if source_format in ("bibtex", "ris"):
        raw = metadata if source_format == "ris" else metadata.withColumn("fields", F.transform_values("fields", lambda k, v: F.array(v)))
        told = ledger.from_maps(raw, ledger.RIS_FIELDS if source_format == "ris" else ledger.BIBTEX_FIELDS, source_format=source_format)
        out = out.unionByName(told if source_format == "ris" else told.withColumn("value", bibtex.clean_bibtex("value")).filter("value IS NOT NULL"))
    if source_format == "ris":
        first, last = (F.try_element_at(F.try_element_at(F.col("fields"), F.lit(t)), F.lit(1)) for t in ("SP", "EP"))
        span = metadata.filter(first.isNotNull()).select("record_id", F.lit("ris").alias("source_format"), "source_file", "source_record_id", F.lit(10**6).cast("long").alias("ord"), F.lit("article_pages").alias("field_id"), page_span(first, last).alias("value"), F.lit("ris_page_range").alias("method"), F.lit(0.99).alias("confidence"), F.lit(None).cast("int").alias("page_number"), F.lit("SP/EP").alias("raw_field_name"), F.lit(None).cast("int").alias("sequence"))
        out = out.unionByName(span)
    return ledger.deduplicated(ledger.normalized(out)).select(*ledger.COLUMNS)


def type_candidates(metadata: DataFrame, source_format: str) -> DataFrame:
    """Candidates of the family and medium that a record's schema has: one from its type of document, one from its entry type.

    record_id, family, medium, source_format, source_file, source_record_id, confidence, reason.  The catalog names the schema of a
    family and medium; families with one schema have the same for both.
    """
    stated = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(F.col("fields"), F.lit(k)), F.lit("")) for k in keys]).isNotNull()
    linked = F.col("url")["value"].isNotNull() | F.col("doi")["value"].isNotNull()
    medium = lambda online: F.when(online, "electronic").otherwise("print")
    known = F.struct(_looked_up(DOCUMENT_FAMILIES, F.col("document_type")).alias("family"), medium(linked).alias("medium"), F.lit(0.92).alias("confidence"), F.concat(F.lit("type of document "), F.col("document_type")).alias("reason"))
    found = [known]
    if source_format == "bibtex":
        found.append(F.struct(_looked_up(BIBTEX_FAMILIES, F.lower("entry_type")).alias("family"), medium(stated("url", "doi")).alias("medium"), F.lit(0.99).alias("confidence"), F.concat(F.lit("entry type "), F.col("entry_type")).alias("reason")))
    elif source_format == "ris":
        listed = lambda k: F.size(F.coalesce(F.try_element_at(F.col("fields"), F.lit(k)), F.expr("cast(array() as array<string>)"))) > 0
        found.append(F.struct(_looked_up(RIS_FAMILIES, F.upper("entry_type")).alias("family"), medium(listed("UR") | listed("DO")).alias("medium"), F.lit(0.99).alias("confidence"), F.concat(F.lit("entry type "), F.col("entry_type")).alias("reason")))
    out = metadata.select("record_id", F.lit(source_format).alias("source_format"), "source_file", "source_record_id", F.inline(F.filter(F.array(*found), lambda e: e["family"].isNotNull())))
    return out.select("record_id", "family", "medium", "source_format", "source_file", "source_record_id", "confidence", "reason")


def schema_candidates(types: DataFrame, catalog) -> DataFrame:
    """types with the schema_id that the catalog has for the family and medium (a family of one schema: that one) and ord; others go."""
    families: dict[str, dict[str, str]] = {}
    for s in catalog.schemas:
        families.setdefault(s["family"], {})[s["medium"]] = s["id"]
    pairs = {f"{family} {medium}": of.get(medium) or (next(iter(of.values())) if len(of) == 1 else None) for family, of in families.items() for medium in ("print", "electronic")}
    found = types.withColumn("schema_id", _looked_up({k: v for k, v in pairs.items() if v}, F.concat_ws(" ", "family", "medium"))).filter("schema_id IS NOT NULL")
    return found.withColumn("ord", (F.col("confidence") * 100).cast("long"))
