"""References as text, one layout for each family of schemas.

A layout is a function of a Fields view that lists nullable pieces of text; the pieces that hold anything are joined by spaces.
All is one projection over a map<field_id, array<string>> column, so rendering adds no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions import names
from bibspark.functions.text import corporate, date_in_words, doi_identifier, doi_url, embedded_place, has_unit, month, page_range, sentence, squeeze, strip_terminal, with_suffix

# What stands for unknown parts.
NO_AUTHOR = "[AUTORIA NÃO IDENTIFICADA]"
NO_TITLE = "[Título não identificado]"
NO_PLACE = "[S. l.]"
NO_PUBLISHER = "[s. n.]"
YEAR_FIELDS = ("publication_year", "defense_year", "presentation_year", "event_year", "start_year", "correspondence_date", "legal_document_date", "judgment_date", "signature_date", "registry_date", "deposit_date", "publication_date", "newspaper_date")
TITLE_FIELDS = ("title", "part_title", "event_name", "periodical_title", "service_title", "legal_document_name", "legal_document_type", "registry_document_type")


class Fields:
    """A record's resolved values as columns."""

    def __init__(self, fields: Column, *, suffix: Column | None = None, access_date: Column | None = None, all_names: bool = True, policy: dict | None = None, medium: Column | None = None):
        self.fields, self.suffix, self.run_date, self.all_names = fields, suffix if suffix is not None else F.lit(""), access_date, all_names
        self.policy = policy or {"doi_url_deduplication": True, "distinct_url_with_doi": True}
        self.medium = medium

    def all(self, name: str) -> Column:
        return F.coalesce(F.try_element_at(self.fields, F.lit(name)), F.expr("cast(array() as array<string>)"))

    def one(self, name: str, default: str | None = None) -> Column:
        value = F.nullif(F.try_element_at(F.try_element_at(self.fields, F.lit(name)), F.lit(1)), F.lit(""))
        return value if default is None else F.coalesce(value, F.lit(default))

    def has(self, name: str) -> Column:
        return self.one(name).isNotNull()

    def bare(self, name: str) -> Column:
        """Without signs at the end; null where the field has no value."""
        return F.when(self.has(name), strip_terminal(self.one(name)))

    def year(self, name: str) -> Column:
        return with_suffix(self.one(name), self.suffix)

    # Pieces.

    def said(self, *fields: str) -> list[Column]:
        return [sentence(self.one(f)) for f in fields]

    def each(self, name: str) -> Column:
        return F.array_join(F.filter(F.transform(self.all(name), sentence), lambda s: s.isNotNull()), " ")

    def labelled(self, label: str, name: str) -> Column:
        values = F.filter(F.transform(self.all(name), strip_terminal), lambda v: v != "")
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, "; "), F.lit(".")))

    def tagged(self, label: str, name: str) -> Column:
        return F.when(self.has(name), F.concat(F.lit(label), self.bare(name), F.lit(".")))

    def people(self, name: str, fallback: str | None = NO_AUTHOR) -> Column:
        return F.when(F.size(self.all(name)) > 0, names.shown(self.all(name), all_names=self.all_names)).otherwise(F.lit(fallback))

    def responsibility(self) -> Column:
        return F.coalesce(F.when(F.size(self.all("authors")) > 0, self.people("authors")), corporate(self.one("corporate_author")), self.one("creator"), self.one("jurisdiction"), F.lit(NO_AUTHOR))

    def title(self, main: str = "title", sub: str = "subtitle") -> Column:
        return F.concat(self.one(main, NO_TITLE), F.when(self.has(sub), F.concat(F.lit(": "), self.one(sub))).otherwise(""))

    def imprint(self, publisher: str = "publisher", when: Column | None = None) -> Column:
        return F.concat(self.one("place", NO_PLACE), F.lit(": "), self.one(publisher, NO_PUBLISHER), F.lit(", "), self.year("publication_year") if when is None else when, F.lit("."))

    def serial(self) -> Column:
        """Null where no detail is known."""
        parts = [F.when(self.has(f), F.concat(F.lit(label), self.bare(f))) for label, f in (("ano ", "year_designation"), ("v. ", "volume"), ("n. ", "issue"), ("fasc. ", "fascicle"))]
        return F.nullif(F.concat_ws(", ", *parts), F.lit(""))

    def pages(self, name: str) -> Column:
        return F.when(self.has(name), F.concat(F.lit("p. "), page_range(self.one(name))))

    def event(self) -> Column:
        number = F.when(self.has("event_number"), F.concat(F.lit(", "), self.bare("event_number"), F.lit("."))).otherwise("")
        return F.concat(self.one("event_name", "[EVENTO NÃO IDENTIFICADO]"), number, F.lit(", "), self.one("event_year", "[ano não identificado]"), F.lit(", "), self.one("event_place", NO_PLACE))

    def dated(self) -> Column:
        return F.coalesce(self.one("publication_date"), self.year("publication_year"))

    def online(self) -> list[Column]:
        """DOI, then the URL with its date of access unless it only repeats the DOI."""
        doi = doi_url(self.one("doi"))
        url = strip_terminal(self.one("url"))
        repeats = doi.isNotNull() & doi_identifier(url).eqNullSafe(doi_identifier(doi))
        shown = url != ""
        if self.policy.get("doi_url_deduplication"):
            shown = shown & ~repeats
        if not self.policy.get("distinct_url_with_doi"):
            shown = shown & doi.isNull()
        accessed = date_in_words(F.coalesce(self.one("access_date"), self.run_date if self.run_date is not None else F.lit(None).cast("string")))
        accessed = F.concat(accessed, F.when(self.has("access_time"), F.concat(F.lit(", "), self.bare("access_time"))).otherwise(""))
        return [F.when(doi.isNotNull(), F.concat(F.lit("DOI: "), doi, F.lit("."))), F.when(shown, F.concat(F.lit("Disponível em: "), url, F.lit("."))), F.when(shown, F.concat(F.lit("Acesso em: "), accessed, F.lit(".")))]


def _dot(*parts: Column) -> Column:
    """The parts, each with a full stop after it, as one piece; a null part makes the piece null."""
    out = []
    for i, p in enumerate(parts):
        out += [p, F.lit(". " if i < len(parts) - 1 else ".")]
    return F.concat(*out)


def _same(a: Column, b: Column) -> Column:
    """Whether b holds a, spaces and case aside."""
    key = lambda c: F.lower(squeeze(c))
    return F.contains(key(b), key(a))


def monograph(r: Fields) -> list[Column]:
    return [_dot(r.responsibility(), r.title()), r.each("other_responsibility"), *r.said("edition"), r.imprint(), *r.said("support", "physical_description", "illustrations", "dimensions", "series"), r.each("notes"), r.tagged("ISBN ", "isbn"), *r.online()]


def academic_work(r: Fields) -> list[Column]:
    extent = r.bare("pagination")
    kind = r.one("work_type", "Trabalho acadêmico")
    course = F.when(r.has("degree_course") & ~_same(r.one("degree_course"), kind), F.concat(F.lit(" ("), r.one("degree_course"), F.lit(")"))).otherwise("")
    thesis = F.concat(kind, course, F.lit(" – "), r.one("academic_affiliation", "[Instituição não identificada]"), F.lit(", "), r.one("academic_place", NO_PLACE), F.lit(", "), r.year("defense_year"), F.lit("."))
    return [_dot(r.responsibility(), r.title()), r.tagged("Orientador: ", "advisor"), _dot(r.year("presentation_year")), F.when(has_unit(extent), extent).otherwise(F.concat(extent, F.lit(" f."))), thesis, *r.online()]


def monograph_part(r: Fields) -> list[Column]:
    host = F.concat(F.lit("In: "), F.coalesce(F.concat(F.nullif(r.people("host_authors", None), F.lit("")), F.lit(". ")), F.lit("")), r.title("host_title", "host_subtitle"), F.lit("."))
    extent = F.nullif(F.concat_ws(", ", F.when(r.has("volume"), F.concat(F.lit("v. "), r.bare("volume"))), F.when(r.has("chapter"), F.concat(F.lit("cap. "), r.bare("chapter"))), r.pages("part_pages")), F.lit(""))
    return [_dot(r.people("authors"), r.title("part_title", "part_subtitle")), host, *r.said("host_edition"), r.imprint(), _dot(extent), *r.said("support"), *r.online()]


def correspondence(r: Fields) -> list[Column]:
    where = F.nullif(F.concat_ws(", ", r.one("place"), r.one("correspondence_date")), F.lit(""))
    return [_dot(r.people("authors"), strip_terminal(r.one("title", "[Correspondência]"))), r.tagged("Destinatário: ", "recipient"), F.when(where.isNotNull(), _dot(strip_terminal(where))), *r.said("correspondence_description"), r.each("notes"), *r.said("support"), *r.online()]


def _event_tail(r: Fields) -> list[Column]:
    return [*r.said("event_pagination"), r.each("event_notes"), *r.said("supplement_designation"), r.tagged("ISBN ", "isbn"), *r.said("support"), *r.online()]


def _event_head(r: Fields) -> Column:
    return F.concat(r.event(), F.lit(". "), strip_terminal(r.one("event_document_title", "[Documento do evento]")), F.lit("."))


def event_whole(r: Fields) -> list[Column]:
    return [_event_head(r), r.imprint(), *_event_tail(r)]


def event_whole_periodical(r: Fields) -> list[Column]:
    issue = F.concat(r.one("place", NO_PLACE), F.lit(": "), r.one("publisher", NO_PUBLISHER), F.coalesce(F.concat(F.lit(", "), r.serial()), F.lit("")), F.lit(", "), strip_terminal(r.dated()), F.lit("."))
    return [_event_head(r), _dot(r.title("periodical_title", "periodical_subtitle")), issue, *_event_tail(r)]


def event_part(r: Fields) -> list[Column]:
    return [_dot(r.people("authors"), r.title("part_title", "part_subtitle")), F.concat(F.lit("In: "), _event_head(r)), r.imprint(), _dot(r.pages("part_pages")), *r.said("support"), *r.online()]


def event_part_periodical(r: Fields) -> list[Column]:
    issue = F.concat(F.concat_ws(", ", r.title("periodical_title", "periodical_subtitle"), embedded_place(r.one("place")), r.serial(), r.pages("part_pages"), strip_terminal(r.dated())), F.lit("."))
    return [_dot(r.people("authors"), r.title("part_title", "part_subtitle")), issue, *r.said("supplement_designation"), F.concat(F.lit("Trabalho apresentado no "), r.event(), F.lit(".")), *r.said("support"), *r.online()]


def patent(r: Fields) -> list[Column]:
    roles = [r.labelled(label, f) for label, f in (("Depositante", "patent_depositor"), ("Titular", "patent_holder"), ("Procurador", "patent_attorney"))]
    return [_dot(r.people("authors"), strip_terminal(r.one("title", NO_TITLE))), *roles, *r.said("patent_number"), r.tagged("Depósito: ", "deposit_date"), r.tagged("Concessão: ", "grant_date"), *r.said("patent_classification", "support"), *r.online()]


def _numbered(r: Fields, name: Column, number: str, date: str) -> Column:
    return F.concat(name, F.coalesce(F.concat(F.lit(" n. "), r.bare(number)), F.lit("")), F.coalesce(F.concat(F.lit(", de "), r.bare(date)), F.lit("")))


def legislation(r: Fields) -> list[Column]:
    place = F.coalesce(r.one("jurisdiction"), r.one("entity_heading"), F.lit(""))
    return [_dot(place, _numbered(r, r.one("legal_document_name", "[Documento legal]"), "legal_document_number", "legal_document_date")), *r.said("ementa", "publication_source"), r.each("notes"), *r.said("support"), *r.online()]


def jurisprudence(r: Fields) -> list[Column]:
    court = F.concat(r.one("court", "[Tribunal não identificado]"), F.coalesce(F.concat(F.lit(" ("), r.one("court_division"), F.lit(")")), F.lit("")))
    decision = F.concat(r.one("legal_document_type", "[Decisão judicial]"), F.coalesce(F.concat(F.lit(" "), r.bare("process_number")), F.lit("")))
    return [_dot(r.one("jurisdiction", ""), court, decision), *r.said("ementa", "judicial_unit"), r.tagged("Relator: ", "relator"), *r.said("judgment_date", "publication_source", "support"), *r.online()]


def administrative_act(r: Fields) -> list[Column]:
    place, entity = F.coalesce(r.one("jurisdiction"), r.one("entity_heading"), F.lit("")), r.one("entity_heading")
    head = F.when(entity.isNotNull() & ~_same(entity, place), F.when(place != "", F.concat(place, F.lit(". "), entity)).otherwise(entity)).otherwise(place)
    return [_dot(head, _numbered(r, r.one("administrative_act_type", "[Ato administrativo]"), "administrative_act_number", "signature_date")), *r.said("ementa", "publication_source"), r.each("notes"), *r.said("support"), *r.online()]


def civil_registry(r: Fields) -> list[Column]:
    return [_dot(r.one("jurisdiction", ""), r.one("registry_office", "[Cartório não identificado]"), r.one("registry_document_type", "[Documento civil]"), r.one("registry_date", "[data não identificada]")), r.each("notes")]


def _collection(r: Fields, body: Column, *after: Column) -> list[Column]:
    head = F.concat(r.title("periodical_title", "periodical_subtitle"), F.lit(". "), r.one("place", NO_PLACE), F.lit(": "), r.one("publisher", NO_PUBLISHER), F.lit(", "), body, F.lit("."))
    return [head, *after, r.tagged("ISSN ", "issn"), r.each("notes"), *r.said("support"), *r.online()]


def _span(r: Fields) -> Column:
    return F.concat(r.year("start_year"), F.coalesce(F.concat(F.lit("-"), r.one("end_year")), F.lit("")))


def periodical_collection(r: Fields) -> list[Column]:
    return _collection(r, _span(r))


def periodical_collection_part(r: Fields) -> list[Column]:
    return _collection(r, _span(r), *r.said("consulted_period"))


def periodical_issue(r: Fields) -> list[Column]:
    return _collection(r, strip_terminal(F.concat_ws(", ", r.serial(), r.dated())), *r.said("supplement_designation"))


def periodical_article(r: Fields) -> list[Column]:
    number = F.when(r.has("article_number"), F.concat(F.lit("art. "), r.bare("article_number")))
    when = F.concat(F.coalesce(F.concat(F.nullif(month(F.coalesce(r.one("publication_month"), r.one("publication_period"))), F.lit("")), F.lit(" ")), F.lit("")), r.year("publication_year"))
    issue = F.concat(F.concat_ws(", ", r.title("periodical_title", "periodical_subtitle"), embedded_place(r.one("place")), r.serial(), F.coalesce(r.pages("article_pages"), number), when), F.lit("."))
    return [_dot(r.responsibility(), r.title()), issue, *r.said("supplement_designation"), r.each("notes"), *r.said("support"), *r.online()]


def newspaper_article(r: Fields) -> list[Column]:
    pages = r.pages("newspaper_pages")
    date = strip_terminal(r.one("newspaper_date", "[data não identificada]"))
    issue = F.concat(F.concat_ws(", ", r.title("newspaper_title", "newspaper_subtitle"), embedded_place(r.one("place")), r.serial(), F.when(~r.has("newspaper_section"), pages), date), F.lit("."))
    section = F.when(r.has("newspaper_section"), F.concat(F.concat_ws(", ", r.bare("newspaper_section"), pages), F.lit(".")))
    return [_dot(r.responsibility(), r.title()), issue, section, *r.said("support"), *r.online()]


def audiovisual(r: Fields) -> list[Column]:
    made = F.concat(r.one("place", NO_PLACE), F.coalesce(F.concat(F.lit(": "), r.one("publisher")), F.lit("")), F.lit(", "), r.year("publication_year"), F.lit("."))
    return [_dot(strip_terminal(r.one("title", NO_TITLE))), r.labelled("Direção", "director"), r.labelled("Produção", "producer"), r.each("audiovisual_responsibilities"), made, *r.said("media_support", "physical_description"), r.each("notes"), *r.said("support"), *r.online()]


def sound_document(r: Fields) -> list[Column]:
    authors, title = F.nullif(r.people("authors", None), F.lit("")), r.one("title", NO_TITLE)
    electronic = r.medium == "electronic" if r.medium is not None else F.lit(False)
    when = F.when(electronic, F.coalesce(strip_terminal(r.one("publication_date")), F.lit(""))).otherwise(strip_terminal(r.year("publication_year")))
    roles = [r.labelled(label, f) for label, f in (("Compositor", "composer"), ("Intérprete", "performer"), ("Ledor", "narrator"))]
    return [F.concat(F.coalesce(F.concat(authors, F.lit(". ")), F.lit("")), title, F.lit(".")), r.each("sound_responsibility"), *roles, r.imprint("recording_label", when), *r.said("media_support", "physical_description"), r.each("notes"), *r.said("support"), *r.online()]


def sound_document_part(r: Fields) -> list[Column]:
    both = r.has("media_support") & r.has("track")
    support = [F.when(both, F.concat(r.bare("media_support"), F.lit(", "), r.bare("track"), F.lit("."))), *[F.when(~both, s) for s in r.said("media_support", "track")]]
    return [_dot(strip_terminal(r.one("part_title", "[Título da parte não identificado]"))), r.labelled("Intérprete", "performer"), r.labelled("Compositor", "composer"), F.concat(F.lit("In: "), strip_terminal(r.one("host_title", "[Título do documento sonoro]")), F.lit(".")), r.each("sound_responsibility"), r.imprint("recording_label"), *support, *r.said("physical_description")]


def score(r: Fields) -> list[Column]:
    printed = r.medium == "print" if r.medium is not None else F.lit(False)
    made = F.when(r.has("place") | r.has("publisher") | printed, r.imprint()).otherwise(_dot(r.year("publication_year")))
    return [_dot(r.people("composer"), r.title()), *r.said("instrument"), made, *r.said("physical_description"), r.each("notes"), *r.said("support"), *r.online()]


def iconographic(r: Fields) -> list[Column]:
    return [_dot(r.people("authors"), strip_terminal(r.one("title", "[Sem título]")), r.year("publication_year"), strip_terminal(r.one("iconographic_support", "[Suporte não identificado]"))), *r.said("physical_description", "illustrations", "dimensions"), r.each("notes"), *r.said("support"), *r.online()]


def cartographic(r: Fields) -> list[Column]:
    return [F.concat(_dot(r.people("authors"), r.title()), F.lit(" "), r.imprint()), *r.said("map_description", "physical_description", "illustrations", "dimensions"), r.tagged("Escala ", "scale"), r.each("notes"), *r.said("support"), *r.online()]


def three_dimensional(r: Fields) -> list[Column]:
    values = r.all("creator")
    capitals = F.forall(F.filter(values, lambda v: v != ""), lambda v: F.upper(v) == v)
    creator = F.when(F.size(values) == 0, F.lit("[CRIADOR NÃO IDENTIFICADO]")).when(capitals, F.array_join(F.transform(values, strip_terminal), "; ")).otherwise(names.shown(values, all_names=r.all_names))
    maker = F.when(r.has("manufacturer"), F.concat(F.coalesce(F.concat(r.one("place"), F.lit(": ")), F.lit("")), r.one("manufacturer"), F.lit(", "))).otherwise("")
    return [_dot(creator, strip_terminal(r.one("title", "[Sem título]"))), F.concat(maker, r.year("publication_year"), F.lit(".")), *r.said("physical_description", "dimensions"), r.each("notes")]


def exclusive_electronic(r: Fields) -> list[Column]:
    made = F.concat(F.coalesce(F.concat(r.one("place"), F.lit(", ")), F.lit("")), r.year("publication_year"), F.lit("."))
    return [_dot(r.responsibility(), strip_terminal(F.coalesce(r.one("service_title"), r.one("title"), F.lit(NO_TITLE)))), *r.said("software_version"), made, sentence(F.coalesce(r.one("electronic_description"), r.one("support"))), r.each("notes"), *r.online()]


#: Layout by family of the catalog.
LAYOUTS: dict[str, Callable[[Fields], list[Column]]] = {
    "monograph": monograph, "academic_work": academic_work, "monograph_part": monograph_part, "correspondence": correspondence, "event_whole": event_whole, "event_whole_periodical": event_whole_periodical, "event_part": event_part,
    "event_part_periodical": event_part_periodical, "patent": patent, "legal_legislation": legislation, "legal_jurisprudence": jurisprudence, "legal_administrative_act": administrative_act, "civil_registry": civil_registry,
    "periodical_collection": periodical_collection, "periodical_collection_part": periodical_collection_part, "periodical_issue": periodical_issue, "periodical_article": periodical_article, "newspaper_article": newspaper_article,
    "audiovisual": audiovisual, "sound_document": sound_document, "sound_document_part": sound_document_part, "score": score, "iconographic": iconographic, "cartographic": cartographic, "three_dimensional": three_dimensional,
    "exclusive_electronic": exclusive_electronic,
}

#: Fields whose values stand out in print, by family; the others' is the title.
EMPHASIS = {
    "monograph_part": ("host_title",), "event_whole": ("event_document_title",), "event_part": ("event_document_title",), "event_whole_periodical": ("periodical_title",), "event_part_periodical": ("periodical_title",),
    "legal_legislation": ("legal_document_name", "publication_source"), "legal_jurisprudence": ("legal_document_type", "publication_source"), "legal_administrative_act": ("administrative_act_type", "publication_source"), "civil_registry": ("registry_document_type",),
    "periodical_collection": ("periodical_title",), "periodical_collection_part": ("periodical_title",), "periodical_issue": ("periodical_title",), "periodical_article": ("periodical_title",), "newspaper_article": ("newspaper_title",),
    "sound_document_part": ("host_title",), "exclusive_electronic": ("service_title", "title"),
}
PRINT_ONLY = ("publication_source",)


def joined(pieces: list[Column]) -> Column:
    # No lambda around the pieces: Spark would interpret all that stands in it, and work out anew what is said twice.  Joining passes over nulls.
    return F.array_join(F.array_remove(F.array(*[F.trim(p) for p in pieces]), ""), " ")


def reference(family: str, fields: Fields) -> Column:
    """The reference text of one family's records."""
    return joined(LAYOUTS[family](fields))


def render(records: DataFrame, *, access_date: str | None = None, families: list[str] | None = None, all_names: bool = True, policy: dict | None = None) -> DataFrame:
    """records (family, medium, ready, fields map, and year_suffix if there) with the column reference; null unless ready and of a known family.

    Naming the families that occur keeps the plan small.
    """
    suffix = F.col("year_suffix") if "year_suffix" in records.columns else F.lit("")
    view = Fields(F.col("fields"), suffix=suffix, access_date=F.lit(access_date) if access_date else None, all_names=all_names, policy=policy, medium=F.col("medium"))
    text = F.lit(None).cast("string")
    for family in families or list(LAYOUTS):
        text = F.when(F.col("family") == family, reference(family, view)).otherwise(text)
    return records.withColumn("reference", F.when(F.coalesce(F.col("ready"), F.lit(False)), text))


def emphasis(family: Column, medium: Column, fields: Column) -> Column:
    """Values that stand out, the longest first."""
    view = Fields(fields)
    own = F.array(view.one("title"))
    for name, ids in EMPHASIS.items():
        own = F.when(family == name, F.array(*[F.when((medium == "print"), view.one(f)) if f in PRINT_ONLY else view.one(f) for f in ids])).otherwise(own)
    distinct = F.array_distinct(F.filter(own, lambda v: v.isNotNull()))
    return F.transform(F.array_sort(F.transform(distinct, lambda v, i: F.struct(-F.length(v), i, v.alias("v")))), lambda s: s["v"])


def _first_list(r: Fields, *fields: str) -> Column:
    """The values of the first of these fields that has any, null if none has."""
    return F.get(F.filter(F.array(*[r.all(f) for f in fields]), lambda v: F.size(v) > 0), F.lit(0))


def sort_responsibility(r: Fields) -> Column:
    values = _first_list(r, "authors", "composer", "host_authors")
    people = F.when(values.isNotNull(), names.shown(values, all_names=r.all_names))
    return F.coalesce(people, corporate(r.one("corporate_author")), r.one("jurisdiction"), r.one("event_name"), r.one("creator"), r.one("title"), r.one("service_title"), F.lit(""))


def sort_title(r: Fields) -> Column:
    return F.coalesce(*[r.one(f) for f in TITLE_FIELDS], F.lit(""))


def year_value(r: Fields) -> Column:
    value = F.coalesce(*[r.one(f) for f in YEAR_FIELDS])
    return F.coalesce(F.nullif(F.regexp_extract(value, r"\b(?:18|19|20|21)\d{2}\b", 0), F.lit("")), value, F.lit("s.d."))


def authorship(r: Fields) -> Column:
    """What two works must share to need year letters: the names, folded, or the corporate name."""
    key = lambda c: F.lower(squeeze(c))
    fold = lambda people: F.transform(people, lambda p: F.concat(key(p["family"]), F.lit("\t"), key(p["given"])))
    lists = F.filter(F.transform(F.array(*[r.all(f) for f in ("authors", "composer", "creator", "host_authors")]), names.of_values), lambda p: F.size(p) > 0)
    people = names.let(lists, lambda q: F.when(F.size(q) > 0, fold(F.get(q, F.lit(0)))))
    other = F.coalesce(*[r.one(f) for f in ("corporate_author", "jurisdiction", "event_name", "title", "service_title", "creator")])
    return F.coalesce(people, F.when(other.isNotNull(), F.array(F.concat(key(other), F.lit("\t")))), F.expr("cast(array() as array<string>)"))
