"""Signals and fields in page text, natively.  Java needs (?U) or (?u) to read \\w, \\b and case as Unicode does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.fold import match_text
from bibspark.functions.text import doi_selected, squeeze

FRONT_CHARS, WHOLE_CHARS, FRONT_PAGES, SEARCH_CHARS = 120_000, 240_000, 8, 180_000
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
URL = r"(?i)https?://[^\s<>\[\]{}\"']+"
YEAR = r"\b((?:19|20)\d{2})\b"

# What counts as a sign of an article, event or monograph.
SIGNALS = {
    "has_doi": DOI,
    "has_abstract": r"(?imU)^\s*(?:abstract|resumo)\s*[:—-]?\s*$",
    "has_keywords": r"(?imU)^\s*(?:keywords?|key\s+words|palavras[- ]chave)\s*[:—-]",
    "has_references": r"(?imU)^\s*(?:references|refer[eê]ncias|bibliography|bibliografia)\s*$",
    "has_article_label": r"(?imU)^\s*(?:research|review|original|scientific|technical)\s+article\b|^\s*(?:short communication|article in press)\b",
    "has_publication_history": r"(?isU)\breceived\b.{0,180}\baccepted\b|\bavailable online\b|\bpublished online\b|\bdate of publication\b",
    "has_periodical_marker": r"(?iU)\bISSN\b|\bvol(?:ume)?\.?\s*\d+|\bv\.?\s*\d+\s*,\s*n\.?\s*\d+|\bissue\s*\d+|\bpp?\.?\s*\d+\s*[-–—]\s*\d+",
    "has_event_marker": r"(?iU)\b(?:proceedings of|conference|congress|symposium|workshop|seminar)\b",
    "has_monograph_marker": r"(?iU)\bISBN(?:-1[03])?\b",
}
# What a text must hold, in small letters, for a sign to be there; searching for it costs a fraction of the pattern.
HINTS = {
    "has_doi": ("10.",), "has_abstract": ("abstract", "resumo"), "has_keywords": ("key", "palavras"), "has_references": ("refer", "bibliogra"), "has_article_label": ("article", "short communication"),
    "has_publication_history": ("accepted", "available online", "published online", "date of publication"), "has_event_marker": ("proceedings of", "conference", "congress", "symposium", "workshop", "seminar"), "has_monograph_marker": ("isbn",),
}
ODD_LETTERS = "ſıİ\u212a"  # patterns without case take them for s, i and k, which lower() doesn't
WHOLE = ("has_references", "has_monograph_marker")
FOLDED = ("has_event_marker", "has_monograph_marker")


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds any of the words as they are."""
    found = [F.contains(text, F.lit(w)) for w in words]
    return reduce(lambda x, y: x | y, found)


def sign(text: Column, low: Column, name: str) -> Column:
    """Whether the sign's pattern is in the text; low is the text in small letters."""
    pattern = SIGNALS[name]
    if name == "has_periodical_marker":  # each of its words begins so
        pattern = pattern.replace("(?iU)", "(?iU)(?=[ivp])(?:", 1) + ")"
    seen = text.rlike(pattern)
    return F.coalesce((holds(low, HINTS[name]) | holds(text, tuple(ODD_LETTERS))) & seen if name in HINTS else seen, F.lit(False))


def article_signals(front: Column, whole: Column, *, folded: Column | None = None) -> Column:
    """struct of nine booleans over the bounded front and whole text; events and monographs are looked for in the folded text, where a line's end is a space.

    folded: match_text of front, where front and whole are one text that is folded anyway; only texts beyond a bound are then folded again.
    """
    a, b = F.substring(front, 1, FRONT_CHARS), F.substring(whole, 1, WHOLE_CHARS)
    again = lambda cut, limit: match_text(cut) if folded is None else F.coalesce(match_text(F.when(F.length(front) > limit, cut)), folded)
    texts = {(False, False): (a, F.lower(a)), (True, False): (b, F.lower(b)), (False, True): (again(a, FRONT_CHARS),) * 2, (True, True): (again(b, WHOLE_CHARS),) * 2}
    return F.struct(*[sign(*texts[name in WHOLE, name in FOLDED], name).alias(name) for name in SIGNALS])


def looks_like_article(s: Column) -> Column:
    has = lambda n: s["has_" + n]
    signs = (
        (has("article_label") & (has("doi") | has("abstract") | has("periodical_marker")))
        | (has("doi") & has("abstract") & (has("references") | has("periodical_marker") | has("publication_history")))
        | (has("abstract") & has("references") & has("periodical_marker"))
        | (has("periodical_marker") & has("publication_history") & (has("doi") | has("references") | has("keywords")))
    )
    return signs & ~has("event_marker") & ~has("monograph_marker")


def front_text(pages: DataFrame, limit: int, *, sep: str = " ") -> DataFrame:
    """(doc_id, text): the first pages that hold text, joined."""
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), lambda t: t != "")
    return pages.groupBy("doc_id").agg(F.array_join(F.slice(texts, 1, limit), sep).alias("text"))


def document_type(front: Column, folded: Column, signals: Column, journals: list[str]) -> Column:
    """Ordered rules over lower-case front text and its folded form; journals are names whose appearance settles an article."""
    # What a pattern can't do without is looked for first: most texts don't hold it.
    presented = holds(folded, ("apresentada", "submetida", "programa de pos graduacao"))
    academic = lambda stem, word, degree: F.contains(folded, F.lit(stem)) & (F.contains(folded, F.lit(degree)) | presented) & folded.rlike(word)
    named = F.lit(False)
    for j in journals:
        named = named | F.contains(front, F.lit(j))
    card = holds(folded, ("catalogacao na fonte", "ficha catalografica"))
    return (
        F.when(academic("disserta", r"\bdisserta(?:cao|gao|cdo)\b", "mestrado"), "dissertation")
        .when(academic("tese", r"\btese\b", "doutorado"), "thesis")
        .when(named | (F.contains(front, F.lit("digital object identifier 10.")) & F.contains(front, F.lit("date of publication"))), "journal_article")
        .when(F.contains(front, F.lit("mdpi.com/journal/sensors")) & front.rlike(r"\bsensors\s+20\d{2},\s*\d+,\s*\d+"), "journal_article")
        .when(F.contains(front, F.lit("doi")) & front.rlike(r"(?U)\bdoi\s*:\s*10\.") & front.rlike(r"(?U)\bv\.?\s*\d+"), "journal_article")
        .when(holds(folded, ("isbn",)) & holds(folded, ("edicao",)) & folded.rlike(r"\bisbn\s+[0-9x-]+") & folded.rlike(r"\b(?:[1-9]|10)[ªa]?\s+edicao\b"), "book_manual")
        .when(card & folded.rlike(r"\b(?:ministerio|universidade|instituto|fundacao|organizacao)\b") & folded.rlike(r"\b(?:19|20)\d{2}\b"), "book_manual")
        .when(F.contains(front, F.lit("notícias agrícolas")) | (F.contains(front, F.lit("publicado em")) & F.contains(front, F.lit("gov.br"))), "web_article")
        .when(looks_like_article(signals), "journal_article")
        .otherwise("unknown")
    )


def variant(producer: Column, creator: Column, title: Column, native: Column, ocr: Column, kind: Column, front: Column, *, repository: str) -> Column:
    """Kind of variant from a file's properties and its pages; repository is the institution whose theses are repository copies."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    printed = (F.contains(low(producer), F.lit("microsoft")) & F.contains(low(producer), F.lit("print"))) | F.contains(low(creator), F.lit("chrome")) | F.startswith(low(title), F.lit("brasil -"))
    return F.when(printed, "browser_print").when((native == 0) & (ocr > 0), "scanned").when(kind.isin("thesis", "dissertation") & F.contains(F.lower(front), F.lit(repository.lower())), "institutional_repository").otherwise("publisher_original")


def canonical_key(title_key: Column, year_key: Column, doi: Column, stem_key: Column) -> Column:
    """Key of duplicates of extracted documents: title and year before DOI before the file's name."""
    stem = squeeze(F.regexp_replace(stem_key, r"\b(pdf|original|impresso|imprimido|site|gratuito|texto completo)\b", " "))
    return F.when(title_key != "", F.concat(F.lit("title:"), title_key, F.lit("|year:"), F.coalesce(year_key, F.lit("")))).when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi:"), doi)).when(F.coalesce(stem, F.lit("")) != "", F.concat(F.lit("file:"), stem)).otherwise("unknown")


def entry_key(source: str, doi: Column, title_key: Column, year: Column, key: Column) -> Column:
    """Key of duplicates of structured entries (bibtex or ris): DOI first."""
    y = F.coalesce(year, F.lit(""))
    if source == "bibtex":
        other = F.when(title_key != "", F.concat(F.lit("title:"), title_key, F.lit("|year:"), y)).otherwise(F.concat(F.lit("bibtex:"), F.lower(key)))
    else:
        other = F.concat(F.lit("ris:"), F.coalesce(F.nullif(title_key, F.lit("")), F.lower(key)), F.lit(":"), y)
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi:"), F.lower(doi))).otherwise(other)


def stem_key(folded_stem: Column) -> Column:
    """A folded file name without the words that tell variants apart."""
    return squeeze(F.regexp_replace(folded_stem, r"\b(pdf|original|impresso|imprimido|browser|site|scaneado|escaneado|ocr)\b", " "))


# Two grammars of a line of citation, and words that no journal's name holds.
LINE_A = r"(?imU)^\s*([A-ZÀ-Ý][^\n]{2,140}?)\s*,?\s*v\.?\s*(\d+)(?:\s*,\s*n\.?\s*([A-Za-z0-9.-]+))?(?:\s*,\s*p\.?\s*(\d+)\s*[-–—]\s*(\d+))?(?:\s*,[^\n]{0,70})?\s*,?\s*((?:19|20)\d{2})\s*$"
LINE_B = r"(?imU)^\s*([A-ZÀ-Ý][^\n]{2,140}?)\s+(\d+)\s*\(((?:19|20)\d{2})\)\s*(?:(\d+)\s*[-–—]\s*(\d+)|([A-Za-z]?\d{4,}))\s*$"
_JOURNAL_NOISE = "abstract|resumo|keywords|palavras chave|research article|review article|original article|received|accepted|doi|http|issn"


def journal_name(c: Column) -> Column:
    """A plausible name of a journal, or null."""
    name = F.trim(squeeze(c), F.lit(" ,;:.-"))
    ok = F.length(name).between(3, 140) & ~F.lower(name).rlike(_JOURNAL_NOISE) & (F.size(F.split(name, " ")) <= 18) & name.rlike("[A-Za-zÀ-ÿ]")
    return F.when(ok, name)


def periodical_fields(text: Column, doi: Column) -> Column:
    """struct of journal, volume, issue, pages, article_number, year, source_url from generic front matter; null where nothing visible supports a value."""
    t = F.substring(text, 1, SEARCH_CHARS)
    a, b = (lambda g: first_match(t, LINE_A, g)), (lambda g: first_match(t, LINE_B, g))
    in_a = a(1).isNotNull()
    cited = lambda x, y: F.when(in_a, a(x) if x else F.lit(None)).otherwise(b(y) if y else F.lit(None))
    span = lambda s, e: F.when(s.isNotNull() & e.isNotNull(), F.concat(s, F.lit("-"), e))
    volume_issue = r"(?iU)\b(?:vol(?:ume)?\.?|v\.?)\s*(\d+)(?:\s*[,;]?\s*(?:no\.?|n\.?|issue)\s*([A-Za-z0-9.-]+))?"
    page = r"(?iU)\b(?:pp?\.?|pages?)\s*(\d+)\s*[-–—]\s*(\d+)"
    explicit = journal_name(first_match(t, r"(?imU)^\s*(?:journal(?:\s+title)?|published\s+in)\s*[:—-]\s*([^\n]{3,140})\s*$", 1))
    lines = F.filter(F.transform(F.split(t, "\n"), squeeze), lambda x: x != "")
    at = F.array_position(F.transform(F.slice(lines, 1, 80), lambda x: x.rlike(r"(?iU)\b(?:e-?ISSN|p-?ISSN|ISSN)\b")), F.lit(True)).cast("int")
    above = F.reverse(F.when(at > 1, F.slice(lines, F.greatest(F.lit(1), at - 3), F.least(F.lit(3), at - 1))))
    near_issn = F.try_element_at(F.filter(F.transform(above, journal_name), lambda j: j.isNotNull()), F.lit(1))
    published = first_match(t, r"(?iU)\b(?:published|publication(?:\s+date)?|available online)\b[^\n]{0,80}?\b((?:19|20)\d{2})\b", 1)
    copyright_year = first_match(t, r"(?iU)(?:©|copyright)\s*((?:19|20)\d{2})", 1)
    dated = F.filter(F.slice(lines, 1, 60), lambda x: ~F.lower(x).rlike("received|accepted|references") & x.rlike(YEAR))
    line_year = F.try_element_at(F.regexp_extract_all(F.try_element_at(dated, F.lit(1)), F.lit(YEAR), F.lit(1)), F.lit(-1))
    return F.struct(
        F.coalesce(journal_name(cited(1, 1)), explicit, near_issn).alias("journal"),
        F.coalesce(cited(2, 2), first_match(t, volume_issue, 1)).alias("volume"),
        F.coalesce(cited(3, 0), first_match(t, volume_issue, 2)).alias("issue"),
        F.coalesce(span(cited(4, 4), cited(5, 5)), span(first_match(t, page, 1), first_match(t, page, 2))).alias("pages"),
        F.coalesce(cited(0, 6), first_match(t, r"(?iU)\b(?:article(?:\s+number)?|art\.?\s*no\.?)\s*[:#]?\s*([A-Za-z]?\d{4,})\b", 1)).alias("article_number"),
        F.coalesce(cited(6, 3), published, copyright_year, line_year).alias("year"),
        first_other_url(t, doi).alias("source_url"),
    )


def first_other_url(text: Column, doi: Column) -> Column:
    """The first URL in a text that isn't the DOI's own."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,;:)")))
    own = doi_selected(doi)
    same = lambda u: F.coalesce(F.contains(F.lower(u), F.lit("doi.org/")) & (doi_selected(u) == own), F.lit(False))
    return F.try_element_at(F.filter(urls, lambda u: ~same(u)), F.lit(1))


def page_doi(texts: Column) -> Column:
    """The first DOI in an array of texts, without signs at its end."""
    found = F.filter(F.transform(texts, lambda t: F.rtrim(F.regexp_extract(t, DOI, 0), F.lit(".,;"))), lambda d: d != "")
    return F.try_element_at(found, F.lit(1))


def between(lines: Column, start: str, end: str) -> Column:
    """The lines after the first one equal to start, up to the next equal to end (or all)."""
    a = F.array_position(lines, start).cast("int")
    rest = F.when(a > 0, F.slice(lines, a + 1, F.size(lines)))
    b = F.array_position(rest, end).cast("int")
    return F.when(b > 0, F.slice(rest, F.lit(1), b - 1)).otherwise(rest)


def without_repeats(lines: Column, key) -> Column:
    """Lines that differ from the one before them by key; a block that is the same half twice becomes the half."""
    once = F.filter(lines, lambda x, i: (i == 0) | (key(x) != key(F.get(lines, F.greatest(i - 1, F.lit(0))))))
    half = (F.size(once) / 2).cast("int")
    twice = (F.size(once) % 2 == 0) & (F.size(once) > 0) & (F.slice(once, F.lit(1), half) == F.slice(once, half + 1, half))
    return F.when(twice, F.slice(once, F.lit(1), half)).otherwise(once)
