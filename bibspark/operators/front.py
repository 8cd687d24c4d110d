"""Titles, authors and citations from the lines of a work's front matter, and from pages printed out of a browser.

All is native over an array of lines: a layout finds the lines that mark its parts, reads what lies between them, and matches its
citation.  Nothing is inferred that the lines don't show.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibspark.functions.text import join_wrapped, let, squeeze

# Words and patterns by which parts are known.
PARTICLES = ("da", "das", "de", "do", "dos", "e")
LOWER_IN_NAMES = ("de", "da", "do", "dos", "das", "van", "von")
ABSTRACTS = ("abstract", "resumo")
NOISE = r"(?iU)\b(?:abstract|resumo|keywords?|palavras[- ]chave|doi|issn|volume|issue|received|accepted|published|references)\b"
LINKED = r"(?iU)https?://|10\.\d{4,9}/"
YEARS = r"(?U)\b(?:19|20)\d{2}\b"
AUTHORS_APART = r"(?iU)\s*(?:;|\band\b|\be\b|&)\s*"
VOLUME = r"(?iU)\b(?:vol(?:ume)?\.?|v\.?)\s*\d+"
ISSN = r"(?iU)\b(?:e-?ISSN|p-?ISSN|ISSN)\b"
LABELS = ("research article", "review article", "original article", "article")
WORD = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.'’\-]*"
PAGE_NOISE = ("cite this article", "you have full access", "accesses", "citations", "altmetric", "explore all metrics", "open access")
STOPS = ("resumo", "abstract", "text", "acknowledgements", "references", "edited by", "publication dates", "history")
VOLUME_LINE = r"(?i)\bVolume\s+(\d+)\s*,\s*(?:article\s+number\s+(\d+)|pages?\s+(\d+)\s*[-–—]\s*(\d+))\s*\((\d{4})\)"
DATED_LINE = r"(?i)\bPublished:\s*\d{1,2}\s+\w+\s+\d{4}\b"
MONTH_LINE = r"(?iU)\bVolume\s+(\d+)\s*,\s*([A-Za-z]+)\s+(\d{4})\s*,\s*Pages?\s+(\d+)\s*[-–—]\s*(\d+)"
THESIS_LINE = r"(?iu)^(.+?)\.\s+(.+?)\.\s+(\d{4})\.\s+(\d+)\s*f\.\s+(Tese|Dissertação)\s*\(([^)]+)\)\s*[-–—]\s*(.+?),\s*([^.]+)\.\s*\3\.?$"
ISSUE_LINE = r"(\d+)\s*\((\d+)\).*?([A-Za-z]+(?:[-/][A-Za-z]+)?)\s+((?:19|20)\d{2})"
DOI_URL = r"(?i)https?://doi\.org/10\.\S+"
ACCENTED, BARE = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"

NO_LINES = "cast(array() as array<string>)"


def lines_of(text: Column) -> Column:
    """The lines that hold anything, with single spaces."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), squeeze), lambda x: x != "")


def plain(c: Column) -> Column:
    """Small letters without the accents of western languages: for comparing with labels inside arrays, where no Unicode table is at hand."""
    return F.translate(F.lower(c), ACCENTED, BARE)


def found(lines: Column, test, after: Column | int = 0) -> Column:
    """Place, from 1, of the first line beyond place `after` that passes; null if none does."""
    return F.nullif(F.array_position(F.transform(lines, lambda x, i: F.coalesce(test(x), F.lit(False)) & (i >= after)), F.lit(True)), F.lit(0)).cast("int")


def within(lines: Column, first: Column, last: Column) -> Column:
    """The lines between two places, both left out."""
    return F.when(last - first > 1, F.slice(lines, first + 1, last - first - 1)).otherwise(F.expr(NO_LINES))


def labelled(lines: Column, start: str, end: str) -> Column:
    """The lines from after the label start up to the next label end, or to the last."""

    def between(a: Column) -> Column:
        b = found(lines, lambda x: plain(x) == end, a)
        return F.when(a.isNull(), F.expr(NO_LINES)).otherwise(within(lines, a, F.coalesce(b, F.size(lines) + 1)))

    return let(found(lines, lambda x: plain(x) == start), between)


def part(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_link(lines: Column) -> Column:
    hits = F.filter(F.transform(lines, lambda x: F.rtrim(F.regexp_extract(x, DOI_URL, 0), F.lit(".,;)"))), lambda u: u != "")
    return F.try_element_at(hits, F.lit(1))


def person_name(value: Column) -> Column:
    """A name of an author line without links, notes, marks and single initials that hang on."""
    for pattern, new in ((r"(?i)https?://\S+.*$", ""), (r"(?i)\b(?:Show more|Share|Cite|Get rights).*$", ""), (r"[\d*†‡#ºª©®™?¿“”‘’]+", " "), (r"^\s+|\s+$", ""), (r"\s+[A-Z]{1,3}$", ""), (r"[^A-Za-zÀ-ÿ.'’\-\s]", " ")):
        value = F.regexp_replace(value, pattern, new)
    return squeeze(value)


def person_list(value: Column) -> Column:
    """The names of an author line, joined by semicolons; single words are left out, null if none is left."""
    names = F.transform(F.split(value, r"\s*(?:,|&|;|·|•)\s*"), person_name)
    return F.nullif(F.array_join(F.filter(names, lambda n: F.size(F.split(n, " ")) >= 2), "; "), F.lit(""))


def person_case(value: Column) -> Column:
    """Words all in capitals in the usual case, particles within small."""
    part_of = lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))
    usual = lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), F.array_join(F.transform(F.split(w, "-"), part_of), "-")).otherwise(w)
    return F.array_join(F.transform(F.split(squeeze(value), " "), lambda w, i: let(usual(w), lambda u: F.when((i > 0) & F.lower(u).isin(*PARTICLES), F.lower(u)).otherwise(u))), " ")


def uninverted(value: Column) -> Column:
    """SURNAME, Given as Given Surname."""
    name = squeeze(value)
    return person_case(F.when(F.contains(name, F.lit(",")), F.concat(F.regexp_replace(name, r"^[^,]*,", ""), F.lit(" "), F.substring_index(name, ",", 1))).otherwise(name))


def names_people(line: Column) -> Column:
    """Whether a line separates at least two names of two words or more."""
    people = F.filter(F.split(line, r"\s*(?:,|&|;)\s*"), lambda p: F.regexp_count(person_name(p), F.lit(WORD)) >= 2)
    return line.rlike("[&,;]") & (F.size(people) >= 2)


def looks_like_authors(line: Column) -> Column:
    """Whether a line of front matter can be its authors: one to twenty names of up to six words, each with a capital or a particle."""
    tidy = lambda p: F.trim(p, F.lit(" ,.*†‡0123456789"))
    held = lambda parts: F.filter(F.transform(parts, tidy), lambda p: p != "")
    named = lambda p: let(F.filter(F.split(p, " "), lambda w: w != ""), lambda ws: F.size(ws).between(1, 6) & F.forall(ws, lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin(*LOWER_IN_NAMES)))
    people = lambda parts: F.size(parts).between(1, 20) & F.forall(parts, named)
    apart = let(held(F.split(line, AUTHORS_APART)), lambda p: people(F.when((F.size(p) < 2) & F.contains(line, F.lit(",")), held(F.split(line, ","))).otherwise(p)))
    return F.length(line).between(5, 240) & ~line.rlike(NOISE) & ~line.rlike(LINKED) & ~line.rlike(YEARS) & apart


def looks_like_title(line: Column, citation: tuple[str, ...] = ()) -> Column:
    """Whether a line of front matter can be of its title; citation holds the grammars of lines that cite a journal."""
    told = F.lit(False)
    for pattern in citation:
        told = told | line.rlike(pattern)
    return F.length(line).between(5, 260) & ~line.rlike(NOISE) & ~line.rlike(ISSN) & ~line.rlike(LINKED) & ~told & ~plain(line).isin(*LABELS) & ~(line.rlike(VOLUME) & line.rlike(YEARS)) & (F.size(F.split(line, " ")) >= 3)


def title_and_authors(lines: Column, citation: tuple[str, ...] = ()) -> Column:
    """struct(title, authors) of the lines before the abstract: the first author line and up to three title lines of the four above it; nulls where there is none."""

    def read(front: Column) -> Column:
        def above(at: Column) -> Column:
            first = F.greatest(F.lit(1), at - 4)
            own = F.filter(F.slice(front, first, at - first), lambda x: looks_like_title(x, citation))
            title = F.when(F.size(own) > 0, F.array_join(F.slice(own, F.greatest(F.lit(1), F.size(own) - 2), F.lit(3)), " "))
            return F.struct(title.alias("title"), F.when(title.isNotNull(), F.element_at(front, at)).alias("authors"))

        return let(found(front, looks_like_authors), lambda at: F.when(at.isNotNull(), above(at)))

    first = F.slice(lines, 1, 50)
    return let(F.slice(first, F.lit(1), F.coalesce(found(first, lambda x: plain(x).isin(*ABSTRACTS)) - 1, F.size(first))), read)


# Pages printed out of a browser.

PRINTED = ("title", "authors", "journal", "place", "year", "month", "volume", "issue", "pages", "article_number", "source_url", "institution", "degree", "total_pages")


def _printed(profile: str, **values: Column) -> Column:
    return F.struct(F.lit(profile).alias("profile"), *[values.get(n, F.lit(None)).cast("string").alias(n) for n in PRINTED], values.get("author_visibility", F.lit("visible")).alias("author_visibility"))


def shown_title(lines: Column) -> Column:
    return F.nullif(F.regexp_replace(squeeze(join_wrapped(lines)), r"(?i):\s+A\s+review$", ": a review"), F.lit(""))


def without_button(line: Column) -> Column:
    """A heading without the sign or letters of a button after it."""
    return F.trim(F.regexp_replace(F.regexp_replace(squeeze(line), r"\s+[A-Z]{1,2}$", ""), r"\s*[^A-Za-zÀ-ÿ0-9.)]+$", ""))


def _span(line: Column, pattern: str, first: int, last: int) -> Column:
    return F.concat(part(line, pattern, first), F.lit("-"), part(line, pattern, last))


def publisher_link_page(lines: Column) -> Column:
    head = found(lines, lambda x: F.contains(x, F.lit("SPRINGER NATURE Link")))
    volume = found(lines, lambda x: x.rlike(r"(?i)\bVolume\s+\d+\b"))
    title_end = F.coalesce(found(lines, lambda x: x.rlike(DATED_LINE)), volume)
    line = F.coalesce(F.get(lines, volume - 1), F.lit(""))
    begin = F.coalesce(volume, F.lit(0))
    end = F.coalesce(found(lines, lambda x: F.lower(x) == "abstract") - 1, F.least(F.size(lines), begin + 12))
    part_lines = F.when(end > begin, F.slice(lines, begin + 1, end - begin)).otherwise(F.expr(NO_LINES))
    noise = lambda x: plain(x).rlike("|".join(PAGE_NOISE)) | ~x.rlike("[A-Za-zÀ-ÿ]")
    worded = lambda x: (F.length(x) <= 140) & ~x.rlike("[<>]") & let(F.regexp_extract_all(x, F.lit(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.&-]*"), F.lit(0)), lambda ws: F.size(ws).between(1, 12) & F.exists(ws, lambda w: F.length(F.trim(w, F.lit(".&-"))) >= 4))

    def read(body: Column) -> Column:
        at = found(body, names_people)
        above = F.filter(F.slice(body, F.lit(1), F.coalesce(at - 1, F.lit(0))), lambda x: ~noise(x) & worded(x))
        title = F.when(title_end > head, shown_title(within(lines, head, title_end)))
        return _printed("springer_nature_web_print", title=title, authors=person_list(F.get(body, at - 1)), journal=F.try_element_at(above, F.lit(-1)), year=part(line, VOLUME_LINE, 5), volume=part(line, VOLUME_LINE, 1), pages=_span(line, VOLUME_LINE, 3, 4), article_number=part(line, VOLUME_LINE, 2))

    return let(part_lines, read)


def journal_portal_page(lines: Column) -> Column:
    head = found(lines, lambda x: F.lower(x) == "sciencedirect")
    cited = found(lines, lambda x: x.rlike(r"(?iU)\bVolume\s+\d+\s*,\s*\w+\s+\d{4}\s*,\s*Pages?\s+\d+"))
    line = F.coalesce(F.get(lines, cited - 1), F.lit(""))
    more = found(lines, lambda x: F.startswith(F.lower(x), F.lit("show more")))

    def read(body: Column) -> Column:
        at = found(body, names_people)
        title = F.when(at.isNotNull(), shown_title(F.slice(body, F.lit(1), at - 1)))
        authors = F.when(at.isNotNull(), person_list(F.array_join(F.slice(body, F.coalesce(at, F.lit(1)), F.size(body)), " ")))
        return _printed("sciencedirect_web_print", title=title, authors=authors, journal=without_button(F.get(lines, head)), year=part(line, MONTH_LINE, 3), month=part(line, MONTH_LINE, 2), volume=part(line, MONTH_LINE, 1), pages=_span(line, MONTH_LINE, 4, 5), source_url=first_link(lines))

    return let(F.coalesce(within(lines, cited, more), F.expr(NO_LINES)), read)


def repository_page(lines: Column, place_names: dict[str, str] | None = None) -> Column:
    """place_names: places in small bare letters and how they are shown."""
    cited = squeeze(join_wrapped(labelled(lines, "citacao", "uri")))
    link = F.regexp_replace(F.try_element_at(F.filter(labelled(lines, "uri", "colecoes"), lambda x: x.rlike("(?i)^https?://")), F.lit(1)), r"^(https?://[^/]+)//", "$1/")

    def read(line: Column) -> Column:
        g = lambda n: part(line, THESIS_LINE, n)
        place = squeeze(g(8))
        for bare, shown in (place_names or {}).items():
            place = F.when(plain(place) == bare, F.lit(shown)).otherwise(place)
        degree = F.concat(F.initcap(g(5)), F.lit(" ("), squeeze(g(6)), F.lit(")"))
        whole = _printed("locus_repository_web_print", title=shown_title(F.array(g(2))), authors=uninverted(g(1)), place=place, year=g(3), source_url=link, institution=squeeze(g(7)), degree=degree, total_pages=g(4))
        files = found(lines, lambda x: F.lower(x) == "arquivos")
        above = F.when(files.isNotNull(), F.slice(lines, F.greatest(F.lit(1), files - 6), files - F.greatest(F.lit(1), files - 6)))
        last = F.array_max(F.transform(above, lambda x, i: F.when(plain(x).rlike("inicio e teses") | F.endswith(x, F.lit("...")) | plain(x).isin("q", "e"), i + 1).otherwise(0)))
        heading = F.when(F.size(above) > last, shown_title(F.slice(above, last + 1, F.size(above))))
        year = part(F.array_join(labelled(lines, "data", "autores"), " "), YEARS)
        bits = _printed("locus_repository_web_print", title=heading, authors=uninverted(F.try_element_at(labelled(lines, "autores", "editor"), F.lit(1))), year=year, source_url=link, institution=F.try_element_at(labelled(lines, "editor", "resumo"), F.lit(1)))
        return F.when(line.rlike(THESIS_LINE), whole).otherwise(bits)

    return let(cited, read)


def open_journal_page(lines: Column, journals: tuple[str, ...], place: str | None = None) -> Column:
    """journals: names in small letters by which a journal's line is known; place: one that such a line may state."""
    doi = found(lines, lambda x: F.contains(F.lower(x), F.lit("doi.org/10.")))
    mark = found(lines, lambda x: F.lower(x).rlike("^(?:autoria|authorship)"))
    raw = squeeze(join_wrapped(within(lines, doi, mark)))
    for pattern in (r"^[^A-Za-zÀ-ÿ0-9]+", r"^[A-Za-zÀ-ÿ]\s+(?=[A-ZÀ-Ý])"):
        raw = F.regexp_replace(raw, pattern, "")
    title = F.when(mark > doi, shown_title(F.array(F.element_at(F.split(raw, r"\s+(?:=|©)\s+(?=[A-ZÀ-Ý])", 2), 1))))
    named = F.filter(F.slice(lines, 1, 8), lambda x: F.lower(x).rlike("|".join(j.replace(".", r"\.") for j in journals)))
    line = F.coalesce(F.try_element_at(F.filter(F.slice(lines, 1, 12), lambda x: x.rlike(r"\b\d+\s*\(\d+\).*\b(19|20)\d{2}\b")), F.lit(1)), F.lit(""))

    def read(after: Column) -> Column:
        stop = found(after, lambda x: plain(x).isin(*STOPS) | plain(x).rlike("scimago institutions rankings"))
        people = F.filter(F.slice(after, F.lit(1), F.coalesce(stop - 1, F.size(after))), names_people)
        authors = F.when(F.size(people) > 0, person_list(F.array_join(people, " ")))
        g = lambda n: part(line, ISSUE_LINE, n)
        where = part(line, rf"(?i)\(({place}),\s*Braz\.\)", 1) if place else F.lit(None)
        seen = F.when(F.size(people) > 0, "visible").otherwise("collapsed_or_absent")
        return _printed("scielo_web_print", title=title, authors=authors, journal=without_button(F.try_element_at(named, F.lit(1))), place=where, year=g(4), month=g(3), volume=g(1), issue=g(2), source_url=first_link(lines), author_visibility=seen)

    return let(F.when(mark.isNotNull(), F.slice(lines, mark + 1, F.lit(7))).otherwise(F.expr(NO_LINES)), read)


def web_print(text: Column, *, journals: tuple[str, ...] = (), place: str | None = None, place_names: dict[str, str] | None = None) -> Column:
    """struct of profile, the PRINTED fields and author_visibility for text of a page of a known layout; null for other text."""
    whole = plain(F.regexp_replace(text, r"(?U)\s+", " "))
    has = lambda *marks: reduce_and([F.contains(whole, F.lit(m)) for m in marks])

    def read(lines: Column) -> Column:
        portal = F.exists(F.slice(lines, 1, 5), lambda x: F.lower(x) == "sciencedirect")
        open_journal = has("scimago institutions rankings", "doi.org/10.") & whole.rlike("autoria|authorship")
        return (
            F.when(has("springer nature link"), publisher_link_page(lines))
            .when(portal, journal_portal_page(lines))
            .when(has("locus", "citacao", "uri"), repository_page(lines, place_names))
            .when(open_journal, open_journal_page(lines, journals or ("(?!)",), place))
        )

    return let(lines_of(text), read)


def reduce_and(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
