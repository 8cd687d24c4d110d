"""Native text expressions of the bibliographic rules.  Every function takes and gives columns; null stays null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of the months and the words that stand for each month.
MONTHS = ("jan.", "fev.", "mar.", "abr.", "maio", "jun.", "jul.", "ago.", "set.", "out.", "nov.", "dez.")
MONTH_WORDS = (
    ("january", "jan", "janeiro"),
    ("february", "feb", "fevereiro"),
    ("march", "mar", "março", "marco"),
    ("april", "apr", "abril"),
    ("may", "maio"),
    ("june", "jun", "junho"),
    ("july", "jul", "julho"),
    ("august", "aug", "agosto"),
    ("september", "sep", "setembro"),
    ("october", "oct", "outubro"),
    ("november", "nov", "novembro"),
    ("december", "dec", "dezembro"),
)
RESOLVER = r"(?i)^https?://(?:dx\.)?doi\.org/"


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_terminal(c: Column) -> Column:
    """Without full stops, semicolons, commas and spaces at the end; null gives an empty string."""
    return F.coalesce(F.rtrim(strip(c), F.lit(".;, ")), F.lit(""))


def sentence(c: Column) -> Column:
    """The text with one full stop, or null where nothing is left."""
    bare = strip_terminal(c)
    return F.when(bare != "", F.concat(bare, F.lit(".")))


def page_range(c: Column) -> Column:
    return F.regexp_replace(F.rtrim(strip(c), F.lit(".")), r"(?U)\s*(?:--+|[–—])\s*", "-")


def doi_plain(c: Column) -> Column:
    """Resolver prefix and full stops at the end go; case stays."""
    return F.nullif(F.rtrim(strip(F.regexp_replace(strip(c), RESOLVER, "")), F.lit(".")), F.lit(""))


def doi_key(c: Column) -> Column:
    """Key of classified documents: prefix and any of . , ; at the end go, lower case; null gives an empty string."""
    return F.coalesce(F.lower(F.rtrim(F.regexp_replace(strip(c), RESOLVER, ""), F.lit(".,;"))), F.lit(""))


def doi_selected(c: Column) -> Column:
    """Key of resolved fields: also a leading doi: goes."""
    bare = F.regexp_replace(strip(c), r"(?i)^(?:doi\s*:\s*)?https?://(?:dx\.)?doi\.org/", "")
    bare = F.regexp_replace(bare, r"(?i)^doi\s*:\s*", "")
    return F.nullif(F.lower(F.rtrim(strip(bare), F.lit(".;, "))), F.lit(""))


def doi_from_url(c: Column) -> Column:
    """The DOI of a URL of the resolver, null for other URLs."""
    return F.when(strip(c).rlike(RESOLVER), doi_selected(c))


def doi_url(c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit("https://doi.org/"), F.regexp_replace(F.rtrim(strip(c), F.lit(".")), RESOLVER, "")))


def doi_identifier(c: Column) -> Column:
    """The DOI that a URL or bare identifier names, percent signs decoded; null where the host isn't the resolver."""
    bare = F.coalesce(F.try_url_decode(F.replace(F.rtrim(strip(c), F.lit(".;, ")), F.lit("+"), F.lit("%2B"))), c)

    def named(url: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
        path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        return F.when(host.isin("doi.org", "dx.doi.org"), F.nullif(F.lower(strip(F.ltrim(path, F.lit("/")))), F.lit("")))

    return let(let(bare, lambda x: F.when(F.contains(x, F.lit("://")), x).otherwise(F.concat(F.lit("https://doi.org/"), x))), named)


def month(c: Column) -> Column:
    """Portuguese abbreviation of a month or range of months in words; what names no month passes through."""
    table = F.create_map(*[F.lit(x) for i, words in enumerate(MONTH_WORDS) for w in words for x in (w, i + 1)])
    names = F.array(*[F.lit(m) for m in MONTHS])
    tokens = F.transform(F.split(c, "[/–-]"), lambda t: F.lower(F.regexp_replace(t, "[^A-Za-zÀ-ÿ]", "")))
    found = F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda n: n.isNotNull())

    def named(n: Column) -> Column:
        first, last = F.element_at(names, F.try_element_at(n, F.lit(1))), F.element_at(names, F.try_element_at(n, F.lit(-1)))
        return F.when(F.size(n) == 0, strip(c)).when(F.size(n) == 1, first).otherwise(F.concat(first, F.lit("/"), last))

    return F.when(c != "", let(found, named))


def date_in_words(c: Column) -> Column:
    """d mon. yyyy of an ISO date; other texts pass without full stops at the end."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    digits = lambda at, n: F.substring(c, at, n).try_cast("int")
    is_date = c.rlike(r"^\d{4}-\d{2}-\d{2}\z") & c.try_cast("date").isNotNull()
    return F.when(c.isNull() | ~is_date, F.rtrim(c, F.lit("."))).otherwise(F.concat_ws(" ", digits(9, 2).cast("string"), F.try_element_at(names, digits(6, 2)), digits(1, 4).cast("string")))


def embedded_place(c: Column) -> Column:
    return F.when(c.isNull() | (F.lower(c) == "[s. l.]") | (c == ""), F.lit("[s. l.]")).otherwise(c)


def has_unit(c: Column) -> Column:
    return c.rlike(r"(?i)\b(?:p|f|v|vol)\.?$")


def corporate(c: Column) -> Column:
    """Upper case up to the first full stop, as a jurisdiction heads the name."""
    bare = F.rtrim(strip(c), F.lit("."))
    return F.when(F.contains(bare, F.lit(".")), F.concat(F.upper(F.substring_index(bare, ".", 1)), F.expr("'.'"), F.regexp_replace(bare, r"(?s)^[^.]*\.", ""))).otherwise(bare)


def with_suffix(year: Column, suffix: Column) -> Column:
    """The year letter follows only a year of four digits at the end; an absent year shows as unknown."""
    value = F.coalesce(year, F.lit("[s. d.]"))
    return F.when((F.coalesce(suffix, F.lit("")) != "") & value.rlike(r"\b(?:18|19|20|21)\d{2}$"), F.concat(value, suffix)).otherwise(value)


def letters(index: Column) -> Column:
    """a, b, ..., z, aa, ...: bijective base 26 of a number from 0."""
    letter = lambda n: F.char((n + 97).cast("int"))
    steps = lambda i: F.struct(F.concat(letter(i % 26), F.lit("")).alias("done"), (F.floor(i / 26) - 1).cast("long").alias("left"))
    i = index.cast("long")
    more = F.aggregate(F.sequence(F.lit(1), F.lit(12)), steps(i), lambda a, _: F.when(a["left"] < 0, a).otherwise(F.struct(F.concat(letter(a["left"] % 26), a["done"]).alias("done"), (F.floor(a["left"] / 26) - 1).cast("long").alias("left"))))
    return more["done"]


def join_wrapped(lines: Column) -> Column:
    """Lines as one text: a hyphen at a line's end goes where the next line begins with a small letter."""
    step = lambda a, x: F.when(a == "", x).when(a.rlike("-$") & x.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), x)).otherwise(F.concat(a, F.lit(" "), x))
    return F.aggregate(lines, F.lit(""), step)
