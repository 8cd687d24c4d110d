"""Names of persons, natively: arrays of struct<full, family, given>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibspark.functions.text import let, squeeze

# What marks affiliations, suffixes that stay with the surname, particles.
AFFILIATIONS = ("universidade", "department", "departamento", "faculdade", "institute", "laboratory")
SUFFIXES = ("filho", "júnior", "junior", "neto", "sobrinho")
INTEGRAL = ("le", "la", "lo", "van", "von")
PARTICLES = ("da", "das", "de", "do", "dos", "e")
MARKERS = r"(?iu)(?:\d+(?:,\d+)*)|[*†‡#]+|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+"
NO_ONE = "cast(array() as array<struct<full:string,family:string,given:string>>)"


def _person(full: Column, family: Column, given: Column) -> Column:
    return F.struct(full.alias("full"), family.alias("family"), given.alias("given"))


def usual_case(name: Column) -> Column:
    """A name all in capitals in the usual case; particles small but at the beginning.  Other names stay."""
    part = lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))
    word = lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-")
    words = F.transform(F.split(name, r"\s+"), lambda w, i: F.when((i > 0) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(word(w)))
    return F.when((F.upper(name) == name) & (F.lower(name) != name), F.array_join(words, " ")).otherwise(name)


def natural(name: Column) -> Column:
    """struct of a name in natural order, null for a single word: the surname is the last word, or the last two with a suffix or an integral particle."""

    def split(words: Column) -> Column:
        n = F.size(words)
        two = F.lower(F.try_element_at(words, F.lit(-1))).isin(*SUFFIXES) | F.lower(F.try_element_at(words, F.lit(-2))).isin(*INTEGRAL)
        k = F.when(two, 2).otherwise(1)
        return F.when(n >= 2, _person(F.array_join(words, " "), F.array_join(F.slice(words, n - k + 1, k), " "), F.array_join(F.slice(words, F.lit(1), n - k), " ")))

    return let(F.split(usual_case(name), r"(?U)\s+"), split)


def from_line(line: Column) -> Column:
    """The persons of an author line: marks of affiliation go, and, e, &, ; and dots separate, affiliations are left out."""
    text = F.translate(line, "  ", "  ")
    text = F.regexp_replace(text, MARKERS, "")
    text = F.regexp_replace(text, r"(?iu)\s+[a-d](?:,[a-d])*(?=\s*[,;]|\s*$)", "")
    text = F.regexp_replace(text, r"(?iuU)\s+(?:and|e)\s+|\s*&\s*|\s*[;·•]\s*", ", ")
    parts = F.transform(F.split(F.trim(squeeze(text), F.lit(" ,")), ","), lambda p: F.trim(p, F.lit(" ,")))
    marked = lambda p: F.lower(p).rlike("|".join(AFFILIATIONS)) | F.contains(p, F.lit("@"))
    people = F.transform(F.filter(parts, lambda p: (p != "") & ~marked(p)), natural)
    return F.coalesce(F.filter(people, lambda p: p.isNotNull()), F.expr(NO_ONE))


def inverted(name: Column, *, family_only: bool = False) -> Column:
    """struct of SURNAME, given; null where a side is missing (a missing given name may be allowed)."""
    family = F.trim(F.substring_index(name, ",", 1))
    given = F.trim(F.regexp_replace(name, r"(?s)^[^,]*,", ""))
    full = F.trim(F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(family, F.lit(""))))
    return F.when((family != "") & (F.lit(family_only) | (given != "")), _person(full, family, given))


def reviewed(value: Column) -> Column:
    """Persons of a reviewed value: parts between semicolons, inverted or natural; null where any part isn't one person."""
    parts = F.filter(F.transform(F.split(value, ";"), lambda p: F.trim(squeeze(p), F.lit(" ,"))), lambda p: p != "")
    one = lambda p: F.when(F.contains(p, F.lit(",")), inverted(p)).otherwise(let(from_line(p), lambda q: F.when(F.size(q) == 1, F.get(q, F.lit(0)))))
    whole = let(F.transform(parts, one), lambda q: F.when(~F.exists(q, lambda p: p.isNull()), q))
    return F.when(value.isNull() | (value == ""), F.expr(NO_ONE)).otherwise(whole)


def of_values(values: Column) -> Column:
    """Persons of several reviewed values; a value that can't be read is left out."""
    return F.coalesce(F.flatten(F.filter(F.transform(values, reviewed), lambda p: p.isNotNull())), F.expr(NO_ONE))


def listed(values: Column, *, family_only: bool = False) -> Column:
    """Persons of a list of names, each inverted or in natural order."""
    cleaned = F.filter(F.transform(values, squeeze), lambda v: v != "")
    each = lambda v: F.when(F.contains(v, F.lit(",")) & inverted(v, family_only=family_only).isNotNull(), F.array(inverted(v, family_only=family_only))).when(F.contains(v, F.lit(",")) & F.lit(not family_only), F.expr(NO_ONE)).otherwise(from_line(v))
    return F.coalesce(F.flatten(F.transform(cleaned, each)), F.expr(NO_ONE))


def shown(values: Column, *, all_names: bool = True) -> Column:
    """SURNAME, given; SURNAME, given.  From four persons on the first alone with et al., unless all are wanted; values that can't be read show as they are."""
    from bibspark.functions.text import strip_terminal

    plain = F.array_join(F.transform(values, strip_terminal), "; ")

    def text(people: Column) -> Column:
        many = (F.size(people) >= 4) if not all_names else F.lit(False)
        chosen = F.when(many, F.slice(people, 1, 1)).otherwise(people)
        listed = F.array_join(F.transform(chosen, lambda p: F.rtrim(F.concat(F.upper(p["family"]), F.lit(", "), p["given"]), F.lit(", "))), "; ")
        return F.when(F.size(people) > 0, F.rtrim(F.concat(listed, F.when(many, F.lit(" et al.")).otherwise("")), F.lit("."))).otherwise(plain)

    return let(of_values(values), text)
