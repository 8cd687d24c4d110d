"""What is looked for first, or from nearer by, finds what the whole patterns find."""

import random
import time

from bibspark.functions.fold import match_text
from bibspark.operators import cards, extract
from pyspark.sql import functions as F

WORDS = ["abstract", "ABSTRACT:", "Reſumo", "resumo", "Key  words -", "palavras-chave:", "keywords", "referenceſ", "Referências", "bibliografıa", "BİBLİOGRAPHY", "research article", "short communication", "artıcle in press", "original article", "received", "accepted", "publıshed onlıne", "available online", "date of publication", "ISSN", "İSSN", "ıssn", "vol. 3", "Volume 12", "v. 3, n. 4", "iſſue 7", "issue 9", "pp. 3 - 9", "p. 10–20", "van 5", "proceedings of", "CONFERENCE", "ſeminar", "worKshop", "symposıum", "ISBN-10", "İSBN", "ısbn", "10.1234/ab-c", "10.12", "x", "árvore", "\n", "\n", "\n", " "]


def test_signs_equal_their_patterns(spark):
    r = random.Random(5)
    texts = [*WORDS, *["".join(r.choice(WORDS) + r.choice([" ", "\n", "", "."]) for _ in range(r.randrange(1, 12))) for _ in range(1500)], "", None, "a" * 120_010 + "\nabstract\n conference", "isbn " + "a" * 240_010 + " isbn\nreferences\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("folded", match_text("t"))
    for folded in (None, F.col("folded")):
        got = rows.select("t", extract.article_signals(F.col("t"), F.col("t"), folded=folded).alias("s"))
        want = []
        for n, p in extract.SIGNALS.items():
            own = F.substring("t", 1, extract.WHOLE_CHARS if n in extract.WHOLE else extract.FRONT_CHARS)
            want.append(F.coalesce((match_text(own) if n in extract.FOLDED else own).rlike(p), F.lit(False)).alias(n))
        both = got.select("s", F.struct(*want).alias("w")).filter("s <> w OR s IS NULL").collect()
        assert both == []


def test_thesis_card_equals_its_pattern(spark):
    r = random.Random(6)
    bits = ["Lima, Ana, 1980- ", "A long title of a work of trees ", "/", " / ", "Ana Lima", ". – ", ". - ", "Cidade, MG", ", 2010.", ", 1999.", "x" * 30, "y " * 460, "z" * 880, "𝒳" * 40, "\n", " 88 f. : il.", "É", "/ Ana Lima. – Cidade, MG, 2010. 77 f."]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(2, 14))) for _ in range(1500)] + ["/ Ana Lima. – Cidade, MG, 2010. A title of twenty signs or more / Ana Lima. – Vila, MG, 2011.", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", cards.thesis_card(F.col("t")))
    whole = cards.squeeze(F.col("t"))
    g = lambda n: cards.part(whole, cards.THESIS_CARD, n)
    want = rows.select("c", cards.card_title(g(1)).alias("title"), cards.squeeze(g(2)).alias("author"), cards.squeeze(g(3)).alias("place"), g(4).alias("year")).collect()
    assert [(x.c.title, x.c.author, x.c.place, x.c.year) for x in want] == [(x.title, x.author, x.place, x.year) for x in want]
    assert sum(x.year is not None for x in want) > 100


def test_long_text_without_card_takes_no_time_of_every_place(spark):
    rows = spark.range(8).select(F.repeat(F.lit("words of a text that goes on and on "), 10_000).alias("t")).cache()
    rows.count()
    began = time.time()
    got = rows.select(cards.thesis_card(F.col("t")).alias("c")).collect()
    assert {x.c.title for x in got} == {None} and time.time() - began < 10


def test_pieces_of_a_reference_stand_in_no_lambda(spark):
    from bibspark.plans import render

    rows = spark.createDataFrame([(" a.", None, "", "b "), (None, None, "", " "), ("x", "y", " z ", None)], "a string, b string, c string, d string")
    got = rows.select(render.joined([F.col(c) for c in "abcd"]).alias("r"))
    assert [r.r for r in got.collect()] == ["a. b", "", "x y z"]
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
