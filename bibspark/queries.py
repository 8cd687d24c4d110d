"""The reference operators as queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark import layout_queries
from bibspark.functions import names, text
from bibspark.functions.fold import match_text, title_key, word_key
from bibspark.operators import cards, extract, front, gate, ledger, link, records, resolve, review, store
from bibspark.operators.rounds import components
from bibspark.plans import compile as compiled
from bibspark.plans import render as layouts
from bibspark.plans import schemas
from bibspark.sources import bibtex, inventory, pages, ris

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL parts that stand for functions of the library.

FOLD = "trim(regexp_replace(strip_accents(replace(lower({0}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
MATCH = "trim(regexp_replace(strip_accents(replace(lower({0}), 'ß', 'ss')), '\\s+', ' ', 'g'))"
STRIP = "rtrim(trim({0}), '.;, ')"


# a to z, aa to zz, then three letters and four.
_SUFFIX_SQL = """CASE WHEN i < 26 THEN chr(CAST(97 + i AS INT)) WHEN i < 702 THEN chr(CAST(96 + i // 26 AS INT)) || chr(CAST(97 + i % 26 AS INT))
  WHEN i < 18278 THEN chr(CAST(97 + (i - 702) // 676 AS INT)) || chr(CAST(97 + (i - 702) // 26 % 26 AS INT)) || chr(CAST(97 + (i - 702) % 26 AS INT))
  ELSE chr(CAST(97 + (i - 18278) // 17576 AS INT)) || chr(CAST(97 + (i - 18278) // 676 % 26 AS INT)) || chr(CAST(97 + (i - 18278) // 26 % 26 AS INT)) || chr(CAST(97 + (i - 18278) % 26 AS INT)) END"""


# Normalisation and keys.


@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS title_key, md5({MATCH.format('text')}) AS match_text FROM documents")
def norm_text_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(title_key("text")).alias("title_key"), F.md5(match_text("text")).alias("match_text"))


@query(f"""
SELECT page_id, 'title:' || {FOLD.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} || '|year:' || CAST(1990 + page_id % 30 AS VARCHAR) AS pdf_key,
  CASE WHEN page_id % 3 = 0 THEN 'doi:10.' || CAST(1000 + page_id % 50 AS VARCHAR) || '/p.' || CAST(page_id AS VARCHAR) ELSE 'title:' || {FOLD.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} || '|year:' || CAST(1990 + page_id % 30 AS VARCHAR) END AS bibtex_key,
  CASE WHEN page_id % 3 = 0 THEN 'doi:10.' || CAST(1000 + page_id % 50 AS VARCHAR) || '/p.' || CAST(page_id AS VARCHAR) ELSE 'ris:' || {FOLD.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} || ':' || CAST(1990 + page_id % 30 AS VARCHAR) END AS ris_key
FROM pages""")
def canonical_keys(spark, sf_dir):
    """Keys of duplicates of a page's title, a year and, for each third page, a DOI."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.lit(1990) + F.col("page_id") % 30).cast("string").alias("year"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://doi.org/10."), (1000 + F.col("page_id") % 50).cast("string"), F.lit("/P."), F.col("page_id").cast("string"), F.lit("."))).alias("doi"))
    rows = rows.withColumn("tk", title_key("title")).withColumn("wk", word_key("title"))
    doi = text.doi_plain(F.col("doi"))
    return rows.select("page_id", extract.canonical_key(F.col("wk"), F.col("year"), text.doi_key(F.col("doi")), F.lit("")).alias("pdf_key"), extract.entry_key("bibtex", doi, F.col("tk"), F.col("year"), F.col("title")).alias("bibtex_key"), extract.entry_key("ris", doi, F.col("tk"), F.col("year"), F.col("title")).alias("ris_key"))


@query("""
SELECT k, lower(rtrim(regexp_replace(d, '^https?://(dx\\.)?doi\\.org/', '', 'i'), '.,;')) AS classified, regexp_replace(regexp_replace(rtrim(regexp_replace(regexp_replace(d, '^https?://(dx\\.)?doi\\.org/', '', 'i'), '^doi: ', '', 'i'), '.;, '), '^DOI: ', ''), 'X', 'x', 'g') AS selected,
  'https://doi.org/' || regexp_replace(rtrim(d, '.'), '^https?://(dx\\.)?doi\\.org/', '', 'i') AS url
FROM (SELECT p_partkey AS k, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'HTTP://dx.doi.org/' WHEN 2 THEN 'doi: ' ELSE '' END || '10.1000/X' || CAST(p_partkey AS VARCHAR) || CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '.' WHEN 1 THEN '' ELSE '..' END AS d FROM part)""")
def doi_forms(spark, sf_dir):
    k = F.col("p_partkey")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("https://doi.org/", "HTTP://dx.doi.org/", "doi: ", "")]), (k % 4 + 1).cast("int"))
    tail = F.element_at(F.array(F.lit("."), F.lit(""), F.lit("..")), (k % 3 + 1).cast("int"))
    d = F.concat(prefix, F.lit("10.1000/X"), k.cast("string"), tail)
    return table(spark, sf_dir, "part").select(k.alias("k"), text.doi_key(d).alias("classified"), text.doi_selected(d).alias("selected"), text.doi_url(d).alias("url"))


_MONTH_SQL = "CASE {0} " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(text.MONTHS)) + " END"


@query(f"""
SELECT o_orderkey, {_MONTH_SQL.format("month(o_orderdate)")} AS one, {_MONTH_SQL.format("month(o_orderdate)")} || '/' || {_MONTH_SQL.format("12")} AS span, CAST(day(o_orderdate) AS VARCHAR) || ' ' || {_MONTH_SQL.format("month(o_orderdate)")} || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS accessed, 'issue ' || CAST(o_orderkey AS VARCHAR) AS other FROM orders""")
def month_names(spark, sf_dir):
    name = F.date_format("o_orderdate", "MMMM")
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", text.month(name).alias("one"), text.month(F.concat(name, F.lit("–dezembro"))).alias("span"), text.date_in_words(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("accessed"), text.month(F.concat(F.lit(" issue "), F.col("o_orderkey").cast("string"), F.lit(" "))).alias("other"))


# Sources.


@query("""
SELECT count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes, sha256(string_agg(p || chr(0) || t || chr(0) || h || chr(0), '' ORDER BY lower(p), p)) AS fingerprint
FROM (SELECT 'docs/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS p, source AS t, sha256(text) AS h, text FROM documents)""")
def inventory_fingerprint(spark, sf_dir):
    """Documents as files of a folder."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), F.col("source").alias("source_type"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    return inventory.fingerprint(files)


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 7) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h <> b.h""")
def snapshot_diff(spark, sf_dir):
    """Two states of the documents: the first lacks those ending in 3, the second those ending in 7, and every seventh has changed."""
    docs = table(spark, sf_dir, "documents")
    before = docs.filter("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("h"))
    after = docs.filter("doc_id % 10 <> 7").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return inventory.changes(before, after, key="doc_id", compared=("h",))


@query("""
SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY turn)) AS text_md5, count(*) AS n_lines FROM (
  SELECT conv_id, turn, string_agg(w, ' ' ORDER BY pos) AS line FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations) WHERE trim(w, ' ' || chr(10)) <> '' GROUP BY conv_id, turn)
GROUP BY conv_id""")
def ocr_lines(spark, sf_dir):
    """Words of the turns of a conversation as recognised words: words to lines, lines to text."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("ord", "text"))
    got = pages.lines(words, keys=["conv_id"], line=["turn"])
    n = words.filter(F.trim("text") != "").groupBy("conv_id").agg(F.count_distinct("turn").alias("n_lines"))
    return got.join(n, "conv_id").select("conv_id", F.md5("text").alias("text_md5"), "n_lines")


@query("""
SELECT conv_id, turn, CASE WHEN length(trim(text)) >= 80 THEN 'native' WHEN NOT (n <= 2 OR turn < 1 OR turn = n - 1) THEN 'skipped' WHEN turn % 2 = 0 THEN 'ocr' ELSE 'unavailable' END AS method
FROM (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def page_routing(spark, sf_dir):
    """Turns as pages: native text, the OCR budget of two pages, recognised text for even pages."""
    turns = table(spark, sf_dir, "conversations")
    native = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), F.col("text").alias("native_text"))
    ocr = turns.filter("turn % 2 = 0").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), "text", F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("diagnostic_code"))
    return pages.routed(native, ocr).select(F.col("doc_id").alias("conv_id"), (F.col("page_number") - 1).alias("turn"), "method")


# Names.


@query("""
SELECT c_custkey, 'Ana Maria ' || p || ' ' || s || n AS full_name, p2 || s || n AS family_name, g AS given_name FROM (
  SELECT c_custkey, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'de' WHEN 1 THEN 'van' ELSE 'Souza' END AS p, CASE CAST(c_custkey % 3 AS INT) WHEN 1 THEN 'van ' ELSE '' END AS p2,
    CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'Ana Maria de' WHEN 1 THEN 'Ana Maria' ELSE 'Ana Maria Souza' END AS g, lower(c_mktsegment) AS s, CASE WHEN c_nationkey % 2 = 0 THEN 'x' ELSE 'y' END AS n FROM customer)""")
def author_names(spark, sf_dir):
    """Author lines with marks and an affiliation, read as persons."""
    k = F.col("c_custkey")
    middle = F.element_at(F.array(F.lit("de"), F.lit("van"), F.lit("Souza")), (k % 3 + 1).cast("int"))
    last = F.concat(F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, "x").otherwise("y"))
    line = F.concat(F.lit("Ana Maria "), middle, F.lit(" "), last, F.lit("1,2* & Universidade Federal"))
    people = names.from_line(line)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(people).alias("p"))
    return rows.select("c_custkey", F.col("p.full").alias("full_name"), F.col("p.family").alias("family_name"), F.col("p.given").alias("given_name"))


# Extraction and classification.


@query("""
SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host,
  '10.' || CAST(1000 + page_id % 9000 AS VARCHAR) || '/x-' || CAST(page_id AS VARCHAR) AS doi, CAST(5 + page_id % 40 AS VARCHAR) AS volume, CAST(1 + page_id % 12 AS VARCHAR) AS issue, CAST(10 + page_id % 90 AS VARCHAR) || '-' || CAST(20 + page_id % 90 AS VARCHAR) AS pages, CAST(1990 + page_id % 30 AS VARCHAR) AS year
FROM pages""")
def page_extract(spark, sf_dir):
    """Fields of a page, and those of a citation line built from its number."""
    k = F.col("page_id")
    s = lambda c: c.cast("string")
    cite = F.concat(F.lit("Revista de Exemplos, v. "), s(5 + k % 40), F.lit(", n. "), s(1 + k % 12), F.lit(", p. "), s(10 + k % 90), F.lit("-"), s(20 + k % 90), F.lit(", "), s(1990 + k % 30), F.lit("\nhttps://doi.org/10."), s(1000 + k % 9000), F.lit("/x-"), s(k), F.lit("."))
    rows = table(spark, sf_dir, "pages").withColumn("cite", cite).withColumn("doi", extract.page_doi(F.array("cite")))
    f = extract.periodical_fields(F.col("cite"), F.col("doi"))
    m = extract.first_match
    return rows.withColumn("f", f).select("page_id", m(F.col("html"), "<title>([^<]*)</title>", 1).alias("title"), m(F.col("html"), '<html lang="([a-z]+)"', 1).alias("lang"), m(F.col("url"), "^https?://([^/]+)", 1).alias("host"), "doi", "f.volume", "f.issue", "f.pages", "f.year")


_SIGNS_SQL = ", ".join(
    "regexp_matches({}, '{}') AS {}".format(("folded_" if n in extract.FOLDED else "") + ("whole" if n in extract.WHOLE else "front"), re.sub(r"^\(\?([ims]*)U?\)", r"(?\1)", p).replace("'", "''"), n) for n, p in extract.SIGNALS.items()
)


@query(f"""
WITH t AS (SELECT doc_id, 'Heading' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '10.1234/abc-5' || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'Resumo' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN 'Referências' || chr(10) ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN 'ISSN 1234-5678' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, substr(text, 1, 120000) AS front, substr(text, 1, 240000) AS whole, lower(text) AS low, {MATCH.format("text")} AS folded, {MATCH.format("substr(text, 1, 120000)")} AS folded_front, {MATCH.format("substr(text, 1, 240000)")} AS folded_whole FROM t),
s AS (SELECT doc_id, low, folded, {_SIGNS_SQL} FROM b),
c AS (SELECT *, regexp_matches(folded, 'apresentada|submetida|programa de pos graduacao') AS presented, regexp_matches(folded, 'catalogacao na fonte|ficha catalografica') AS card FROM s)
SELECT doc_id, {", ".join(extract.SIGNALS)},
  CASE WHEN regexp_matches(folded, '\\bdisserta(?:cao|gao|cdo)\\b') AND (folded LIKE '%mestrado%' OR presented) THEN 'dissertation'
    WHEN regexp_matches(folded, '\\btese\\b') AND (folded LIKE '%doutorado%' OR presented) THEN 'thesis'
    WHEN low LIKE '%digital object identifier 10.%' AND low LIKE '%date of publication%' THEN 'journal_article'
    WHEN regexp_matches(low, '\\bsensors\\s+20\\d{{2}},\\s*\\d+,\\s*\\d+') AND low LIKE '%mdpi.com/journal/sensors%' THEN 'journal_article'
    WHEN regexp_matches(low, '\\bdoi\\s*:\\s*10\\.') AND regexp_matches(low, '\\bv\\.?\\s*\\d+') THEN 'journal_article'
    WHEN regexp_matches(folded, '\\bisbn\\s+[0-9x-]+') AND regexp_matches(folded, '\\b(?:[1-9]|10)[ªa]?\\s+edicao\\b') THEN 'book_manual'
    WHEN card AND regexp_matches(folded, '\\b(?:ministerio|universidade|instituto|fundacao|organizacao)\\b') AND regexp_matches(folded, '\\b(?:19|20)\\d{{2}}\\b') THEN 'book_manual'
    WHEN low LIKE '%notícias agrícolas%' OR (low LIKE '%publicado em%' AND low LIKE '%gov.br%') THEN 'web_article'
    WHEN NOT has_event_marker AND NOT has_monograph_marker AND ((has_article_label AND (has_doi OR has_abstract OR has_periodical_marker)) OR (has_doi AND has_abstract AND (has_references OR has_periodical_marker OR has_publication_history))
      OR (has_abstract AND has_references AND has_periodical_marker) OR (has_periodical_marker AND has_publication_history AND (has_doi OR has_references OR has_keywords))) THEN 'journal_article'
    ELSE 'unknown' END AS document_type FROM c""")
def line_signals(spark, sf_dir):
    """Signals of an article in each document's whole text, with front matter put before it."""
    k = F.col("doc_id")
    add = lambda n, s: F.when(k % n == 0, F.lit(s)).otherwise(F.lit(""))
    front = F.concat(F.lit("Heading\n"), add(2, "10.1234/abc-5\n"), add(3, "Resumo\n"), add(5, "Referências\n"), add(7, "ISSN 1234-5678\n"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", front.alias("front")).withColumn("folded", match_text("front")).withColumn("s", extract.article_signals(F.col("front"), F.col("front"), folded=F.col("folded")))
    kind = extract.document_type(F.lower("front"), F.col("folded"), F.col("s"), [])
    return rows.select("doc_id", *[f"s.{name}" for name in extract.SIGNALS], kind.alias("document_type"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR starts_with(lower(split_part(coalesce(text, ''), chr(10), 1)), 'brasil -') THEN 'browser_print' WHEN doc_id % 3 = 0 THEN 'scanned'
  WHEN doc_id % 4 = 0 THEN 'institutional_repository' ELSE 'publisher_original' END AS variant FROM documents""")
def variant_kinds(spark, sf_dir):
    """Kinds of variant from properties by number, and from each document's own text: its first line the title, the whole the front."""
    k, whole = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents")
    v = extract.variant(F.when(k % 5 == 0, "Microsoft: Print To PDF").otherwise("tex"), F.lit("x"), F.substring_index(whole, "\n", 1), F.when(k % 3 == 0, 0).otherwise(1), F.lit(2), F.when(k % 4 == 0, "thesis").otherwise("unknown"), F.concat(F.lit("Universidade Exemplo\n"), whole), repository="universidade exemplo")
    return docs.select("doc_id", v.alias("variant"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'Growth of trees in ' || CAST(doc_id AS VARCHAR) || ' and other plants near water' END AS title, CASE WHEN doc_id % 4 < 3 THEN 'Ana Lima and Bruno de Souza' END AS authors FROM documents""")
def front_matter(spark, sf_dir):
    """Title and authors of the lines put before each document's whole text; every fourth has no line of authors."""
    k = F.col("doc_id")
    head = F.concat(F.lit("Vol. 3, n. 2, 2019\nGrowth of  trees in "), _s(k), F.lit("\nand other plants near water\n"), F.when(k % 4 < 3, "Ana Lima and Bruno de Souza\n").otherwise("Received 5 May 2019\n"), F.lit("Abstract\n"))
    found = front.title_and_authors(front.lines_of(F.concat(head, F.coalesce("text", F.lit("")))), (extract.LINE_A, extract.LINE_B))
    return table(spark, sf_dir, "documents").withColumn("f", found).select("doc_id", "f.title", "f.authors")


_BOOK_CARD = "Front\nCatalogação na Fonte\nBiblioteca X.\nBrasil. Ministério Y.\nA123b Manual n{} de\nplantas / Ministério. – Brasília - DF : Editora n{}, 2001.\n120 p. : il.\n"
_THESIS_CARD = (
    "ANA LIMA\nEstudo n{} sobre o crescimento\nTese apresentada ao Departamento de Botânica.\nPrograma de Pós-Graduação em Botânica.\n|Ficha catalográfica elaborada pela Biblioteca Central\nLima, Ana, 1980-\n"
    "L732e 2010 Estudo n{} sobre o crescimento de plantas\ntropicais / Ana Lima. – Cidade, MG, 2010.\n88 f. : il. ; 29 cm.\n"
)


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Manual n' || CAST(doc_id AS VARCHAR) || ' de plantas' ELSE 'Estudo n' || CAST(doc_id AS VARCHAR) || ' sobre o crescimento de plantas tropicais' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'BRASIL. Ministério Y' ELSE 'Ana Lima' END AS responsible,
  CASE WHEN doc_id % 2 = 0 THEN 'Brasília, DF' ELSE 'Cidade das Flores, MG' END AS place, CASE WHEN doc_id % 2 = 0 THEN 'Editora n' || CAST(doc_id AS VARCHAR) END AS publisher, CASE WHEN doc_id % 2 = 0 THEN '2001' ELSE '2010' END AS year, CASE WHEN doc_id % 2 = 0 THEN '120' ELSE '88' END AS total_pages,
  CASE WHEN doc_id % 2 = 1 THEN 'Departamento de Botânica' END AS department, CASE WHEN doc_id % 2 = 1 THEN 'botanica' END AS program, CASE WHEN doc_id % 2 = 1 THEN 'Estudo n' || CAST(doc_id AS VARCHAR) || ' sobre o crescimento' END AS cover_title, CASE WHEN doc_id % 2 = 1 THEN 'ANA LIMA' END AS cover_author FROM documents""")
def catalog_cards(spark, sf_dir):
    """Catalogue cards and covers of books and theses, put before each document's whole text."""
    k, whole = F.col("doc_id"), F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))
    filled = lambda t: F.replace(F.lit(t), F.lit("{}"), _s(k))
    cover, card = (filled(t) for t in _THESIS_CARD.split("|"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(filled(_BOOK_CARD), whole).alias("book"), F.concat(card, whole).alias("card"), cover.alias("cover"))
    book, thesis = cards.book_card(F.col("book")), cards.thesis_card(F.col("card"), places={"cidade, mg": "Cidade das Flores, MG"})
    rows = rows.select("doc_id", "cover", F.when(k % 2 == 0, book).alias("b"), F.when(k % 2 == 1, thesis).alias("t"), F.when(k % 2 == 1, cards.academic_fields(F.col("cover"), F.lit("thesis"), F.lit(99))).alias("a"))
    odd = lambda c: F.when(k % 2 == 1, c)
    return rows.select("doc_id", *[F.coalesce(f"b.{n}", f"t.{n}").alias(n) for n in ("title", "place", "year", "total_pages")], F.coalesce("b.corporate_author", "t.author").alias("responsible"), "b.publisher", "a.department", "a.program", odd(cards.cover_title(F.col("cover"))).alias("cover_title"), odd(cards.cover_author(F.col("cover"))).alias("cover_author"))


_PRINTS = (
    "example.org\nSPRINGER NATURE Link\nA long title of study {}\nthat goes on\nPublished: 5 March 2021\nVolume 12, pages 10–20 (2021)\nCite this article\nPlant Letters\nAna Lima, Bruno Souza & Carlos Melo1\nAbstract\n",
    "ScienceDirect\nJournal of Things F\nVolume 7, May 2019, Pages 3-9\nTitle of work {}:\nA Review\nAna Lima, Bruno Souza*\nShow more\nhttps://doi.org/10.1016/x.{}.\n",
    "Locus\nCitação\nLIMA, Ana. Work number {}. 2015. 88 f. Tese (Doutorado em X) - Universidade Y,\nViçosa. 2015.\nURI\nhttp://repo.example.org//12/{}\nColeções\n",
    "Scientia Exempli B\nSci. Ex. 12 (3) • May-June 2018\nhttps://doi.org/10.1590/{}\nGrowth of plants {}\nAuthorship\nAna Lima, Bruno Souza\nScimago Institutions Rankings\nAbstract\n",
)


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'springer_nature_web_print' WHEN 1 THEN 'sciencedirect_web_print' WHEN 2 THEN 'locus_repository_web_print' ELSE 'scielo_web_print' END AS profile,
  CASE page_id % 4 WHEN 0 THEN 'A long title of study ' || CAST(page_id AS VARCHAR) || ' that goes on' WHEN 1 THEN 'Title of work ' || CAST(page_id AS VARCHAR) || ': a review' WHEN 2 THEN 'Work number ' || CAST(page_id AS VARCHAR) ELSE 'Growth of plants ' || CAST(page_id AS VARCHAR) END AS title,
  CASE page_id % 4 WHEN 0 THEN 'Ana Lima; Bruno Souza; Carlos Melo' WHEN 2 THEN 'Ana Lima' ELSE 'Ana Lima; Bruno Souza' END AS authors, CASE page_id % 4 WHEN 0 THEN 'Plant Letters' WHEN 1 THEN 'Journal of Things' WHEN 3 THEN 'Scientia Exempli' END AS journal,
  CASE WHEN page_id % 4 = 2 THEN 'Viçosa, MG' END AS place, CASE page_id % 4 WHEN 0 THEN '2021' WHEN 1 THEN '2019' WHEN 2 THEN '2015' ELSE '2018' END AS year, CASE page_id % 4 WHEN 1 THEN 'May' WHEN 3 THEN 'May-June' END AS month,
  CASE page_id % 4 WHEN 0 THEN '12' WHEN 1 THEN '7' WHEN 3 THEN '12' END AS volume, CASE WHEN page_id % 4 = 3 THEN '3' END AS issue, CASE page_id % 4 WHEN 0 THEN '10-20' WHEN 1 THEN '3-9' END AS pages,
  CASE page_id % 4 WHEN 1 THEN 'https://doi.org/10.1016/x.' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'http://repo.example.org/12/' || CAST(page_id AS VARCHAR) WHEN 3 THEN 'https://doi.org/10.1590/' || CAST(page_id AS VARCHAR) END AS source_url,
  CASE WHEN page_id % 4 = 2 THEN 'Universidade Y' END AS institution, CASE WHEN page_id % 4 = 2 THEN 'Tese (Doutorado em X)' END AS degree, CASE WHEN page_id % 4 = 2 THEN '88' END AS total_pages FROM pages""")
def web_prints(spark, sf_dir):
    """Fields of pages printed in four layouts, each above the page's whole text."""
    k = F.col("page_id")
    head = F.element_at(F.array(*map(F.lit, _PRINTS)), (k % 4 + 1).cast("int"))
    text = F.concat(F.replace(head, F.lit("{}"), _s(k)), F.coalesce("html", F.lit("")))
    found = front.web_print(text, journals=("scientia exempli",), place_names={"vicosa": "Viçosa, MG"})
    rows = table(spark, sf_dir, "pages").withColumn("p", found)
    return rows.select("page_id", *[f"p.{c}" for c in ("profile", "title", "authors", "journal", "place", "year", "month", "volume", "issue", "pages", "source_url", "institution", "degree", "total_pages")])


# Ledger and resolution.


@query(f"""
WITH wide AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS record_id, c_name AS name, c_mktsegment AS kind, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_name, NULL, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
long AS (SELECT record_id, 0 AS ord, 'title' AS field_id, name AS value FROM wide UNION ALL SELECT record_id, 1, 'work_type', kind FROM wide UNION ALL SELECT record_id, 2, 'place', place FROM wide UNION ALL SELECT record_id, 3, 'place', place FROM wide),
keyed AS (SELECT *, {FOLD.format('value')} AS norm FROM long WHERE value IS NOT NULL)
SELECT record_id, field_id, value, norm AS normalized_value FROM (SELECT *, row_number() OVER (PARTITION BY record_id, field_id, norm ORDER BY ord) AS nth FROM keyed) WHERE nth = 1""")
def ledger_unpivot(spark, sf_dir):
    """Customers and suppliers as wide records of two sources: unpivot, union, keep the first of equal candidates."""
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows at every scale
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("n_name").alias("place"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("record_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("kind"), F.col("n_name").alias("place"))
    wide = c.unionByName(s).withColumn("where", F.col("place"))
    long = ledger.unpivot(wide, {"name": "title", "kind": "work_type", "place": "place", "where": "place"}, keys=["record_id"], method=F.lit("table"), confidence=F.lit(0.9))
    long = long.withColumns({"source_format": F.lit("pdf"), "source_file": F.lit("f"), "source_record_id": F.lit(None).cast("string"), "sequence": F.lit(None).cast("int")})
    return ledger.deduplicated(ledger.normalized(long)).select("record_id", "field_id", "value", "normalized_value")


# Records of parsed entries: files are written from a table, read by the format's parser, and become the ledger.

_KINDS = ("article", "book", "phdthesis", "inproceedings", "misc")


def _bibtex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of some fifty entries each, an entry for each part."""
    k = F.col("p_partkey")
    field = lambda name, value: F.concat(F.lit(f",\n  {name} = "), value)
    braced = lambda value: F.concat(F.lit("{"), value, F.lit("}"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % len(_KINDS) + 1).cast("int"))
    entry = F.concat(
        F.lit("@"), kind, F.lit("{p"), k.cast("string"), field("title", braced(F.concat(F.lit("{"), "p_name", F.lit("} \\& more "), k.cast("string")))), field("author", braced(F.concat(F.lit("Lima, Ana and Souza, "), "p_brand"))), field("publisher", F.concat(F.lit('"House '), "p_brand", F.lit('"'))),
        field("year", (1990 + k % 30).cast("string")), field("pagetotal", braced(F.col("p_size").cast("string"))), field("note", F.concat(F.lit("{A } # {"), "p_type", F.lit("}"))), F.when(k % 3 == 0, field("url", braced(F.concat(F.lit("https://example.org/p/"), k.cast("string"))))).otherwise(""),
        F.when(k % 4 == 0, field("doi", braced(F.concat(F.lit("https://doi.org/10.9/P."), k.cast("string"))))).otherwise(""), F.lit("\n}"),
    )
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("d/parts"), F.floor(k / 50).cast("string"), F.lit(".bib")).alias("path"), F.struct(k, entry.alias("entry")).alias("e"))
    return rows.groupBy("path").agg(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "\n"), "UTF-8").alias("content"))


_PARTS_SQL = """
WITH p AS (SELECT *, p_partkey AS k, 'p' || CAST(p_partkey AS VARCHAR) AS source_record_id, CASE p_partkey % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'book' WHEN 2 THEN 'phdthesis' WHEN 3 THEN 'inproceedings' ELSE 'misc' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN 'https://example.org/p/' || CAST(p_partkey AS VARCHAR) END AS url, CASE WHEN p_partkey % 4 = 0 THEN '10.9/P.' || CAST(p_partkey AS VARCHAR) END AS doi FROM part)
"""


@query(_PARTS_SQL + """, m(field_id, value, sequence, method, confidence, k, source_record_id) AS (
  SELECT 'authors', 'Ana Lima', 1, 'm', 0.99, k, source_record_id FROM p UNION ALL SELECT 'authors', p_brand || ' Souza', 2, 'm', 0.99, k, source_record_id FROM p
  UNION ALL SELECT 'title', p_name || ' & more ' || CAST(k AS VARCHAR), NULL, 'm', 0.99, k, source_record_id FROM p UNION ALL SELECT 'publication_year', CAST(1990 + k % 30 AS VARCHAR), NULL, 'm', 0.99, k, source_record_id FROM p
  UNION ALL SELECT 'publisher', 'House ' || p_brand, NULL, 'm', 0.99, k, source_record_id FROM p UNION ALL SELECT 'doi', doi, NULL, 'm', 0.99, k, source_record_id FROM p
  UNION ALL SELECT 'doi', 'https://doi.org/' || doi, NULL, 'r', 0.99, k, source_record_id FROM p UNION ALL SELECT 'url', coalesce(url, 'https://doi.org/' || doi), NULL, 'm', 0.99, k, source_record_id FROM p
  UNION ALL SELECT 'work_type', 'Tese', NULL, 'm', 0.99, k, source_record_id FROM p WHERE kind = 'phdthesis' UNION ALL SELECT 'pagination', CAST(p_size AS VARCHAR), NULL, CASE kind WHEN 'phdthesis' THEN 'm' ELSE 'r' END, 0.99, k, source_record_id FROM p
  UNION ALL SELECT 'physical_description', CAST(p_size AS VARCHAR) || ' p.', NULL, 'm', 0.99, k, source_record_id FROM p WHERE kind = 'book' UNION ALL SELECT 'notes', 'A ' || p_type, 1, 'r', 0.99, k, source_record_id FROM p)
SELECT source_record_id, field_id, value, sequence, CASE method WHEN 'm' THEN 'bibtex_structured_metadata' ELSE 'bibtex_raw_field' END AS method, CAST(confidence AS DOUBLE) AS confidence FROM m WHERE value IS NOT NULL""")
def bibtex_records(spark, sf_dir):
    """Parts as BibTeX files, parsed, made into records of the ledger."""
    metadata = records.from_bibtex(bibtex.parse(_bibtex_files(spark, sf_dir)))
    return records.records(metadata, "bibtex").select("source_record_id", "field_id", "value", "sequence", "method", "confidence")


def _ris_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    line = lambda tag, value: F.concat(F.lit(f"{tag}  - "), value, F.lit("\n"))
    number = lambda n: n.cast("string")
    record = F.concat(
        line("TY", F.element_at(F.array(*map(F.lit, ("JOUR", "THES", "NEWS", "GEN"))), (k % 4 + 1).cast("int"))), line("ID", F.concat(F.lit("s"), number(k))), line("AU", F.concat(F.lit("Lima, "), "n_name")), line("TI", F.concat("s_name", F.lit("\n  and more"))), line("JO", F.col("n_name")),
        line("PY", F.concat(number(1990 + k % 30), F.lit("/05/01"))), line("SP", number(10 + k % 7)), line("EP", number(12 + k % 5)), line("N1", F.lit("first")), line("N1", F.lit("second")), F.when(k % 3 == 0, line("DO", F.concat(F.lit("10.9/s"), number(k)))).otherwise(""), F.lit("ER  - \n"),
    )
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows at every scale
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("d/s"), F.floor(k / 20).cast("string"), F.lit(".ris")).alias("path"), F.struct(k, record.alias("record")).alias("r"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["record"]), "\n").alias("text"))


@query("""
WITH s AS (SELECT *, s_suppkey AS k, 's' || CAST(s_suppkey AS VARCHAR) AS id, 10 + s_suppkey % 7 AS a, 12 + s_suppkey % 5 AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m(source_record_id, field_id, value, sequence, method) AS (
  SELECT id, 'authors', n_name || ' Lima', 1, 'm' FROM s UNION ALL SELECT id, 'title', s_name || ' and more', NULL, 'm' FROM s UNION ALL SELECT id, 'periodical_title', n_name, NULL, 'm' FROM s
  UNION ALL SELECT id, 'publication_year', CAST(1990 + k % 30 AS VARCHAR), NULL, 'm' FROM s UNION ALL SELECT id, 'publication_year', CAST(1990 + k % 30 AS VARCHAR) || '/05/01', NULL, 'r' FROM s UNION ALL SELECT id, 'publication_month', '05', NULL, 'm' FROM s
  UNION ALL SELECT id, 'article_pages', CASE WHEN a <> b THEN CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) ELSE CAST(a AS VARCHAR) END, NULL, 'm' FROM s UNION ALL SELECT id, 'doi', '10.9/s' || CAST(k AS VARCHAR), NULL, 'm' FROM s WHERE k % 3 = 0
  UNION ALL SELECT id, 'url', 'https://doi.org/10.9/s' || CAST(k AS VARCHAR), NULL, 'm' FROM s WHERE k % 3 = 0 UNION ALL SELECT id, 'work_type', 'first', NULL, 'm' FROM s
  UNION ALL SELECT id, 'notes', 'first', 1, 'r' FROM s UNION ALL SELECT id, 'notes', 'second', 2, 'r' FROM s)
SELECT source_record_id, field_id, value, sequence, CASE method WHEN 'm' THEN 'ris_structured_metadata' ELSE 'ris_raw_field' END AS method FROM m""")
def ris_records(spark, sf_dir):
    """Suppliers as RIS files, parsed, made into records of the ledger."""
    metadata = records.from_ris(ris.parse(_ris_files(spark, sf_dir)))
    return records.records(metadata, "ris").select("source_record_id", "field_id", "value", "sequence", "method")


@query(_PARTS_SQL + """, t AS (
  SELECT source_record_id, CASE kind WHEN 'article' THEN 'periodical_article' WHEN 'book' THEN 'monograph' WHEN 'phdthesis' THEN 'academic_work' END AS family, CASE kind WHEN 'article' THEN 'journal_article' WHEN 'book' THEN 'book_manual' WHEN 'phdthesis' THEN 'thesis' END AS document,
    CASE kind WHEN 'article' THEN 'periodical_article' WHEN 'book' THEN 'monograph' WHEN 'phdthesis' THEN 'academic_work' WHEN 'inproceedings' THEN 'event_part' END AS entry_family, kind, CASE WHEN url IS NOT NULL OR doi IS NOT NULL THEN 'electronic' ELSE 'print' END AS medium FROM p)
SELECT source_record_id, family, medium, CAST(0.92 AS DOUBLE) AS confidence, 'type of document ' || document AS reason FROM t WHERE family IS NOT NULL
UNION ALL SELECT source_record_id, entry_family, medium, CAST(0.99 AS DOUBLE), 'entry type ' || kind FROM t WHERE entry_family IS NOT NULL""")
def record_types(spark, sf_dir):
    """Candidates of the type of each part's record."""
    metadata = records.from_bibtex(bibtex.parse(_bibtex_files(spark, sf_dir)))
    return records.type_candidates(metadata, "bibtex").select("source_record_id", "family", "medium", "confidence", "reason")


@query(_PARTS_SQL + f""", b AS (SELECT *, p_name || ' & more ' || CAST(k AS VARCHAR) AS title, CAST(1990 + k % 30 AS VARCHAR) AS year, coalesce(url, 'https://doi.org/' || doi) AS address FROM p WHERE kind = 'book'),
n AS (SELECT *, count(*) OVER (PARTITION BY year) AS same, row_number() OVER (PARTITION BY year ORDER BY {MATCH.format("title")}) - 1 AS i FROM b)
SELECT source_record_id, CASE WHEN address IS NULL THEN 'print' ELSE 'electronic' END AS medium, 'LIMA, Ana; SOUZA, Brand. ' || title || '. [S. l.]: House ' || p_brand || ', ' || year || CASE WHEN same > 1 THEN {_SUFFIX_SQL} ELSE '' END || '. ' || CAST(p_size AS VARCHAR) || ' p.'
  || CASE WHEN address IS NULL THEN ' A ' || p_type || '.' ELSE '' END || CASE WHEN doi IS NOT NULL THEN ' DOI: https://doi.org/' || doi || '.' ELSE '' END || CASE WHEN url IS NOT NULL THEN ' Disponível em: ' || url || '. Acesso em: 5 mar. 2024.' ELSE '' END AS reference FROM n""")
def compiled_books(spark, sf_dir):
    """Parts as BibTeX books, from the parsed file to the reference: records, types, schemas of the manual, resolution, year letters, layout."""
    catalog = schemas.catalog()
    metadata = records.from_bibtex(bibtex.parse(_bibtex_files(spark, sf_dir)).filter("entry_type = 'book'"))
    types = records.schema_candidates(records.type_candidates(metadata, "bibtex"), catalog)
    rows = compiled.compile_references(records.records(metadata, "bibtex"), types, catalog, access_date="2024-03-05", families=["monograph"])
    return rows.join(metadata.select("record_id", "source_record_id"), "record_id").select("source_record_id", "medium", "reference")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as candidates for the field of its flag: the supplier is the file, the part type the value."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_quantity", "l_partkey")
    kinds = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = lines.join(kinds, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("field_id"), F.lower("p_type").alias("value"), F.lower("p_type").alias("normalized_value"),
        F.when(F.col("l_suppkey") % 3 == 0, "bibtex").otherwise("pdf").alias("source_format"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("source_file"), F.lit(None).cast("string").alias("source_record_id"),
        F.when(F.col("l_suppkey") % 3 == 0, "bibtex_metadata").when(F.col("l_suppkey") % 3 == 1, "pdf_metadata_title").otherwise("doi_regex").alias("method"), (F.lit(0.5) + F.col("l_quantity") / 125.0).alias("confidence"),
        F.col("l_linenumber").alias("sequence"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("ord"),
    )


_CANDIDATE_SQL = """
WITH c AS (
  SELECT l_orderkey AS record_id, l_returnflag AS field_id, lower(p_type) AS value, l_suppkey % 3 AS m, l_suppkey, 0.5::DOUBLE + l_quantity / 125.0::DOUBLE AS conf FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE m WHEN 0 THEN conf + 0.06::DOUBLE + 0.08::DOUBLE WHEN 1 THEN conf - 0.08::DOUBLE ELSE conf + 0.08::DOUBLE END)) AS score FROM c),
g AS (SELECT record_id, field_id, value, least(1.0::DOUBLE, max(score) + least(0.10::DOUBLE, 0.03::DOUBLE * (count(DISTINCT l_suppkey) - 1))) AS score FROM s GROUP BY record_id, field_id, value),
r AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS second, lead(value) OVER w AS runner_up, count(*) OVER (PARTITION BY record_id, field_id) AS n FROM g WINDOW w AS (PARTITION BY record_id, field_id ORDER BY score DESC, value DESC))
"""


@query(_CANDIDATE_SQL + "SELECT record_id, field_id, value, round(score, 6) AS confidence, CASE WHEN score >= 0.84::DOUBLE AND second >= 0.84::DOUBLE AND score - second <= 0.12::DOUBLE THEN 'conflict' ELSE 'selected' END AS status, runner_up, n AS n_alternatives FROM r WHERE nth = 1")
def field_resolution(spark, sf_dir):
    """Score, group, rank and mark conflicts over the ledger of the order lines."""
    none = spark.createDataFrame([], "field_id string, repeatable boolean")
    got = resolve.resolve_fields(_candidates(spark, sf_dir), none)
    return got.select("record_id", "field_id", F.col("values")[0].alias("value"), F.round("confidence", 6).alias("confidence"), "status", F.col("runner_up")[0].alias("runner_up"), "n_alternatives")


@query("""
WITH c AS (SELECT l_orderkey AS record_id, l_suppkey % 2 AS f, l_linenumber AS q, lower(p_type) AS v, l_quantity / 100.0::DOUBLE AS conf, l_linenumber * 1000000 + l_partkey AS ord FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT record_id, f, list(v ORDER BY q, v) AS vs, max(conf) AS conf, min(ord) AS ord FROM c GROUP BY record_id, f),
g AS (SELECT record_id, vs, max(conf) AS top, count(*) AS n FROM p GROUP BY record_id, vs),
r AS (SELECT *, least(1.0::DOUBLE, top + least(0.10::DOUBLE, 0.03::DOUBLE * (n - 1))) AS score FROM g)
SELECT record_id, array_to_string(vs, '|') AS value_list, round(score, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, len(vs) DESC, vs DESC) AS nth FROM r) WHERE nth = 1""")
def repeatable_lists(spark, sf_dir):
    """The lines' part types as ordered lists by provenance; equal lists support each other."""
    rows = _candidates(spark, sf_dir).withColumn("field_id", F.lit("authors")).withColumn("source_format", F.lit("pdf")).withColumn("method", F.lit("m"))
    lines = rows.withColumn("source_file", (F.substring("source_file", 2, 20).cast("long") % 2).cast("string")).withColumn("confidence", (F.col("confidence") - 0.5) * 1.25)
    lines = lines.withColumn("confidence", F.round("confidence", 10))
    got = resolve.resolve_fields(lines, spark.createDataFrame([("authors", True)], "field_id string, repeatable boolean"))
    return got.select("record_id", F.array_join("values", "|").alias("value_list"), F.round("confidence", 6).alias("confidence"))


@query("""
WITH t AS (SELECT user_id AS record_id, event_type AS schema_id, event_id, least(1.0::DOUBLE, 0.7::DOUBLE + (event_id % 20) / 100.0::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM events),
g AS (SELECT record_id, schema_id, least(1.0::DOUBLE, max(score) + least(0.08::DOUBLE, 0.025::DOUBLE * (count(*) - 1))) AS score FROM t GROUP BY record_id, schema_id)
SELECT record_id, schema_id, round(score, 6) AS schema_confidence FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, schema_id DESC) AS nth FROM g) WHERE nth = 1""")
def schema_resolution(spark, sf_dir):
    """Event types as candidates for a user's schema."""
    k = F.col("event_id")
    types = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("schema_id"), F.when(k % 2 == 0, "ris").otherwise("pdf").alias("source_format"), (F.lit(0.7) + (k % 20) / 100.0).alias("confidence"), F.lit("seen").alias("reason"), k.alias("ord"))
    return resolve.resolve_schema(types).select("record_id", "schema_id", F.round("schema_confidence", 6).alias("schema_confidence"))


_MISSING_CATALOG = {"fields": [{"id": f} for f in ("p_name", "p_brand", "url", "access_date", "authors", "corporate_author")], "schemas": [{"id": "part.1", "section": "1", "family": "part", "medium": "print", "required_fields": ["p_name", "p_brand"], "conditional_fields": ["url", "access_date", "authors", "corporate_author"], "ordered_fields": ["p_name", "p_brand", "url", "access_date", "authors", "corporate_author"], "conditions": [{"any_of": ["authors", "corporate_author"]}, {"when_field_present": "url", "then_required": ["access_date"]}]}]}


@query("""
SELECT p_partkey AS record_id, concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'p_name' END, CASE WHEN p_size < 10 THEN 'p_brand' END, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 THEN 'any_of:authors|corporate_author' END, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 6 <> 0 THEN 'access_date' END) AS missing FROM part""")
def missing_required(spark, sf_dir):
    """Which required, alternative and dependent fields a part's record lacks."""
    from bibspark.plans.catalog import Catalog

    catalog = Catalog.load(_MISSING_CATALOG)
    k = F.col("p_partkey")
    have = F.array_compact(F.array(F.when(k % 11 != 0, "p_name"), F.when(F.col("p_size") >= 10, "p_brand"), F.when(k % 2 == 0, "url"), F.when(k % 6 == 0, "access_date"), F.when(k % 3 == 0, "authors"), F.when(k % 4 == 0, "corporate_author")))
    parts = table(spark, sf_dir, "part").select(k.alias("record_id"), have.alias("have"))
    got = resolve.missing_required(parts.select("record_id", F.explode("have").alias("field_id")), parts.select("record_id", F.lit("part.1").alias("schema_id")), catalog.dim_schema_field(spark), catalog.dim_condition(spark))
    return got.select("record_id", F.array_join("missing", ",").alias("missing"))


# Linkage and clusters.


@query("""
SELECT doc_id, cluster, winner_id, doc_id = winner_id OR h = wh AS include FROM (
  SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY text) AS cluster, first_value(doc_id) OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS winner_id, sha256(text) AS wh FROM documents)""")
def exact_dups(spark, sf_dir):
    """Documents with one hash: clusters, and the winner of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit("processed").alias("status"), F.lit("unknown").alias("variant_type"), F.col("n_chars").alias("n_filled"), F.lit(0).alias("native_pages"), F.col("doc_id").alias("ord"), F.lit("").alias("canonical_key"))
    low = docs.groupBy("sha256").agg(F.min("doc_id").alias("component"))
    labels = docs.join(low, "sha256").select(F.col("doc_id").alias("vertex"), "component")
    return link.winners(docs, labels).select("doc_id", "cluster", "winner_id", "include")


@query("""
WITH RECURSIVE e AS (
  SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY text) AS b FROM documents
  UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY source, n_chars) FROM documents),
b AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.a, r.c FROM r JOIN b ON b.b = r.v)
SELECT v AS doc_id, min(c) AS component FROM r GROUP BY v""")
def variant_components(spark, sf_dir):
    """Documents that share a text, or a source and a size, and all that these connect."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.concat_ws("|", "source", F.col("n_chars").cast("string")).alias("canonical_key"), F.lit("").alias("doi_key"), F.lit("").alias("title_key"), F.lit("").alias("year_key"), F.lit("").alias("family_key"), F.lit("").alias("stem_key"), F.lit("unknown").alias("variant_type"))
    labels = components(link.variant_pairs(docs))
    return docs.join(labels, F.col("doc_id") == F.col("vertex"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


@query("""
WITH d AS (SELECT doc_id, '10.1/' || CAST(doc_id % 70 AS VARCHAR) AS doi FROM documents), e AS (SELECT item_id, '10.1/' || CAST(item_id AS VARCHAR) AS doi FROM benchmark)
SELECT d.doc_id, e.item_id, CASE WHEN e.item_id IS NULL THEN 'none' ELSE 'doi' END AS method FROM d LEFT JOIN e ON d.doi = e.doi""")
def doi_link(spark, sf_dir):
    """Documents linked with benchmark items by DOI, and those left over."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("10.1/"), (F.col("doc_id") % 70).cast("string")).alias("doi_key"), F.lit("").alias("title_key"), F.lit(None).cast("string").alias("year"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), F.col("item_id").alias("ord"), F.concat(F.lit("10.1/"), F.col("item_id").cast("string")).alias("doi_key"), F.lit("").alias("title_key"), F.lit(None).cast("string").alias("year"))
    best = link.best_match(link.candidate_pairs(docs, items)).select("doc_id", F.col("entry_id").alias("item_id"), "method")
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", "item_id", F.coalesce("method", F.lit("none")).alias("method"))


@query()
def fuzzy_link(spark, sf_dir):
    """Documents, and edited forms of the benchmark items, against the items by their whole texts; each item finds its own."""
    items = table(spark, sf_dir, "benchmark").select("item_id", title_key("text").alias("t"))
    side = lambda rows, source, key, title: rows.select(F.struct(F.lit(source).alias("source"), F.col(key).alias("id")).alias("doc_id"), F.lit("").alias("doi_key"), title.alias("title_key"), F.lit(None).cast("string").alias("year"))
    docs = side(table(spark, sf_dir, "documents"), "documents", "doc_id", title_key("text")).unionByName(side(items, "benchmark", "item_id", F.regexp_replace("t", "e([a-z]) ", "$1 ")))
    entries = items.select(F.col("item_id").alias("entry_id"), F.col("item_id").alias("ord"), F.lit("").alias("doi_key"), F.col("t").alias("title_key"), F.lit("2020").alias("year"))
    best = link.best_match(link.candidate_pairs(docs, entries, ratio=link.text_ratio))
    return best.select("doc_id.source", F.col("doc_id.id").alias("doc_id"), "entry_id", "method", F.round("score", 6).alias("score"))


# Review.


@query("""
SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN d.lang WHEN l.quality = 0 THEN NULL ELSE 'reviewed' END AS lang, coalesce(l.quality = 1, FALSE) AS corrected FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def review_overlay(spark, sf_dir):
    """Labels as stored corrections of a document's language: a value, or null that clears it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    stored = table(spark, sf_dir, "labels").select("doc_id", F.lit("lang").alias("field_name"), F.when(F.col("quality") == 1, "reviewed").alias("replacement_value"))
    over = review.overlay(docs, stored, key="doc_id").select(F.col("doc_id").alias("k"), "value", "corrected")
    return docs.join(over, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.when(F.col("corrected"), F.col("value")).otherwise(F.col("lang")).alias("lang"), F.coalesce(F.col("corrected") & F.col("value").isNotNull(), F.lit(False)).alias("corrected"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Title ' || CAST(turn AS VARCHAR) ELSE role END AS title, turn % 2 = 0 AND conv_id % 3 = 0 AS conflict, turn % 2 = 0 AS applied FROM conversations""")
def merge_conflicts(spark, sf_dir):
    """Structured values over extracted ones, with the conflict flag."""
    k = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    base = table(spark, sf_dir, "conversations").select(k.alias("k"), "conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.col("role")).when(F.col("conv_id") % 3 == 0, "other").otherwise(F.concat(F.lit("TITLE  "), F.col("turn").cast("string"))).alias("title"))
    entries = base.filter("turn % 2 = 0").select("k", F.concat(F.lit("Title "), F.col("turn").cast("string")).alias("title"))
    return review.merge_structured(base, entries, "k").select("conv_id", "turn", "title", "conflict", "applied")


@query("""
WITH c AS (SELECT lang AS document_type, source, lower(source) AS source_key, CASE WHEN doc_id % 3 = 0 THEN 'Place A' ELSE 'place b' END AS v, doc_id AS ts FROM documents)
SELECT 'place' AS field_name, source_key, lower(v) AS replacement_key, document_type, count(*) AS confirmation_count, max(ts) AS updated FROM c GROUP BY source_key, lower(v), document_type""")
def suggestions(spark, sf_dir):
    """Corrections of a place by source and language, counted."""
    changes = table(spark, sf_dir, "documents").select(F.lit("place").alias("field_name"), F.col("source").alias("source_value"), F.when(F.col("doc_id") % 3 == 0, "Place A").otherwise("place b").alias("replacement_value"), F.col("lang").alias("document_type"), F.col("doc_id").alias("ts"))
    return review.confirmed(review.correction_candidates(changes)).drop("replacement_value")


# Order and rendering.

@query(f"""
SELECT o_orderkey, CASE WHEN n > 1 THEN {_SUFFIX_SQL} ELSE '' END AS year_suffix FROM (
  SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey % 50, year(o_orderdate)) AS n, row_number() OVER (PARTITION BY o_custkey % 50, year(o_orderdate) ORDER BY o_orderkey) - 1 AS i FROM orders)""")
def year_suffix(spark, sf_dir):
    """Letters for the orders of one name and year."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("who"), F.year("o_orderdate").alias("year"), F.lit(True).alias("ready"))
    return compiled.year_letters(rows, group=["who", "year"], order=["o_orderkey"]).select("o_orderkey", "year_suffix")


@query(f"""
SELECT kind, k, row_number() OVER (PARTITION BY kind ORDER BY {MATCH.format('name')}, k) AS position FROM (
  SELECT 'customer' AS kind, c_custkey AS k, c_mktsegment || ' ' || c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part)""")
def alpha_order(spark, sf_dir):
    """Place of each name in the alphabetical list of its kind."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    rows = c.unionByName(s).unionByName(p).withColumn("sort_name", match_text("name"))
    return compiled.numbered(rows, group=["kind"], order=["sort_name", "k"]).select("kind", "k", "position")


def _order_records(spark: SparkSession, sf_dir: str, fields: dict[str, Column], family: str, medium: str) -> DataFrame:
    nation, region = F.broadcast(table(spark, sf_dir, "nation")), F.broadcast(table(spark, sf_dir, "region"))  # 25 and 5 rows at every scale
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    entries = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items()]), lambda e: e["v"].isNotNull()))
    return rows.select("o_orderkey", entries.alias("fields"), F.lit(family).alias("family"), F.lit(medium).alias("medium"), F.lit(True).alias("ready"))


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("""
SELECT o_orderkey, upper(c_mktsegment) || ', Ana; SILVA, Bruno. Order ' || CAST(o_orderkey AS VARCHAR) || ': a study. Journal of ' || n_name || ', ' || CASE WHEN o_orderkey % 2 = 0 THEN r_name ELSE '[s. l.]' END || ', v. ' || CAST(o_orderkey % 40 + 1 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ', n. ' || CAST(o_orderkey % 12 + 1 AS VARCHAR) ELSE '' END
  || CASE WHEN o_orderkey % 5 = 0 THEN ', art. ' || CAST(10000 + o_orderkey AS VARCHAR) ELSE ', p. ' || CAST(o_orderkey % 90 + 1 AS VARCHAR) || '-' || CAST(o_orderkey % 90 + 9 AS VARCHAR) END || ', ' || """ + _MONTH_SQL.format("month(o_orderdate)") + """ || ' ' || CAST(year(o_orderdate) AS VARCHAR) || '. DOI: https://doi.org/10.1/' || CAST(o_orderkey AS VARCHAR) || '.'
  || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' Disponível em: https://example.org/' || CAST(o_orderkey AS VARCHAR) || '. Acesso em: 5 mar. 2025.' END AS reference
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def render_article(spark, sf_dir):
    """Orders as electronic journal articles."""
    k = F.col("o_orderkey")
    one = lambda c: F.array(c)
    fields = {
        "authors": F.array(F.concat(F.initcap("c_mktsegment"), F.lit(", Ana")), F.lit("Bruno Silva")), "title": one(F.concat(F.lit("Order "), _s(k))), "subtitle": one(F.lit("a study")), "periodical_title": one(F.concat(F.lit("Journal of "), "n_name")), "place": F.when(k % 2 == 0, one(F.col("r_name"))), "volume": one(F.concat(_s(k % 40 + 1), F.lit("."))),
        "issue": F.when(k % 3 == 0, one(_s(k % 12 + 1))), "article_pages": F.when(k % 5 != 0, one(F.concat(_s(k % 90 + 1), F.lit("--"), _s(k % 90 + 9)))), "article_number": one(_s(k + 10000)), "publication_month": one(F.date_format("o_orderdate", "MMMM")), "publication_year": one(_s(F.year("o_orderdate"))), "doi": one(F.concat(F.lit("10.1/"), _s(k))),
        "url": one(F.when(k % 4 == 0, F.concat(F.lit("https://www.doi.org/10.1/"), _s(k))).otherwise(F.concat(F.lit("https://example.org/"), _s(k)))), "access_date": one(F.lit("2025-03-05")),
    }
    return layouts.render(_order_records(spark, sf_dir, fields, "periodical_article", "electronic"), families=["periodical_article"]).select("o_orderkey", "reference")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN upper(n_name) || '. Ministry' ELSE 'COSTA, Maria da' END || '. Order ' || CAST(o_orderkey AS VARCHAR) || '.' || CASE WHEN o_orderkey % 3 = 0 THEN ' 2. ed.' ELSE '' END || ' ' || CASE WHEN o_orderkey % 5 = 0 THEN '[S. l.]' ELSE r_name END || ': ' || CASE WHEN o_orderkey % 7 = 0 THEN '[s. n.]' ELSE c_name END || ', ' || CAST(year(o_orderdate) AS VARCHAR) || '. ' || CAST(o_orderkey % 300 + 1 AS VARCHAR) || ' p. Note one. Note two. ISBN 978-' || CAST(o_orderkey AS VARCHAR) || '.' AS reference
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def render_monograph(spark, sf_dir):
    """Orders as printed books."""
    k = F.col("o_orderkey")
    one = lambda c: F.array(c)
    fields = {
        "authors": F.when(k % 2 != 0, one(F.lit("Maria da Costa"))), "corporate_author": F.when(k % 2 == 0, one(F.concat(F.initcap("n_name"), F.lit(". Ministry.")))), "title": one(F.concat(F.lit("Order "), _s(k))), "edition": F.when(k % 3 == 0, one(F.lit("2. ed.,"))), "place": F.when(k % 5 != 0, one(F.col("r_name"))),
        "publisher": F.when(k % 7 != 0, one(F.col("c_name"))), "publication_year": one(_s(F.year("o_orderdate"))), "physical_description": one(F.concat(_s(k % 300 + 1), F.lit(" p"))), "notes": F.array(F.lit("Note one."), F.lit(" "), F.lit("Note two")), "isbn": one(F.concat(F.lit("978-"), _s(k))),
    }
    return layouts.render(_order_records(spark, sf_dir, fields, "monograph", "print"), families=["monograph"]).select("o_orderkey", "reference")


@query("""
SELECT page_id, concat_ws(' ', CASE WHEN page_id % 3 = 0 THEN 'DOI: https://doi.org/10.5/' || CAST(page_id AS VARCHAR) || '.' END, CASE WHEN page_id % 6 <> 0 THEN 'Disponível em: ' || rtrim(url, '.;, ') || '. Acesso em: 1 fev. 2024.' END) AS online FROM pages""")
def online_segment(spark, sf_dir):
    """DOI and address of a page; every sixth address only repeats its DOI."""
    k = F.col("page_id")
    doi = F.when(k % 3 == 0, F.array(F.concat(F.lit("10.5/"), _s(k))))
    url = F.array(F.when(k % 6 == 0, F.concat(F.lit("http://dx.doi.org/10.5%2F"), _s(k))).otherwise(F.col("url")))
    fields = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in (("doi", doi), ("url", url))]), lambda e: e["v"].isNotNull()))
    rows = table(spark, sf_dir, "pages").select("page_id", fields.alias("fields"))
    view = layouts.Fields(F.col("fields"), access_date=F.lit("2024-02-01"))
    return rows.select("page_id", layouts.joined(view.online()).alias("online"))


# Gate, reports, stores.


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    none = F.expr("cast(array() as array<string>)")
    return gate.assess(docs.select(
        "doc_id", "lang", "source", F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("include"), F.when(F.col("quality") == 0, "failed").otherwise("processed").alias("status"), F.lit(True).alias("resolved"), F.when(k % 13 != 0, "x.1").alias("schema_id"), F.when(k % 17 == 0, "unheard").otherwise("monograph").alias("family"),
        F.when(k % 11 == 0, F.array(F.lit("title"))).otherwise(none).alias("missing"), F.when(k % 5 == 0, F.array(F.lit("year"))).otherwise(none).alias("conflicting"), F.lit("a reference").alias("reference"), (k % 10 == 0).alias("approved"), (k % 2).alias("native_pages"), F.lit(1).alias("ocr_pages"), F.lit(1).alias("n_authors"),
        F.when(k % 3 == 0, "text_after_title").otherwise("cover").alias("authors_method"), F.lit(0.95).alias("authors_confidence"), F.lit("t").alias("title"), F.when(k % 7 == 0, 0.5).otherwise(0.95).alias("title_confidence"), F.lit(False).alias("weak_ocr"), F.lit(False).alias("metadata_conflict"), (k % 19 == 0).alias("has_suggestion"), F.lit("unknown").alias("document_type"),
    ), ["monograph"])


_GATE_SQL = """
WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT *, CASE WHEN toxic = 1 THEN 'secondary_variant' WHEN quality = 0 THEN 'extraction_blocked' WHEN doc_id % 13 = 0 THEN 'reference_schema_not_identified' WHEN doc_id % 17 = 0 THEN 'reference_schema_not_implemented' WHEN doc_id % 11 = 0 THEN 'required_reference_field_missing' END AS block,
  concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'reference_field_conflict' END, CASE WHEN doc_id % 2 = 0 THEN 'ocr_only_source' END, CASE WHEN doc_id % 3 = 0 THEN 'heuristic_author_extraction' END, CASE WHEN doc_id % 7 = 0 THEN 'low_title_confidence' END, CASE WHEN doc_id % 19 = 0 THEN 'correction_suggestion_available' END) AS soft FROM d),
a AS (SELECT doc_id, lang, toxic, CASE WHEN block IS NOT NULL THEN block WHEN doc_id % 10 = 0 THEN '' ELSE soft END AS issues, CASE WHEN block IS NOT NULL THEN 'blocked' WHEN doc_id % 10 = 0 OR soft = '' THEN 'ready' ELSE 'review_required' END AS readiness FROM b)
"""


@query(_GATE_SQL + "SELECT doc_id, readiness, issues FROM a")
def quality_gate(spark, sf_dir):
    return _assessed(spark, sf_dir).select("doc_id", "readiness", F.array_join("issues", ",").alias("issues"))


@query(_GATE_SQL + "SELECT count(*) AS physical, count(*) FILTER (WHERE coalesce(toxic, 0) = 0) AS selected, count(*) FILTER (WHERE coalesce(toxic, 0) = 0) AS generated, count(*) FILTER (WHERE coalesce(toxic, 0) = 0 AND readiness = 'ready') AS ready, count(*) FILTER (WHERE coalesce(toxic, 0) = 0 AND readiness = 'review_required') AS review, count(*) FILTER (WHERE coalesce(toxic, 0) = 0 AND readiness = 'blocked') AS blocked FROM a")
def readiness_counts(spark, sf_dir):
    return gate.readiness_counts(_assessed(spark, sf_dir))


@query(_GATE_SQL + "SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS label, CASE WHEN toxic = 1 THEN 'excluded' ELSE readiness END AS status, count(*) AS works FROM a GROUP BY ALL")
def issue_tabs(spark, sf_dir):
    """Counts by status and group of works."""
    works = _assessed(spark, sf_dir).select(store.work_status(F.col("include"), F.col("readiness")).alias("status"), F.col("lang").alias("family"))
    labels = F.broadcast(spark.createDataFrame([("en", "English"), ("de", "German")], "family string, label string"))
    return works.join(labels, "family", "left").groupBy(F.coalesce("label", F.lit(store.FAMILY_UNKNOWN)).alias("label"), "status").agg(F.count(F.lit(1)).alias("works"))


@query(_GATE_SQL + "SELECT lang AS run_id, count(*) AS total, count(*) FILTER (WHERE readiness = 'ready') AS ready, count(*) FILTER (WHERE readiness = 'review_required') AS review, count(*) FILTER (WHERE readiness = 'blocked') AS blocked FROM a WHERE coalesce(toxic, 0) = 0 GROUP BY lang")
def run_counts(spark, sf_dir):
    return store.run_counts(_assessed(spark, sf_dir).withColumnRenamed("lang", "run_id"))


@query("""
SELECT count(*) AS documents, count(DISTINCT text) AS works, count(*) FILTER (WHERE doc_id % 9 = 0) AS failed, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS native_pages, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS ocr_pages FROM documents""")
def run_manifest(spark, sf_dir):
    k = F.col("doc_id")
    page = lambda m: F.struct(F.lit(m).alias("method"))
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.lit("").alias("canonical_key"), F.when(k % 9 == 0, "failed").otherwise("processed").alias("status"), F.array(page("native"), F.when(k % 2 == 0, page("native")).otherwise(page("ocr"))).alias("pages"))
    return store.manifest(docs).select("documents", "works", "failed", "native_pages", "ocr_pages")


@query("""
SELECT event_id, CASE WHEN c.user_id IS NULL THEN 'miss' ELSE 'hit' END AS state FROM events e LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 5 = 0 AND value > 5) c ON e.user_id = c.user_id AND e.event_type = c.event_type""")
def cache_hits(spark, sf_dir):
    """Every fifth event of a value over 5 as a cache of its user and type."""
    events = table(spark, sf_dir, "events")
    wanted = events.select("event_id", "user_id", "event_type")
    cache = events.filter("event_id % 5 = 0").select("user_id", "event_type", F.when(F.col("value") > 5, F.lit("payload")).alias("payload"))
    hits, misses = store.cache_lookup(wanted, cache, ["user_id", "event_type"])
    return hits.select("event_id", F.lit("hit").alias("state")).unionByName(misses.select("event_id", F.lit("miss").alias("state")))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 3")
def lru_prune(spark, sf_dir):
    """The three entries that each user used last."""
    return store.pruned_per_group(table(spark, sf_dir, "events"), 3, group=["user_id"], order=["ts", "event_id"]).select("user_id", "event_id")


@query("""
SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(a.c_mktsegment, b.c_mktsegment) AS original, coalesce(b.c_mktsegment, a.c_mktsegment) AS current FROM
 (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0) a FULL JOIN (SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0) b ON a.c_custkey = b.c_custkey""")
def keyed_upsert(spark, sf_dir):
    """Customers saved again: new rows take the place of old ones, the original is kept."""
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 4 <> 0").select("c_custkey", F.col("c_mktsegment").alias("original"), F.col("c_mktsegment").alias("current"))
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lower("c_mktsegment").alias("original"), F.lower("c_mktsegment").alias("current"))
    return review.upserted(old, new, ["c_custkey"], keep_first=("original",))


layout_queries.register(query)
