"""Operator 2: WARC derivative builder (WARC 1.1).

From each response record come a metadata record (application/warc-fields) and, where the payload is HTML or
plain text, a conversion record (text/plain).  Both refer to the response by WARC-Refers-To, keep its target URI and
date, and state the source's digest, HTTP status and headers; the metadata record's block has these too, with the page's title,
language and links.
Everything is a projection of one scan: no shuffle, no Python.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
SPEC = "WARC/1.1"

# How HTML becomes text, in order: (pattern, replacement) that means the same to Java and RE2, or (literal text, replacement).
# What isn't closed reaches to the end of the page, as in a browser; so no pattern begins anew within what it has read.
HIDDEN = (r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}\b[^>]*(?:>.*?(?:</{t}\s*>|\z)|\z)" for t in ("script", "style", "noscript", "template", "title")), " ")
BLOCKS = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*(?:>|\z)", "\n")
TAGS = (r"<[!/?A-Za-z][^>]*(?:>|\z)", "")
SPACES = (r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")
LINES = (r" ?\n[ \n]*", "\n")
BLANKS = r"[ \t\r\n\f\x0B]+"
TITLE = r"(?is)<title\b[^>]*(?:>|\z)(.*?)(?:</title\s*>|\z)"
LANG = r"(?i)<html\b[^<>]*\blang=[\"']?([A-Za-z0-9-]+)"
LINK = r"(?i)<a\s(?:[^<>]*\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
#: What stands for the date of a table of pages that has none.
DATE = "2024-01-01T00:00:00Z"


# Character references as HTML has them: a number, or a name; some old names stand without a semicolon, also at the start of a longer word.
REFERENCE = r"&(?:#(?:[xX][0-9A-Fa-f]+|[0-9]+)|[A-Za-z][A-Za-z0-9]*);?"
OLD = r"^(&(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + r"))(.*)$"
#: A lookup reads the map from its start, so the frequent ones come first.  A no-break space is a space, as in SPACES.
FREQUENT = ("amp;", "copy;", "middot;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "mdash;", "ndash;", "hellip;", "rsquo;", "lsquo;", "rdquo;", "ldquo;", "laquo;", "raquo;", "bull;", "reg;", "trade;", "eacute;", "uuml;", "ouml;", "auml;")
NAMES = {f"&{n}": html5[n].replace("\xa0", " ") for n in (*FREQUENT, *sorted(html5.keys() - set(FREQUENT), key=lambda n: (len(n), n)))}
#: Numbers that HTML reads otherwise: those of windows-1252, and those that are no characters.
NUMBERS = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {0: "\ufffd", 0xA0: " "}


def _map(pairs: dict) -> Column:
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def _number(ref: Column) -> Column:
    digits = F.ltrim(F.regexp_extract(ref, r"^&#[xX]?([0-9A-Fa-f]+)", 1), F.lit("0"))
    n = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    n = F.when(F.length(digits) == 0, 0).when(F.length(digits) > 7, 0x110000).otherwise(n.cast("int"))
    none = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(none, "\ufffd").otherwise(F.coalesce(F.try_element_at(_map(NUMBERS), n.cast("string")), F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")))


def _after_sign(part: Column) -> Column:
    """What stood after an & (up to the next one) with its reference decoded; one that HTML doesn't know stays."""
    name = F.substring_index(part, ";", 1)
    plain = F.concat(F.try_element_at(_map(NAMES), F.concat(F.lit("&"), name, F.lit(";"))), F.substring(part, F.length(name) + 2, F.length(part)))
    ref = F.regexp_extract(F.concat(F.lit("&"), part), f"^{REFERENCE}", 0)
    old = F.concat(F.try_element_at(_map(NAMES), F.regexp_extract(ref, OLD, 1)), F.regexp_extract(ref, OLD, 2))
    sign = F.when(F.startswith(ref, F.lit("&#")), _number(ref)).otherwise(F.coalesce(old, ref))
    other = F.when(ref == "", F.concat(F.lit("&"), part)).otherwise(F.concat(sign, F.substring(part, F.length(ref), F.length(part))))
    return F.coalesce(plain, other)


def unescaped(text: Column) -> Column:
    """The text with its character references decoded in one pass, so what a decoded one makes is not read again."""
    return F.array_join(F.transform(F.split(text, "&", -1), lambda part, i: F.when(i == 0, part).otherwise(_after_sign(part))), "")


def text_of_html(html: Column) -> Column:
    for pattern, replacement in (HIDDEN, BLOCKS, TAGS):
        html = F.regexp_replace(html, pattern, replacement)
    html = unescaped(html)
    for pattern, replacement in (SPACES, LINES):
        html = F.regexp_replace(html, pattern, replacement)
    return F.trim(html, F.lit(" \n"))


def urn(*parts: Column) -> Column:
    """A record id that follows from its parts, so building again gives the same one."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Named lines; a null value leaves its line out, line ends within a value become a space."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(v, r"[\r\n]+", " "), F.lit(CRLF))) for name, v in pairs]
    return F.concat_ws("", *lines)


def responses_of_pages(pages: DataFrame, *, key: str = "page_id", date: str = DATE) -> DataFrame:
    """Response records of a table of pages (key, url, html): key, record_id, target_uri, date, http_head, payload.

    A null html is an empty payload, a null url leaves the target URI out.  The table has no dates and no heads of
    responses: all get the one date given and the head of a plain answer with their length.
    """
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    page = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return pages.select(F.col(key), urn(F.lit("response"), page, F.coalesce("url", F.lit("")), F.md5(html)).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_head"), html.alias("payload"))


def derive(responses: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Derived records of response records (key, record_id, target_uri, date, http_head, payload), other columns left out.

    One row per derived record: key, record_type, record_id, refers_to, target_uri, source_digest, block_digest,
    content_type, block, record (header and block as they stand in a file).  A response that is neither HTML nor plain text
    by its Content-Type (missing: HTML) has no conversion.  Nulls: an absent payload or head counts as empty, an
    absent URI or date is left out.  Repeated responses give repeated records.
    """
    payload, head = F.coalesce("payload", F.lit("")), F.coalesce("http_head", F.lit(""))
    kind = F.nullif(F.lower(F.regexp_extract(head, r"(?im)^Content-Type:[ \t]*([^;\r\n ]*)", 1)), F.lit(""))
    base = responses.select(
        F.col(key).alias("key"), F.col("record_id").alias("refers_to"), "target_uri", "date", payload.alias("payload"), head.alias("head"), digest(payload).alias("source_digest"), digest(F.concat(head, payload)).alias("source_block_digest"), F.coalesce(kind, F.lit("text/html")).alias("kind")
    ).withColumn("links", F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), lambda x: F.trim(F.regexp_replace(unescaped(F.regexp_replace(x, "^[\"']|[\"']$", "")), BLANKS, " "))))
    html = F.col("kind").isin("text/html", "application/xhtml+xml")
    status = F.nullif(F.regexp_extract("head", r"^(HTTP/[^\r\n]*)", 1), F.lit(""))
    lines = F.filter(F.split("head", r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z0-9-]+:"))
    headers = lambda prefix: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(prefix), x, F.lit(CRLF))), "")
    meta = F.concat(
        _fields(
            ("title", F.when(html, F.nullif(F.trim(F.regexp_replace(unescaped(F.regexp_extract("payload", TITLE, 1)), BLANKS, " ")), F.lit("")))),
            ("language", F.when(html, F.nullif(F.regexp_extract("payload", LANG, 1), F.lit("")))),
            ("outlinks", F.when(html, F.size("links").cast("string"))),
            ("source-status", status),
            ("source-payload-digest", F.col("source_digest")),
            ("source-block-digest", F.col("source_block_digest")),
        ),
        headers("source-header-"),
        F.when(html, F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))), "")).otherwise(""),
    )
    text = F.when(html, text_of_html(F.col("payload"))).otherwise(F.col("payload"))
    base = base.withColumn("source_headers", F.concat(_fields(("WARC-Source-HTTP-Status", status)), headers("WARC-Source-Header-")))
    made = base.select("*", F.inline(F.filter(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block"), F.lit(True).alias("made")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block"), (html | (F.col("kind") == "text/plain")).alias("made")),
    ), lambda r: r["made"])))
    made = made.select("key", "record_type", urn(F.col("record_type"), F.col("refers_to"), F.md5("block")).alias("record_id"), "refers_to", "target_uri", "date", "source_digest", digest(F.col("block")).alias("block_digest"), "content_type", "block", "source_headers")
    top = F.concat(
        F.lit(SPEC + CRLF),
        _fields(
            ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Target-URI", F.col("target_uri")),
            ("WARC-Source-Payload-Digest", F.col("source_digest")), ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.octet_length("block").cast("string")),
        ),
        F.col("source_headers"),
        F.lit(CRLF),
    )
    return made.withColumn("record", F.concat(top, F.col("block"), F.lit(CRLF + CRLF))).drop("date", "source_headers").withColumnRenamed("key", key)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, source_digest, block_digest, block_bytes, record_sha256 of each derived record; nulls as in `derive`."""
    out = derive(responses_of_pages(pages))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", F.octet_length("block").cast("long").alias("block_bytes"), F.sha2("record", 256).alias("record_sha256"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_unescaped(text: str) -> str:
    """DuckDB: the text with its character references decoded; names and numbers come from tables of their own."""
    names = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in NAMES.items()) + "}"
    numbers = "MAP {" + ", ".join(f"{k}: {_quoted(v)}" for k, v in NUMBERS.items()) + "}"
    ref = f"regexp_extract('&' || p, {_quoted('^' + REFERENCE)})"
    old = f"regexp_extract({ref}, {_quoted(OLD)}, 1)"
    digits = f"ltrim(regexp_extract({ref}, '^&#[xX]?([0-9A-Fa-f]+)', 1), '0')"
    number = f"CASE WHEN {digits} = '' THEN 0 WHEN length({digits}) > 7 THEN 1114112 WHEN {ref} SIMILAR TO '&#[xX].*' THEN CAST('0x' || {digits} AS INTEGER) ELSE CAST({digits} AS INTEGER) END"
    sign = f"CASE WHEN ({number}) > 1114111 OR ({number}) BETWEEN 55296 AND 57343 THEN chr(65533) ELSE coalesce(({numbers})[{number}], chr({number})) END"
    named = f"coalesce(({names})[{ref}], CASE WHEN {old} <> '' THEN ({names})[{old}] || substr({ref}, length({old}) + 1) END, {ref})"
    after = f"CASE WHEN {ref} = '' THEN '&' || p WHEN {ref} LIKE '&#%' THEN ({sign}) || substr(p, length({ref})) ELSE {named} || substr(p, length({ref})) END"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {after} END), '')"


def sql() -> str:
    """The same for DuckDB."""
    step = lambda text, pattern, to: f"regexp_replace({text}, {_quoted(pattern)}, {'chr(10)' if to == chr(10) else _quoted(to)}, 'g')"
    text = "html"
    for s in (HIDDEN, BLOCKS, TAGS):
        text = step(text, *s)
    text = _sql_unescaped(text)
    for s in (SPACES, LINES):
        text = step(text, *s)
    text = f"trim({text}, ' ' || chr(10))"
    nl = "chr(13) || chr(10)"
    uuid = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
    line = lambda name, v: f"CASE WHEN {v} IS NULL THEN '' ELSE '{name}: ' || regexp_replace({v}, '[' || chr(13) || chr(10) || ']+', ' ', 'g') || {nl} END"
    blanks = lambda v: f"trim(regexp_replace({v}, {_quoted(BLANKS)}, ' ', 'g'))"
    raw_title = f"regexp_extract(html, {_quoted(TITLE)}, 1)"
    title = f"nullif({blanks(_sql_unescaped(raw_title))}, '')"
    lang = f"nullif(regexp_extract(html, {_quoted(LANG)}, 1), '')"
    bare = "regexp_replace(x, '^[\"'']|[\"'']$', '', 'g')"
    links = f"list_transform(regexp_extract_all(html, {_quoted(LINK)}, 1), lambda x: {blanks(_sql_unescaped(bare))})"
    source = "'WARC-Source-HTTP-Status: HTTP/1.1 200 OK' || " + nl + " || 'WARC-Source-Header-Content-Type: text/html; charset=utf-8' || " + nl + " || 'WARC-Source-Header-Content-Length: ' || bytes || " + nl
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || CAST(octet_length(encode(html)) AS VARCHAR) || {nl} || {nl} AS head,
  md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || md5(html)) AS m FROM p),
r AS (SELECT *, {links} AS links, CAST(octet_length(encode(html)) AS VARCHAR) AS bytes, {uuid("m")} AS refers_to, 'sha256:' || sha256(html) AS source_digest, 'sha256:' || sha256(head || html) AS source_block_digest FROM h),
made AS (
  SELECT page_id, url, bytes, refers_to, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    {line("title", title)} || {line("language", lang)} || {line("outlinks", "CAST(len(links) AS VARCHAR)")} || {line("source-status", "'HTTP/1.1 200 OK'")} || {line("source-payload-digest", "source_digest")} || {line("source-block-digest", "source_block_digest")}
    || 'source-header-Content-Type: text/html; charset=utf-8' || {nl} || 'source-header-Content-Length: ' || bytes || {nl} || array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {nl}), '') AS block FROM r
  UNION ALL
  SELECT page_id, url, bytes, refers_to, source_digest, 'conversion', 'text/plain; charset=utf-8', {text} FROM r),
ided AS (SELECT *, md5(record_type || '|' || refers_to || '|' || md5(block)) AS m, 'sha256:' || sha256(block) AS block_digest FROM made),
named AS (SELECT *, {uuid("m")} AS record_id FROM ided)
SELECT page_id, record_type, record_id, refers_to, url AS target_uri, source_digest, block_digest, CAST(octet_length(encode(block)) AS BIGINT) AS block_bytes,
  sha256('{SPEC}' || {nl} || {line("WARC-Type", "record_type")} || {line("WARC-Record-ID", "record_id")} || 'WARC-Date: {DATE}' || {nl} || {line("WARC-Refers-To", "refers_to")} || {line("WARC-Target-URI", "url")}
    || {line("WARC-Source-Payload-Digest", "source_digest")} || {line("WARC-Block-Digest", "block_digest")} || {line("Content-Type", "content_type")} || {line("Content-Length", "CAST(octet_length(encode(block)) AS VARCHAR)")} || {source} || {nl} || block || {nl} || {nl}) AS record_sha256
FROM named
"""
