import hashlib
import re
import time
from html import unescape

from bibspark.llm import warc
from pyspark.sql import functions as F


def parsed(record):
    head, _, rest = record.partition("\r\n\r\n")
    version, *lines = head.split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    body = rest.encode()
    n = int(fields["Content-Length"])
    assert version == "WARC/1.1" and body[n:] == b"\r\n\r\n"
    return fields, body[:n].decode()


def test_records_link_to_their_source(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.page_id: r for r in warc.responses_of_pages(pages).collect()}
    rows = warc.derive(warc.responses_of_pages(pages)).collect()
    assert len(rows) == 2 * len(sources) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        source = sources[r.page_id]
        fields, block = parsed(r.record)
        assert fields["WARC-Refers-To"] == source.record_id == r.refers_to
        assert fields["WARC-Target-URI"] == source.target_uri and fields["WARC-Date"] == source.date
        assert fields["WARC-Source-Payload-Digest"] == "sha256:" + hashlib.sha256(source.payload.encode()).hexdigest()
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
        if r.record_type == "metadata":
            named = dict(x.split(": ", 1) for x in block.strip().split("\r\n"))
            assert named["source-status"] == "HTTP/1.1 200 OK"
            assert named["source-header-Content-Length"] == str(len(source.payload.encode()))
            links = [unescape(x) for x in re.findall(r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"']*)", source.payload)]
            assert named["outlinks"] == str(len(links)) and [x[9:] for x in block.split("\r\n") if x.startswith("outlink: ")] == links
            assert fields["WARC-Source-HTTP-Status"] == "HTTP/1.1 200 OK" and fields["WARC-Source-Header-Content-Length"] == str(len(source.payload.encode()))
        else:
            assert fields["WARC-Source-HTTP-Status"] == "HTTP/1.1 200 OK" and fields["WARC-Source-Header-Content-Type"] == "text/html; charset=utf-8"
            assert "<p>" not in block and "track(" not in block and "  " not in block


def test_text_of_html(spark):
    html = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- c --><h1>A &amp; B</h1><p>one<br>two &lt;x&gt;<b> three</b></p>\n\n<p>1 < 2</p></body></html>"
    got = spark.createDataFrame([(html,)], "h string").select(warc.text_of_html(F.col("h"))).first()[0]
    assert got == "A & B\none\ntwo <x> three\n1 < 2"


def test_titles_and_links_are_decoded(spark):
    html = "<title>Caf&eacute; &#8217;s\n &amp; more</title><a class='x' href=\"/a?b=1&amp;c=2\">1</a> <A HREF='two words'>2</A> <a href=three>3</a> <abbr href=no> <a\nhref = \"\n four\">4</a>"
    row = warc.derive(warc.responses_of_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).filter("record_type = 'metadata'").first()
    lines = row.block.split("\r\n")
    assert "title: Café ’s & more" in lines and "outlinks: 4" in lines
    assert [x for x in lines if x.startswith("outlink: ")] == ["outlink: /a?b=1&c=2", "outlink: two words", "outlink: three", "outlink: four"]


def test_unclosed_markup_is_read_once(spark):
    """Pages of some MB that open the same thing again and again: what isn't closed reaches to the end, in linear time."""
    pieces = ("<!-- ", "<script ", "<script>", "<title>", "<title ", "<a ", "<div ", "<html ", "<a href=")
    took = []
    for n in (20_000, 80_000):
        pages = spark.createDataFrame([(i, "u", "before <b>" + x * n) for i, x in enumerate(pieces)], "page_id long, url string, html string")
        began = time.time()
        assert len(warc.digests(pages).collect()) == 2 * len(pieces)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 2


def test_odd_responses(spark):
    schema = "page_id long, record_id string, target_uri string, date string, http_head string, payload string, block string"
    rows = [
        (1, "<urn:uuid:1>", None, None, None, None, "b"),
        (2, "<urn:uuid:2>", "http://a/\r\nX: y", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: image/png\r\nX-A: 1\r\n\r\n", "bytes", "b"),
        (3, "<urn:uuid:3>", "http://b/", "2024-01-01T00:00:00Z", "HTTP/1.1 404 Not Found\r\nContent-Type: text/plain\r\n\r\n", "  <b>as is</b>", "b"),
        (3, "<urn:uuid:3>", "http://b/", "2024-01-01T00:00:00Z", "HTTP/1.1 404 Not Found\r\nContent-Type: text/plain\r\n\r\n", "  <b>as is</b>", "b"),
    ]
    got = warc.derive(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "conversion"), (1, "metadata"), (2, "metadata"), *[(3, "conversion")] * 2, *[(3, "metadata")] * 2]
    by = {(r.page_id, r.record_type): parsed(r.record) for r in got}
    assert "WARC-Target-URI" not in by[1, "metadata"][0] and by[1, "conversion"][1] == ""
    assert by[2, "metadata"][0]["WARC-Target-URI"] == "http://a/ X: y" and "source-header-X-A: 1" in by[2, "metadata"][1]
    assert by[3, "conversion"][1] == "  <b>as is</b>" and "source-status: HTTP/1.1 404 Not Found" in by[3, "metadata"][1]
    assert warc.digests(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc.digests(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).count() == 2


def test_all_references(spark):
    from html import unescape
    from html.entities import html5

    bits = [f"&{n}" for n in html5] + ["&copycat;", "&notit;", "&unknown;", "&", "&;", "a & b", "&amp;lt;", "&#38;lt;", "&lt&semi;", "&#169;", "&#xA9;", "&#XA9", "&#128;", "&#0;", "&#x1F600;", "&#xD800;", "&#1114112;", "&#99999999999;", "&#39;", "&#0000065;", "😀&copy;&middot;é"]
    got = spark.createDataFrame(list(enumerate(bits)), "i int, t string").select("i", warc.unescaped(F.col("t")).alias("t")).collect()
    assert {bits[r.i]: r.t for r in got} == {t: unescape(t).replace("\xa0", " ") for t in bits}
    line = " ".join(bits)
    assert spark.createDataFrame([(line,)], "t string").select(warc.unescaped(F.col("t"))).first()[0] == unescape(line).replace("\xa0", " ")


def test_conversions_hold_no_references(spark, sf_dir):
    rows = warc.derive(warc.responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).filter("record_type = 'conversion'").collect()
    assert rows and not any("&copy;" in r.block or "&middot;" in r.block for r in rows) and any("©" in r.block for r in rows)
