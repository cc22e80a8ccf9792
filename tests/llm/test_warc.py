import glob
import gzip
import hashlib
import html
import json
import re
import time
from html.parser import HTMLParser

from folioscope.llm import warc
from folioscope.llm.queries import QUERIES

PAGE = (
    '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- x <p> -->'
    '<h1>One</h1><p>Two <b>bold</b>&nbsp;&lt;tag&gt;</p><a href="/a?x=1&amp;y=2">link</a>\n text<br>last</body></html>'
)
COLUMNS = "page_id bigint, url string, html string, body string, record_id string"


def derived(spark, rows):
    pages = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], COLUMNS)
    return warc.derive(warc.responses(pages))


def test_records_of_a_page(spark):
    meta, text = sorted(derived(spark, [(1, "http://e/", PAGE)]).collect(), key=lambda r: r.warc_type, reverse=True)
    assert text.block == "One\nTwo bold <tag>\nlink text\nlast"
    envelope = json.loads(meta.block)
    assert envelope["title"] == "A & B" and envelope["language"] == "fr" and envelope["links"] == ["/a?x=1&y=2"]
    assert envelope["headers"][0].startswith("Content-Type") and envelope["status"] == "HTTP/1.1 200 OK"
    for r in (meta, text):
        assert r.payload_digest == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>", r.record_id)
    assert meta.refers_to == text.refers_to and len({meta.refers_to, meta.record_id, text.record_id}) == 3


def test_nulls_empty_and_repeated(spark):
    rows = [(None, None, None), (2, "u", ""), (3, "u", "x" * 200_000), (3, "u", "x" * 200_000), (4, "u", "<p")]
    found = derived(spark, rows).collect()
    assert len(found) == 2 * len(rows)
    texts = sorted(r.block for r in found if r.warc_type == "conversion")
    assert texts == ["", "", "<p", "x" * 200_000, "x" * 200_000]
    assert len({r.record_id for r in found}) == 2 * (len(rows) - 1)
    assert derived(spark, []).collect() == []


def test_files_can_be_read_back(spark, tmp_path):
    records = derived(spark, [(i, f"http://e/{i}", PAGE + "é\r\n\r\nWARC/1.1\r\n" * i) for i in range(5)])
    warc.write_warc(records, str(tmp_path / "w"))
    found = []
    for file in glob.glob(str(tmp_path / "w" / "*.gz")):
        data = gzip.open(file).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(fields["Content-Length"])
            assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(rest[:n]).hexdigest()
            assert rest[n : n + 4] == b"\r\n\r\n"
            found.append((fields["WARC-Record-ID"], fields["WARC-Refers-To"], rest[:n].decode()))
            data = rest[n + 4 :]
    assert sorted(found) == sorted((r.record_id, r.refers_to, r.block) for r in records.collect())


def test_references_and_links_as_html_reads_them(spark):
    page = (
        "<html><head><title>Caf&eacute; &#8212;&nbsp;&hellip;</title></head><body>"
        "<p>&copy; 2024 &middot; it&#8217;s &#x2014; &amp;lt; &amp &nosuch; a&#160;b &#10;c</p>"
        """<a href="/it's?a=1&copy=2&amp;b=3">x</a><a class=k href=/plain>y</a><A title='>"' HREF = '/q"r'>z</A><a data-href="/no">n</a>"""
        "<a href=/c&eacute;>w</a><a name=top>t</a></body></html>"
    )
    meta, text = sorted(derived(spark, [(1, "u", page)]).collect(), key=lambda r: r.warc_type, reverse=True)
    assert text.block.split("\n")[0].startswith("\xa9 2024 \xb7 it’s — &lt; & &nosuch; a b c")
    envelope = json.loads(meta.block)
    assert envelope["title"] == "Caf\xe9 — …"
    assert envelope["links"] == ["/it's?a=1&copy=2&b=3", "/plain", '/q"r', "/c\xe9"]


class Reader(HTMLParser):
    """Links, title and language by the HTML reader of the standard library."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.links, self.title, self.language, self._in_title = [], None, None, False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        found = dict(reversed(attrs))
        if tag == "a" and found.get("href") is not None:
            self.links.append(found["href"])
        if tag == "html" and self.language is None:
            self.language = found.get("lang")
        self._in_title = tag == "title" and self.title is None

    def handle_data(self, data):
        if self._in_title:
            self.title = (self.title or "") + data

    def handle_endtag(self, tag):
        self._in_title = False


def test_query_reads_every_page_as_html(spark):
    """All pages: title, language and links as another reader has them, and no reference left that means something."""
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    found = QUERIES["op1_warc_derivatives"](spark, "/root/testdata/sf0.01").collect()
    assert len(found) == 2 * len(pages)
    for r in found:
        if r.warc_type == "metadata":
            envelope, reader = json.loads(r.block), Reader(pages[r.page_id])
            assert envelope["links"] == reader.links
            assert envelope["title"] == " ".join((reader.title or "").split())
            assert envelope["language"] == (reader.language or "")
        else:
            assert html.unescape(r.block) == r.block and "<" not in r.block
            body = re.sub(r"(?is)<head\b.*?</head\s*>|<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", pages[r.page_id])
            words = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
            assert "".join(r.block.split()) == "".join(words)


def test_hostile_markup_takes_time_in_proportion(spark):
    n = 200_000
    texts = ["<" * n, "<!--" * n, "<script " * n, "<title" * n, "<title>" * n, "<html " * n, "<a " * n, "<a href=" * n, '<a b="' * n, "&" * n,
             "<p" + " " * n, "</title" * n, "<!-- " * 9 + "x -->" * n, "\n" * n + "x", "lang=" * n, "<html lang=" * n]
    start = time.time()
    found = derived(spark, [(i, "http://e/", t) for i, t in enumerate(texts)]).collect()
    assert len(found) == 2 * len(texts) and time.time() - start < 60
    assert {r.block for r in found if r.page_id == 0 and r.warc_type == "conversion"} == {"<" * n}


def test_fields_keep_their_lines(spark):
    record = derived(spark, [(1, "http://e/a\r\nX-Other: 1", "x")])
    text = sorted(r.value for r in warc.as_warc(record).collect())[0]
    head = text.partition("\r\n\r\n")[0].split("\r\n")
    assert "WARC-Target-URI: http://e/a%0D%0AX-Other: 1" in head and not any(line.startswith("X-Other") for line in head)
    assert "Source-Content-Type: text/html; charset=utf-8" in head and f"Source-Server: {warc.SERVER}" in head
