"""Derivative WARC records of web responses: linked metadata and plain text.

``responses`` turns stored pages into response records, ``derive`` turns each response into one
metadata record (the response's headers and digests, its title, language and links) and one conversion
record (its text). Both name the response in WARC-Refers-To and keep its target URI, date, payload
digest and source headers; their ids follow from the response's id, so a repeated run gives the same
records. ``write_warc`` writes records as WARC 1.1 files.

Pages are read in Arrow batches, each from left to right: what an opening without an end would leave
open is text, and nothing is searched twice, so hostile markup takes time in proportion to its size.
Everything works on single rows: no shuffle, whatever one host or page holds.

Null bodies and urls are empty; an empty body gives an empty text and no links; rows equal in all
columns give equal records, one set per row; an empty table gives none; further columns of the input
are left out, so their names can't clash.
"""

from __future__ import annotations

import html as markup
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pages carry no capture time; records need one.
CAPTURED = "2024-01-01T00:00:00Z"
SERVER = "folioscope"

SPACE = r"[ \t\n\x0B\f\r]+"
#: Elements that end a line of text.
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"

_HIDDEN = re.compile(r"<!--|<(script|style|head)\b", re.I)
_HIDDEN_ENDS = {None: re.compile("-->"), **{k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "head")}}
_BREAKS = re.compile(rf"</?(?:{_BLOCKS})\b[^>]*>", re.I)
_TAGS = re.compile(r"<[^>]*>")
_BLANK = re.compile(SPACE)
_SPACES = re.compile(r"[ \t\r\x0B\x0C]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title[^>]*", re.I)
_TITLE_END = re.compile(r"</title", re.I)
_HTML = re.compile(r"<html[^>]*", re.I)
_LANGUAGE = re.compile(r"""(?=\blang=["']?([A-Za-z-]+))""", re.I)

_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")
_IN_VALUE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=]))))")
_ANCHOR = re.compile(r"<a(?=[ \t\n\f\r/])", re.I)
_ATTRIBUTE = re.compile(
    r"""[ \t\n\f\r/]*([^ \t\n\f\r/>=]+)"""
    r"""(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r>"'][^ \t\n\f\r>]*)))?"""
)


def unescaped(text: str) -> str:
    """Text with all references decoded, once, from left to right; white space that they name is a space."""

    def meaning(m: re.Match) -> str:
        found = markup.unescape(m[0])
        return " " if found and found in "\t\n\f\r\xa0" else found

    return _REFERENCE.sub(meaning, text)


def unescaped_value(value: str) -> str:
    """As HTML reads attributes: a name without semicolon before a letter, digit or = is no reference."""
    return _IN_VALUE.sub(lambda m: html5.get(m[1], m[0]) if m[1] else markup.unescape(m[0]), value)


def link_targets(html: str) -> list[str]:
    """The href of each anchor that has one, in double, single or no quotes. An anchor ends before the next is looked for."""
    found = []
    at = 0
    while anchor := _ANCHOR.search(html, at):
        at, href = anchor.end(), None
        while m := _ATTRIBUTE.match(html, at):
            if href is None and m[1].lower() == "href":
                href = next((x for x in m.groups()[1:] if x is not None), None)
            at = m.end()
        if href is not None:
            found.append(unescaped_value(href))
    return found


def _shown(html: str) -> str:
    """Markup without comments, scripts, styles and the head, a space in place of each."""
    parts: list[str] = []
    at = 0
    open_ended = set()
    for m in _HIDDEN.finditer(html):
        kind = m[1] and m[1].lower()
        if m.start() < at or kind in open_ended:
            continue
        end = _HIDDEN_ENDS[kind].search(html, m.end())
        if end is None:
            open_ended.add(kind)
        else:
            parts += (html[at : m.start()], " ")
            at = end.end()
    return "".join([*parts, html[at:]])


def visible_text(html: str) -> str:
    """The visible text of a page, a line for each block, without markup and with references decoded."""
    text = _BLANK.sub(" ", _shown(html))
    # Behind the last > no tag ends.
    last = text.rfind(">") + 1
    text = _TAGS.sub("", _BREAKS.sub("\n", text[:last])) + text[last:]
    return _LINES.sub("\n", _SPACES.sub(" ", unescaped(text))).strip(" \n")


def title_of(html: str) -> str:
    """The content of the first title element, or the empty text."""
    begin = _TITLE.search(html)
    end = begin and html[begin.end() : begin.end() + 1] == ">" and _TITLE_END.search(html, begin.end() + 1)
    return _BLANK.sub(" ", unescaped(html[begin.end() + 1 : end.start()])).strip(" ") if end else ""


def language_of(html: str) -> str:
    """The last lang attribute of the first html tag that has one."""
    for tag in _HTML.finditer(html):
        found = _LANGUAGE.findall(tag[0])
        if found:
            return found[-1]
    return ""


_PAGE = pa.struct([("title", pa.string()), ("language", pa.string()), ("links", pa.list_(pa.string())), ("text", pa.string())])


def _read_pages(bodies: pa.Array) -> pa.Array:
    read = []
    for body in bodies.to_pylist():
        html = body.decode("utf-8", "replace")
        read.append({"title": title_of(html), "language": language_of(html), "links": link_targets(html), "text": visible_text(html)})
    return pa.array(read, _PAGE)


def read_page(body: Column) -> Column:
    """Title, language, link targets and visible text of a body."""
    read = F.arrow_udf(_read_pages, "title string, language string, links array<string>, text string")
    return read(F.coalesce(body, F.lit("")).cast("binary"))


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A UUID that follows from the parts."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    pieces = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.format_string("<urn:uuid:%s-%s-5%s-a%s-%s>", *pieces)


def responses(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", captured: str = CAPTURED
) -> DataFrame:
    """A response record for each page: id, uri, date, HTTP headers, body and digests."""
    body = F.coalesce(F.col(html), F.lit(""))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(f"\r\nServer: {SERVER}\r\n\r\n"),
    )
    return (
        pages.select(
            F.col(page_id).alias("page_id"),
            F.coalesce(F.col(url), F.lit("")).alias("target_uri"),
            F.lit(captured).alias("date"),
            headers.alias("http_headers"),
            body.alias("body"),
        )
        .withColumn("payload_digest", digest(F.col("body")))
        .withColumn("block_digest", digest(F.concat("http_headers", "body")))
        .withColumn(
            "record_id",
            record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest")),
        )
    )


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` first, then ``conversion``."""
    records = records.withColumn("page", read_page(F.col("body")))
    lines = F.split(F.col("http_headers"), "\r\n")
    source_headers = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x != "")
    envelope = F.to_json(
        F.struct(
            F.element_at(lines, 1).alias("status"),
            source_headers.alias("headers"),
            F.col("payload_digest"),
            F.col("block_digest").alias("source_block_digest"),
            F.col("page.title").alias("title"),
            F.col("page.language").alias("language"),
            F.col("page.links").alias("links"),
        )
    )

    def made(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), F.lit(content_type).alias("content_type"), block.alias("block"))

    both = F.array(
        made("metadata", "application/json", envelope),
        made("conversion", "text/plain; charset=utf-8", F.col("page.text")),
    )
    out = records.select(
        "page_id", "target_uri", "date", "payload_digest",
        F.col("block_digest").alias("source_block_digest"),
        F.array_join(source_headers, "\n").alias("source_headers"),
        F.col("record_id").alias("refers_to"),
        F.explode(both).alias("made"),
    ).select("*", "made.*")
    return out.select(
        record_id(F.col("warc_type"), F.col("refers_to")).alias("record_id"),
        "warc_type", "page_id", "target_uri", "date", "refers_to", "source_headers", "payload_digest",
        "source_block_digest", "content_type",
        F.octet_length("block").cast("bigint").alias("content_length"),
        digest(F.col("block")).alias("block_digest"),
        "block",
    )


def as_warc(records: DataFrame) -> DataFrame:
    """Each record as WARC 1.1 text, without the two line ends that close it.

    The headers of the source follow as fields ``Source-...``. A line break inside a field is written as in a URI.
    """
    fields = (
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"), ("WARC-Refers-To", "refers_to"), ("WARC-Payload-Digest", "payload_digest"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Block-Digest", "source_block_digest"),
        ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )

    def line(text: Column) -> Column:
        return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    head = [F.concat(F.lit(f"{name}: "), line(F.col(c).cast("string")), F.lit("\r\n")) for name, c in fields]
    source = F.transform(F.split("source_headers", "\n"), lambda h: F.when(h != "", F.concat(F.lit("Source-"), line(h), F.lit("\r\n"))))
    return records.select(
        F.concat(F.lit("WARC/1.1\r\n"), *head, F.array_join(source, ""), F.lit("\r\n"), F.col("block")).alias("value")
    )


def write_warc(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """WARC files, one for each partition; the line separator of the writer closes each record."""
    as_warc(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(folder)
