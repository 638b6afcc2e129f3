"""WARC derivatives: from response records, a metadata record and a plain-text conversion record each.

Derivatives name their source in WARC-Refers-To, carry its target URI, date and HTTP headers, and its payload digest; their
blocks have digests of their own. Records are rows, and Spark's own functions work on them, but for one that makes a page's text, title and number of links, in time
that grows as the page does, whatever its markup; read_warc() and serialised() translate from and to the file format.

A null payload is an empty one, null URIs and headers are empty strings in the records; a null page_id stays null. Ids follow from the
contents, so that reruns agree; equal responses at one URI and date have equal ids, and rows that repeat have their derivatives each.
An empty table has none. A file is read by one task as one value, so it may have 2 GB at most.
"""

from __future__ import annotations

import codecs
import html
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

EOL = "\r\n"
#: Elements that a page does not show, with comments; what ends each.
UNSHOWN = re.compile(r"<(?:!--|(?:script|style|head|title|template)\b)", re.I | re.A)
ENDS = {"<!--": re.compile("-->")} | {f"<{x}": re.compile(rf"</{x}\s*>", re.I | re.A) for x in ("script", "style", "head", "title", "template")}
BLANKS = re.compile(r" [\t\n\x0B\f\r ]+|[\t\n\x0B\f\r][\t\n\x0B\f\r ]*")
BREAKS = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|table|tr|br|hr|article|section|nav|header|footer|aside|main|blockquote|pre|body|html)\b[^>]*>", re.I | re.A)
TAG, TITLE, TITLE_END, ANCHOR, HREF = re.compile("<[^>]*>"), *[re.compile(x, re.I | re.A) for x in ("<title", "</title", r"<a\s", "href")]
NO_BREAK = re.compile(r"&(?:nbsp;?|#0*160;|#[xX]0*[aA]0;)")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", re.I)
MADE = ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_digest", "block")
MEMBER = b"\x1f\x8b\x08"


def urn(*parts: Column) -> Column:
    """A record id from contents: MD5 in the form of a UUID."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def _shown(markup: str) -> str:
    """markup with a blank for each element that is not shown; one that never ends stays. An end that was sought in vain is not sought again."""
    out, at, start, unended = [], 0, 0, set()
    while found := UNSHOWN.search(markup, at):
        at, kind = found.end(), found[0].lower()
        end = None if kind in unended else ENDS[kind].search(markup, at)
        if end:
            out += (markup[start : found.start()], " ")
            at = start = end.end()
        else:
            unended.add(kind)
    return "".join([*out, markup[start:]])


def text_of_markup(markup: str) -> str:
    """Text of a page without tags: blocks on lines of their own, blanks collapsed, entities as characters, no-break ones as blanks.

    In time that grows as the length does: behind the last > there is no tag, and before it each < finds its >.
    """
    t = BLANKS.sub(" ", _shown(markup))
    cut = t.rfind(">") + 1
    t = TAG.sub("", BREAKS.sub("\n", t[:cut])) + t[cut:]
    if "&" in t:
        t = html.unescape(NO_BREAK.sub(" ", t))
    return "\n".join(filter(None, (line.strip(" ") for line in t.split("\n"))))


def title_of(markup: str) -> str:
    """What stands in the first title, entities as they are."""
    start = TITLE.search(markup)
    at = markup.find(">", start.end()) + 1 if start else 0
    end = TITLE_END.search(markup, at) if at else None
    return markup[at : end.start()].strip(" ") if end else ""


def links_of(markup: str) -> int:
    """Number of anchors with an address."""
    n, at = 0, 0
    while found := ANCHOR.search(markup, at):
        at = markup.find(">", found.end())
        at = at if at >= 0 else len(markup)
        n += HREF.search(markup, found.end(), at) is not None
    return n


@F.pandas_udf(StructType().add("text", StringType()).add("title", StringType()).add("links", IntegerType()))
def rendered(markup: pd.Series) -> pd.DataFrame:
    """Text, title and number of links of pages."""
    pages = markup.tolist()
    return pd.DataFrame({"text": [text_of_markup(x) for x in pages], "title": [title_of(x) for x in pages], "links": [links_of(x) for x in pages]})


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of fetched pages (page_id, url, html)."""
    url, payload = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        urn(F.lit("response"), url, F.lit(date), payload).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
    )


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each response (record_id, target_uri, warc_date, http_headers, payload), with the columns in keep:

    warc_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, source_digest, block.
    keep may not name any of these. Where responses have body (the payload's bytes), length and source_digest are taken of it; digests that the source states
    (payload_digest, warc_block_digest) stand in the metadata.
    """
    if clash := set(keep) & set(MADE):
        raise ValueError(f"derivatives have columns of these names: {sorted(clash)}")
    own = [c for c in ("body", "payload_digest", "warc_block_digest") if c in responses.columns]
    responses = responses.select("*", *[F.col(c).alias(f"__{c}") for c in own])
    strings = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload")}
    held = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)
    r = responses.select(held.alias("__kept"), *[v.alias(c) for c, v in strings.items()], *[f"__{c}" for c in own])
    body = F.coalesce("__body", F.col("payload").cast("binary")) if "body" in own else F.col("payload")
    stated = [F.col(f"__{c}").alias(name) for c, name in (("payload_digest", "stated_payload_digest"), ("warc_block_digest", "stated_block_digest")) if c in own]
    r = r.withColumn("source_digest", digest(body)).withColumn("page", rendered("payload"))
    text = F.col("page.text")
    found = F.to_json(
        F.struct(
            F.col("record_id").alias("refers_to"),
            F.col("target_uri"),
            F.col("source_digest").alias("payload_digest"),
            F.octet_length(body).alias("payload_length"),
            F.col("http_headers"),
            F.col("page.title").alias("title"),
            F.col("page.links").alias("links"),
            F.octet_length(text).alias("text_length"),
            *stated,
        )
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/json").alias("content_type"), found.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")),
    )
    d = r.withColumn("d", F.explode(both)).select("__kept", "d.*", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "source_digest")
    return d.select(
        *[F.col("__kept")[c].alias(c) for c in keep],
        "warc_type",
        urn(F.col("warc_type"), F.col("refers_to"), F.col("block")).alias("record_id"),
        "refers_to",
        "target_uri",
        "warc_date",
        "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"),
        "source_digest",
        "block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """records with a binary column: each derivative as it stands in a WARC file."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "warc_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-Date: "), "warc_date"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), "source_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    return records.withColumn("record", F.concat(F.concat_ws(EOL, *lines), F.lit(EOL * 2), "block", F.lit(EOL * 2)).cast("binary"))


def inflated(data: bytes) -> bytes:
    """The bytes of a WARC file, compressed or not; after a damaged member of a compressed one, the next member that can be read."""
    if data[:2] != MEMBER[:2]:
        return data
    out, at = [], 0
    while at >= 0:
        d, to = zlib.decompressobj(31), at
        try:
            while to < len(data) and not d.eof:
                out.append(d.decompress(data[to : to + (1 << 16)]))
                to = min(to + (1 << 16), len(data))
        except zlib.error:
            pass
        if not d.eof:
            out.append(b"\r\nWARC/damaged\r\n\r\n")
        at = data.find(MEMBER, to - len(d.unused_data) if d.eof else at + 1)
    return b"".join(out)


def records_of(data: bytes):
    """(headers, block, damage) of each record in a WARC file, compressed or not; damage is null for a sound record.

    A damaged record (no length, or a length that doesn't end before another record or the end) has all bytes up to the next WARC/ line.
    """
    data = inflated(data)
    start = 0 if data.startswith(b"WARC/") else data.find(b"\nWARC/") + 1 or len(data)
    if data[:start].strip():
        yield {}, data[:start], "no record"
    while start < len(data):
        after = data.find(b"\nWARC/", start) + 1 or len(data)
        ends = re.compile(rb"\r?\n\r?\n").search(data, start)
        headers: dict[str, str] = {}
        at = ends.end() if ends else len(data)
        for line in data[start:at].splitlines()[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        end = at + int(size) if size.isascii() and size.isdigit() else -1
        following = re.compile(rb"[\r\n]*").match(data, end).end() if 0 <= end <= len(data) else -1
        if following >= 0 and (following == len(data) or data.startswith(b"WARC/", following)):
            yield headers, data[at:end], None
            start = following
        else:
            yield headers, data[min(at, after) : after], "length" if end >= 0 else "no length"
            start = after


def text_of(body: bytes, declared: str) -> str:
    """A payload by its declared charset (HTTP header, else the page's start), else UTF-8; replacement characters where it doesn't hold."""
    found = CHARSET.search(declared.encode("utf-8", "replace")) or CHARSET.search(body[:1024])
    try:
        name = codecs.lookup(found[1].decode() if found else "utf-8").name
        return body.decode({"iso8859-1": "cp1252", "ascii": "cp1252"}.get(name, name), "replace")  # as browsers read these labels
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """warc_type, record_id, refers_to, target_uri, warc_date, http_headers, payload of every record in the files, a task for each file;

    body (the payload's bytes), payload_digest and warc_block_digest (as the record states them), damage (null for a sound record).
    """
    names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date")

    def run(batches):
        for batch in batches:
            rows = []
            for content in batch["content"]:
                for h, block, damage in records_of(content):
                    head, cut, body = block.partition(b"\r\n\r\n")
                    if not h.get("content-type", "").startswith("application/http") or not cut:
                        head, body = b"", block
                    http = head.decode("utf-8", "replace")
                    stated = re.search(r"(?im)^content-type:.*$", http)
                    rows.append((*[h.get(n) for n in names], http, text_of(body, stated[0] if stated else h.get("content-type", "")), body, h.get("warc-payload-digest"), h.get("warc-block-digest"), damage))
            yield pd.DataFrame(rows, columns=["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "http_headers", "payload", "body", "payload_digest", "warc_block_digest", "damage"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, http_headers string, payload string, body binary, payload_digest string, warc_block_digest string, damage string")


#: What op2_warc returns, for DuckDB.
ORACLE = r"""
with r as (
  select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload, '2024-01-01T00:00:00Z' as warc_date from pages
), h as (
  select *, concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(payload)) as http_headers,
    md5(concat_ws(chr(10), 'response', target_uri, warc_date, payload)) as m, concat('sha256:', sha256(payload)) as source_digest,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload,
      '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<title\b.*?</title\s*>|<template\b.*?</template\s*>', ' ', 'gis'),
      '[\t\n\x0B\f\r ]+', ' ', 'g'),
      '</?(?:p|div|h[1-6]|ul|ol|li|table|tr|br|hr|article|section|nav|header|footer|aside|main|blockquote|pre|body|html)\b[^>]*>', chr(10), 'gi'),
      '<[^>]*>', '', 'g') as t0
  from r
), t as (
  select *, concat('<urn:uuid:', m[1:8], '-', m[9:12], '-', m[13:16], '-', m[17:20], '-', m[21:32], '>') as rid,
    trim(regexp_replace(regexp_replace(
      replace(replace(replace(replace(replace(replace(replace(replace(t0, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
      ' *\n[ \n]*', chr(10), 'g'), '^\n+|\n+$', '', 'g'), ' ') as text
  from h
), d as (
  select page_id, 'metadata' as warc_type, rid, target_uri, warc_date, source_digest, 'application/json' as content_type,
    cast(json_object('refers_to', rid, 'target_uri', target_uri, 'payload_digest', source_digest, 'payload_length', strlen(payload), 'http_headers', http_headers,
      'title', trim(regexp_extract(payload, '<title[^>]*>(.*?)</title', 1, 'is'), ' '), 'links', len(regexp_extract_all(payload, '<a\s[^>]*href', 0, 'i')), 'text_length', strlen(text)) as varchar) as block
  from t
  union all
  select page_id, 'conversion', rid, target_uri, warc_date, source_digest, 'text/plain; charset=utf-8', text from t
), k as (
  select *, md5(concat_ws(chr(10), warc_type, rid, block)) as m from d
)
select page_id, warc_type, concat('<urn:uuid:', m[1:8], '-', m[9:12], '-', m[13:16], '-', m[17:20], '-', m[21:32], '>') as record_id, rid as refers_to,
  target_uri, warc_date, content_type, cast(strlen(block) as bigint) as content_length, concat('sha256:', sha256(block)) as block_digest, source_digest, block
from k
"""
