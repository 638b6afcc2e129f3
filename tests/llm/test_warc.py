"""WARC derivatives of pages that aren't plain: entities, charsets, damage."""

import gzip
import hashlib
import json
import random
import re
import time

import pytest

from opsweave.llm import warc


def record(i, body, charset="utf-8", length=None):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n".encode() + body
    n = len(block) if length is None else length
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nWARC-Payload-Digest: sha1:P{i}\r\nContent-Type: application/http\r\nContent-Length: {n}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_entities(spark):
    pages = spark.createDataFrame([(1, "u", "<p>caf&eacute; &mdash; it&#8217;s&nbsp;&#x2019;&#160;&amp;lt; &copy;</p>")], "page_id long, url string, html string")
    text = warc.derivatives(warc.responses_from_pages(pages)).where("warc_type = 'conversion'").first().block
    assert text == "café — it’s ’ &lt; ©"


def test_charset_digests_and_damage(spark, tmp_path):
    body = "<p>naïve</p>".encode("latin-1")
    parts = [record(1, body, "iso-8859-1"), record(2, b"x", length="none"), record(3, b"lost", length=9), record(4, b"WARC/ inside\r\nWARC/1.1"), record(5, b"end")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(6, b"six")) + gzip.compress(record(7, b"seven"))[:30] + gzip.compress(record(8, b"eight")))
    rows = warc.read_warc(spark, str(tmp_path))
    sound = {r.record_id: r for r in rows.where("damage is null").collect()}
    assert sorted(sound) == ["<1>", "<4>", "<5>", "<6>", "<8>"]
    assert {r.record_id for r in rows.where("damage is not null").collect()} >= {"<2>", "<3>"}
    assert sound["<1>"].payload == "<p>naïve</p>" and bytes(sound["<1>"].body) == body and sound["<1>"].payload_digest == "sha1:P1"
    made = warc.derivatives(rows.where("record_id = '<1>'")).where("warc_type = 'metadata'").first()
    assert made.source_digest == "sha256:" + hashlib.sha256(body).hexdigest()
    found = json.loads(made.block)
    assert found["stated_payload_digest"] == "sha1:P1" and found["payload_length"] == len(body)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, None, None, 1, 2), (3, "u", "<p>x", 3, 4), (3, "u", "<p>x", 3, 4)]
    responses = warc.responses_from_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int, d int")).selectExpr("*", "page_id + 1 as text", "'kept' as d")
    got = sorted((str(r.page_id), r.warc_type, r.block if r.warc_type == "conversion" else "", str(r.text), r.d) for r in warc.derivatives(responses, keep=("page_id", "text", "d")).collect())
    assert got == [("3", "conversion", "x", "4", "kept")] * 2 + [("3", "metadata", "", "4", "kept")] * 2 + [("None", "conversion", "", "None", "kept"), ("None", "metadata", "", "None", "kept")]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses_from_pages(empty)).count() == 0
    with pytest.raises(ValueError):
        warc.derivatives(responses.withColumn("block", responses["d"]), keep=("block",))


UNSHOWN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<title\b.*?</title\s*>|<template\b.*?</template\s*>"


def by_patterns(markup):
    """Text, title and links by plain patterns, which may take quadratic time."""
    t = re.sub(r"[\t\n\x0B\f\r ]+", " ", re.sub(UNSHOWN, " ", markup, flags=re.A))
    t = re.sub(warc.BREAKS.pattern, "\n", t, flags=re.I | re.A)
    t = warc.html.unescape(warc.NO_BREAK.sub(" ", re.sub("<[^>]*>", "", t)))
    title = re.search(r"(?is)<title[^>]*>(.*?)</title", markup)
    return re.sub("^\n+|\n+$", "", re.sub(" *\n[ \n]*", "\n", t)).strip(" "), title[1].strip(" ") if title else "", len(re.findall(r"(?i)<a\s[^>]*href", markup, re.A))


def test_text_as_by_plain_patterns():
    pieces = ["<!--", "-->", "<script", "<SCRIPT x>", "</script >", "</script", "<style>", "</style>", "<head>", "<header>", "</head\n>", "<title", "<titles>", "</title>", "<template>", "</template>"]
    pieces += ["<", ">", "<p", "<br/>", "</div>", "<b>", "a", "b c", " ", "\n", "\t ", "&nbsp;", "&lt;", "&#10;", "<a ", "<A\nhref=x>", "href", "HREF>", "\u0130", "\u212a", "-", "!"]
    draw = random.Random(5)
    for _ in range(20000):
        page = "".join(draw.choices(pieces, k=draw.randrange(25)))
        assert (warc.text_of_markup(page), warc.title_of(page), warc.links_of(page)) == by_patterns(page), page


@pytest.mark.parametrize("piece", ["<!--", "<script ", "<", "<p ", "<title", "<title>", "<a ", "<a href ", "</script", "&nbsp;", " \n", "<!-- --", "<head><title>", "</title ", "<style></style", "&"])
def test_bad_markup_takes_linear_time(piece):
    page = piece * ((1 << 20) // len(piece))
    began = time.process_time()
    warc.text_of_markup(page), warc.title_of(page), warc.links_of(page)
    assert time.process_time() - began < 2


def test_page_over_a_million_characters(spark):
    page = "<p>word</p>" * 150000 + "<!--" * 10000
    rows = warc.derivatives(warc.responses_from_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))).collect()
    assert {r.block for r in rows if r.warc_type == "conversion"} == {"\n".join(["word"] * 150000) + "\n" + "<!--" * 10000}
