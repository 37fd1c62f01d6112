"""Single expressions on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from noteweave.functions import charset, fixed, notes, text, urls
from noteweave.functions.html import decode_entities, tokens
from noteweave.functions.sqltext import collapse_space, js_trim, pack_paragraphs, paragraphs_to_markup, text_lines, utf16_len


@pytest.fixture(scope="module")
def value(spark):
    def evaluate(column, **columns):
        row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
        return row.select((F.expr(column) if isinstance(column, str) else column).alias("v")).first().v

    return evaluate


@pytest.mark.parametrize(
    "given, expected",
    [
        ("1507018057", "20171003T080737Z"),
        ("0", "19700101T000000Z"),
        (" 12abc", "19700101T000012Z"),
        ("-1", "19691231T235959Z"),
        ("soon", None),
        ("", None),
        ("99999999999999999999", None),
        ("9000000000000", None),
    ],
)
def test_time(value, given, expected):
    assert value(text.enex_time(F.lit(given))) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ('<script>alert("XSS")</script>', "&lt;script&gt;alert(&quot;XSS&quot;)&lt;/script&gt;"),
        ("It's a test", "It&#39;s a test"),
        ("a & b &amp;", "a &amp; b &amp;amp;"),
        ("x\x00\x08\x0b\x0c\x0e\x1f\x7fy\t\n", "xy\t\n"),
        ("", ""),
        ("日本語 Emoji 😀🎉 Русский 한국어 é", "日本語 Emoji 😀🎉 Русский 한국어 é"),
    ],
)
def test_escape(value, given, expected):
    assert value(text.escape_html(F.lit(given))) == expected


def test_javascript_strings(value):
    assert value(utf16_len("'a😀'")) == 3
    spaces = "　﻿   "
    assert value(js_trim("x"), x=f"{spaces}a b{spaces}\n") == "a b"
    assert value(collapse_space("x"), x=f"a{spaces}b  c d\n\ne f") == "a b c d e f"
    # zero-width space and next-line are not JavaScript whitespace
    assert value(collapse_space("x"), x="a​ b\u0085") == "a​ b\u0085"


def test_tags(value):
    assert value(text.split_tags(F.lit("t1, t2 ,,t3"))) == ["t1", " t2 ", "t3"]
    assert value(text.split_tags(F.lit("テスト,日本語"))) == ["テスト", "日本語"]
    assert value(text.split_tags(F.lit(""))) is None
    assert value(text.split_tags(F.lit(" ,　"))) is None
    assert value(text.split_tags(F.lit(None).cast("string"))) is None


def test_illegal_xml(value):
    for bad in ("a\x01", "￾", "￿", "\x0b"):
        assert value(text.has_illegal_xml(F.lit(bad)))
    assert not value(text.has_illegal_xml(F.lit("tab\t nl\n del\x7f 日本 😀")))


def test_file_urls(value):
    def kind(url):
        return value(urls.file_class("url"), url=url)

    assert kind("https://e.com/a/X.PDF?x=1#y") == "pdf"
    assert kind("https://example.com/x.pdf?p=<value>") == "pdf"
    assert kind("https://e.com/a.dmg") == "archive"
    assert kind("https://e.com/setup.exe") == "binary"
    assert kind("https://e.com/pdf") is None
    assert kind("https://e.com/a.pdf/") is None
    assert kind("not-a-valid-url.pdf") is None
    assert value(urls.is_binary_url("url"), url="not-a-valid-url") is False
    assert sum(map(len, fixed.FILE_CLASSES.values())) == 74
    stub = value(urls.file_stub("url"), url="https://e.com/Dir/My&File.EXE")
    assert stub == '<div>\n<p>Binary file (EXE): <a href="https://e.com/Dir/My&amp;File.EXE">my&file.exe</a></p>\n</div>'


def test_content_type(value):
    assert value(urls.is_text_type(F.lit("text/html; charset=x")))
    assert value(urls.is_text_type(F.lit("text/plain")))
    assert not value(urls.is_text_type(F.lit("application/pdf")))
    assert not value(urls.is_text_type(F.lit(None).cast("string")))
    stub = value(urls.content_type_stub(F.lit("https://e.com/A/B.Bin"), F.lit("application/x ; q=1")))
    assert stub == (
        '<div>\n<p>File: <a href="https://e.com/A/B.Bin">B.Bin</a></p>\n'
        "<p><small>Content-Type: application/x</small></p>\n</div>"
    )


@pytest.mark.parametrize(
    "given, expected",
    [
        (b"<meta charset=EUC-JP>", "euc-jp"),
        (b"<meta charset=euc-jp>", "euc-jp"),
        (b"<meta charset=Shift_JIS>", "shift_jis"),
        (b"<meta charset=shift_jis>", "shift_jis"),
        (b'<meta charset="euc-jp">', "utf8"),
        (b"x" * 1020 + b"charset=euc-jp", "utf8"),
        (b"", "utf8"),
    ],
)
def test_charset(value, given, expected):
    assert value(charset.detect_charset(F.lit(given))) == expected


def test_decode(value):
    assert value(charset.decode_body(F.lit(b"charset=EUC-JP \xc6\xfc\xcb\xdc"))) == "charset=EUC-JP 日本"
    assert value(charset.decode_body(F.lit("charset=shift_jis 日本".encode("shift_jis")))).endswith("日本")
    assert value(charset.decode_body(F.lit(b"ab\xff"))) == "ab�"


def test_entities(value):
    import html

    given = (
        "a &amp; b &ampc; &copy &#x65E5;&#26412;&#128; &#0; &nope; & &notit; &eacute;&hearts;&apos; &AMP &lt;&LT; "
        "&#99999999999999999999; &#x110000; &#xD800; &quot"
    )
    assert value(decode_entities("x"), x=given) == html.unescape(given)


def test_tokens(value):
    given = (
        '<!DOCTYPE html><title>a<b</title><p class="x>y">t<!-- <i> --><script>var t="</p>";</script>'
        "<br/>a < b<a href='q>'>z</a></ x><!-- open <p>"
    )
    assert value(tokens(F.lit(given))) == [
        "<!DOCTYPE html>", "<title>a<b</title>", '<p class="x>y">', "t", "<!-- <i> -->",
        '<script>var t="</p>";</script>', "<br/>", "a ", "<", " b", "<a href='q>'>", "z", "</a>", "</ x>",
        "<!-- open <p>",
    ]
    # long attributes must not exhaust the stack
    assert len(value(tokens(F.lit('<a href="' + "x" * 200_000 + '"><p ' + "a=b " * 50_000 + ">t")))) == 3


def packed(content):
    """The packing rule as a plain loop."""
    spaces = " \t\n\x0b\f\r      　﻿" + "".join(map(chr, range(0x2000, 0x200B)))
    words = "".join(" " if c in spaces else c for c in content)
    while "  " in words:
        words = words.replace("  ", " ")
    done, current = [], ""
    for line in words.split("。"):
        line = line.strip(" ")
        if len(line.encode("utf-16-le")) // 2 > 20:
            current += line + "。"
            if len(current.encode("utf-16-le")) // 2 > 150 or "：" in line or "■" in line:
                done.append(current)
                current = ""
    return done + ([current] if current else [])


def test_paragraphs_match_a_plain_loop(spark):
    rng = random.Random(7)
    alphabet = ["あ", "b", " ", "　", "\n", "。", "：", "■", "😀", "&", "0"]
    weights = [30, 30, 8, 1, 2, 3, 0.3, 0.3, 2, 1, 3]
    texts = ["".join(rng.choices(alphabet, weights, k=rng.randrange(0, 1500))) for _ in range(200)] + ["", "。", "x" * 21]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in rows.selectExpr("i", f"{pack_paragraphs(text_lines('t'))} AS p").collect()}
    assert got == {i: packed(t) for i, t in enumerate(texts)}


def test_paragraph_markup(value):
    assert value(paragraphs_to_markup("array('a < b & c', 'd')")) == "<p>a &lt; b &amp; c</p>\n<p>d</p>\n"
    assert value(paragraphs_to_markup("cast(array() AS array<string>)")) == ""


def test_labels(value):
    def label(content, method):
        return value(notes.add_method_label(F.lit(content).cast("string"), F.lit(method)))

    assert label("<p>Test content</p>", "lightweight") == "<p>Test content</p>\n<p><small>[Scraped via HTTP]</small></p>"
    assert label("<p>Test content</p>", "browser").endswith("[Scraped via Browser]</small></p>")
    failed = "<p>Failed to scrape content from https://example.com</p>"
    assert label(failed, "lightweight") == failed + "\n<p><small>[Scraping Failed]</small></p>"
    assert label("<p>Failed to scrape\nx</p>", "failed") == "<p>Failed to scrape\nx</p>"
    assert label("", "browser") == ""
    assert label(None, "browser") is None
