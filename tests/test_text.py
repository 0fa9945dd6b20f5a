import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import markdown, pdf


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("  \n<!DOCTYPE html><p>x", "html"),
        ("<!doctype html>", "text"),
        ("<html>", "html"),
        ("# Title\n\n- item\n", "markdown"),
        ("# Title only", "text"),
        ("plain words", "text"),
        ("1. one\n\n[a](b)", "markdown"),
        ("", "text"),
    ],
)
def test_detect_format(spark, text, kind):
    assert one(spark, text, T.detect_format("x")) == kind


def words_by_loop(text):
    n, inside = 0, False
    for c in text:
        if "一" <= c <= "鿿":
            n, inside = n + 1, False
        elif c in " \n\t\r":
            n, inside = n + inside, False
        elif c.isascii() and c.isalnum():
            inside = True
    return n + inside


@pytest.mark.parametrize("text", ["", "abc中", "中d", "a中文b x", "one two\tthree\r\nfour", "... --- x", "中文,字 a1-b2", " lead and trail "])
def test_word_count_is_the_loop(spark, text):
    assert one(spark, text, T.word_count("x")) == words_by_loop(text)


def test_token_estimate(spark):
    assert one(spark, "中文字abcdefgh", T.token_estimate("x")) == 2 + 2 + 1


def test_html(spark):
    page = "<html><head><title> A &amp; b </title><style>p{}</style><script>x<1</script></head><body><pre>one</pre><p>two &amp;lt; three</p>\n\n\n<b>four</b></body>"
    assert one(spark, page, T.html_title("x")) == "A &amp; b"
    text = one(spark, page, T.html_text("x"))
    assert "p{}" not in text and "x<1" not in text
    assert "two &lt; three" in text and "four" in text


def test_trim_is_unicode(spark):
    assert one(spark, "　  a b \x0b", T.trimmed("x")) == "a b"
    assert one(spark, " a ", T.content_hash("x")) == one(spark, "a\n", T.content_hash("x"))


def test_escapes(spark):
    assert one(spark, "a.b c", T.escape_tag("x")) == "a\\.b\\ c"
    assert one(spark, "@a:b", T.escape_query("x")) == "\\\\@a\\:b"


MD = """---
title: "Guide"
author: Jo: Lee
tags: [a, b ,]
lang: en
---
lead is dropped
# One
text
```
# fenced
```
## Two
| h1 | h2 |
|----|:--:|
| a | b |
| c ||
| d | e | f |

![pic](u1) ![](u2)
"""


def test_front_matter_and_title(spark):
    fm = one(spark, MD, markdown.front_matter("x"))
    assert (fm["title"], fm["author"], fm["tags"], fm["language"]) == ('"Guide"', "Jo: Lee", ["a", "b"], "en")
    assert one(spark, "# T \nx", markdown.title("x")) == "T"
    assert one(spark, "## T\n# U", markdown.title("x")) == ""


def test_sections(spark):
    got = [(s["title"], s["level"]) for s in one(spark, MD, markdown.sections("x"))]
    assert got == [("One", 1), ("fenced", 1), ("Two", 2)]
    first = one(spark, MD, markdown.sections("x"))[0]
    body = one(spark, MD, markdown.body("x"))
    assert body[first["start"] : first["end"]].startswith("# One")
    assert one(spark, "no heading", markdown.sections("x")) == []
    assert one(spark, "# A\r\nb", markdown.sections("x"))[0]["title"] == "A\r"


def test_tables(spark):
    docs = spark.createDataFrame([(1, MD), (2, "none"), (3, "| a | b |\n| - | - |")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in markdown.tables(docs).collect()}
    assert set(rows) == {1, 3}
    t = rows[1]
    assert t["headers"] == ["h1", "h2"]
    assert t["rows"] == [["a", "b"], ["c", ""], ["d", "e"]]
    assert t["context"] == "Two"
    assert t["linearized"] == "[表格: Two]\n列: h1 | h2\nh1: a, h2: b\nh1: c, h2:\nh1: d, h2: e".replace("h2:\n", "h2: \n")
    body = one(spark, MD, markdown.body("x"))
    assert body[t["start_pos"] :].startswith("| h1 | h2 |")
    assert rows[3]["rows"] == []
    out = {r["doc_id"]: r["enhanced"] for r in markdown.enhanced(docs).collect()}
    assert "[图片: pic] [图片]" in out[1] and "|----" not in out[1]
    assert out[2] == "none"


def test_pdf_decoding(spark):
    import base64

    raw = base64.b64encode(b"%PDF-1.4 \xff\xfe\xfb").decode()
    for value in (raw, "base64:" + raw, "data:application/pdf;base64," + raw, raw.replace("+", "-").replace("/", "_"), raw.rstrip("=")):
        assert bytes(one(spark, value, pdf.decoded("x"))).startswith(b"%PDF-")
    assert one(spark, base64.b64encode(b"hello").decode(), pdf.decoded("x")) is None
    assert one(spark, "!!", pdf.decoded("x")) is None


def test_pdf_pages(spark):
    rows = [("f", 1, i, c) for i, c in enumerate([["t"], ["a", "b", "c"], ["1", "2"], ["x", "y", "z"], ["1", "2", "3"], ["4", "5", "6", "7"]])]
    frame = spark.createDataFrame(rows, "doc_id string, page int, row int, cells array<string>")
    t = pdf.page_tables(frame).collect()
    assert [(x["headers"], x["rows"]) for x in t] == [(["x", "y", "z"], [["1", "2", "3"], ["4", "5", "6"]])]
    text = pdf.page_text(frame).first()["content"]
    assert text.startswith("[第1页]\nt\na b c")
    assert one(spark, text, pdf.title("x")) == "t"
    assert one(spark, text, pdf.page_sections("x"))[0]["title"] == "第1页"
    files = spark.createDataFrame([("p", bytearray(b"%PDF-x")), ("q", bytearray(b"bad"))], "path string, content binary")

    def pages(raw):
        if not raw.startswith(b"%PDF-"):
            raise ValueError
        return [[["a", "b"]]]

    assert [r["doc_id"] for r in pdf.page_rows(files, pages).collect()] == ["p"]


def test_size_guard(spark):
    assert one(spark, "é" * 5, T.size_ok("x", 10)) is True
    assert one(spark, "é" * 6, T.size_ok("x", 10)) is False
    assert F is not None
