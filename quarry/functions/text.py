"""Column functions on text: trimming, format detection, HTML to text, counts, hashes, escaping.

Patterns name their white space by class ([\\t\\n\\f\\r ]), since Java's \\s also
holds the vertical tab, and set (?d) wherever a line end matters, so that only \\n is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as trimmed from both ends of a text.
SPACE = r"[\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

WS = r"[\t\n\f\r ]"

# The eight signs of Markdown; a text with two of them is Markdown.
MARKDOWN_SIGNS = (
    rf"(?md)^#{{1,6}}{WS}",
    r"(?md)^```",
    rf"(?md)^\*{WS}",
    rf"(?md)^-{WS}",
    rf"(?md)^[0-9]+\.{WS}",
    r"(?d)\[.*\]\(.*\)",
    r"(?d)\*\*.*\*\*",
    r"(?d)__.*__",
)

# Openings of an HTML document (matched as they are written).
HTML_OPENINGS = ("<!DOCTYPE", "<html", "<HTML")

# Tags that end a line, and named entities; the ampersand is decoded last.
BLOCK_TAGS = "div p br h1 h2 h3 h4 h5 h6 li tr td th blockquote pre hr section article".split()
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """c without Unicode white space at its ends."""
    return F.regexp_replace(column(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def markdown_votes(c: Column | str) -> Column:
    """How many of the eight signs of Markdown the trimmed text has."""
    t = trimmed(c)
    return reduce(lambda a, b: a + b, [t.rlike(p).cast("int") for p in MARKDOWN_SIGNS])


def detect_format(c: Column | str) -> Column:
    """html, markdown or text."""
    t = trimmed(c)
    is_html = reduce(lambda a, b: a | b, [t.startswith(x) for x in HTML_OPENINGS])
    return F.when(is_html, "html").when(markdown_votes(c) >= 2, "markdown").otherwise("text")


def html_title(c: Column | str) -> Column:
    """The trimmed title element, '' if there is none."""
    return trimmed(F.regexp_extract(column(c), r"(?id)<title[^>]*>(.*?)</title>", 1))


def html_text(c: Column | str) -> Column:
    """An HTML page as text: no scripts and styles, block tags as line ends, entities decoded, white space folded."""
    t = column(c)
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    # a name is a prefix here, so <p also ends <pre> or <param>
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return trimmed(F.regexp_replace(t, rf"{WS}{{3,}}", " "))


def char_count(c: Column | str) -> Column:
    return F.char_length(column(c))


def word_count(c: Column | str) -> Column:
    """CJK characters, and ASCII words that a blank or the end closes (a CJK character right after swallows one)."""
    t = column(c)
    cjk = F.char_length(F.regexp_replace(t, "[^一-鿿]", ""))
    latin = F.size(F.filter(F.split(t, "[ \n\t\r]+"), lambda x: x.rlike(r"[A-Za-z0-9][^一-鿿]*\z")))
    return cjk + latin


def token_estimate(c: Column | str) -> Column:
    """Two tokens for three CJK characters, one for four letters, and one."""
    t = column(c)
    cjk = F.char_length(F.regexp_replace(t, "[^一-鿿]", ""))
    latin = F.char_length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return (F.floor(cjk / 1.5) + F.floor(latin / 4.0) + 1).cast("int")


def content_hash(c: Column | str) -> Column:
    """Hex SHA-256 of the trimmed text."""
    return F.sha2(trimmed(c), 256)


# The thirty characters that a tag filter escapes, and those that a query escapes, in its order.
TAG_SPECIALS = r""",.<>{}[]"':;!@#$%^&*()-+=~|/\ """
QUERY_SPECIALS = ("@", "!", "{", "}", "(", ")", "[", "]", "\\", ":", ";", "~", "&", "*", "$", "^", "-", "+", "=", ">", "<", "|")


def escape_tag(c: Column | str) -> Column:
    """A backslash before every special character, in one pass."""
    inside = "".join("\\" + x for x in TAG_SPECIALS)
    return F.regexp_replace(column(c), f"([{inside}])", r"\\$1")


def escape_query(c: Column | str) -> Column:
    """A backslash before every special character, one character after the other: those before the backslash get two."""
    return reduce(lambda t, x: F.replace(t, F.lit(x), F.lit("\\" + x)), QUERY_SPECIALS, column(c))


def size_ok(c: Column | str, most: int = 10 << 20) -> Column:
    """Whether a text is within the content limit, in bytes."""
    return F.octet_length(column(c)) <= most


def index_name(user: Column | str, template: str = "rag_user_%d:idx") -> Column:
    return F.format_string(template, column(user))


def keywords(c: Column | str) -> Column:
    """Lower-cased search terms: runs of letters and digits, each CJK character by itself."""
    return F.regexp_extract_all(F.lower(column(c)), F.lit(r"[一-鿿]|[\p{L}\p{N}&&[^一-鿿]]+"), F.lit(0))
