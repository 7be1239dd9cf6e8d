"""HTML expressions (F4-F7) on native regex functions; no per-row Python.

Paragraphs follow the HTML standard reading: a new ``<p>`` closes an open
one, so text inside unbalanced markup is emitted once. Comments, scripts and
styles are cut before anything is read from a page. Character references are
decoded once, as the HTML standard names them.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard's named references, from Python's own table: the name as
# written after "&" (";" included where it is required) -> the text.
NAMED = dict(sorted(html5.items()))
# Numeric references in this range mean Windows-1252 characters (HTML standard).
WINDOWS_1252 = {str(n): bytes([n]).decode("cp1252") for n in range(0x80, 0xA0)
                if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

REFERENCE_RE = r"(&(?:#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);?|&|[^&]+)"
ANCHOR_RE = r"""(?i)<a([\s/](?:[^"'>]+|"[^"]*"|'[^']*')*)>"""
BASE_RE = r"""(?i)<base([\s/](?:[^"'>]+|"[^"]*"|'[^']*')*)>"""
ATTRIBUTE_RE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
HREF_NAME_RE = r"(?i)^href(\s*=\s*|$)"
TITLE_RE = r"(?is)<title(?:[ \t\n\r\f][^>]*)?>(.*?)</title[ \t\n\r\f]*>"
COMMENT_RE = r"(?s)<!--.*?-->"
SCRIPT_RE = r"(?is)<script(?:[ \t\n\r\f][^>]*)?>.*?</script[ \t\n\r\f]*>"
STYLE_RE = r"(?is)<style(?:[ \t\n\r\f][^>]*)?>.*?</style[ \t\n\r\f]*>"
P_OPEN_RE = r"(?i)<p(?:[ \t\n\r\f][^>]*)?>"
P_END_RE = r"(?is)</(?:p|article|div|section|body|main|td|li)[ \t\n\r\f]*>.*$"
TAG_RE = r"<[^>]*>"
# keep letters, digits, '_' and white space (Python's Unicode \w\s),
# written so that Java and RE2 agree.
NON_WORD_RE = r"[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _table(entries: dict[str, str]) -> Column:
    """A fixed map; folded to one literal when the query is planned."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _numeric(p: Column) -> Column:
    """Text of a numeric reference ("&#39;", "&#x27;"); U+FFFD where there is
    no such character; NULL for anything else."""
    digits = F.regexp_extract(p, r"^&#[xX]?0*([0-9A-Fa-f]*);?$", 1)
    hexadecimal = p.rlike(r"^&#[xX]")
    n = F.when(F.length(digits) > 7, F.lit(-1)).when(digits == "", F.lit(0)).otherwise(
        F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int"))
    known = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(p.startswith("&#"), F.coalesce(F.try_element_at(_table(WINDOWS_1252), n.cast("string")), F.when(known, char), F.lit("\ufffd")))


def unescape(c, attribute: bool = False) -> Column:
    """Character references decoded, each once. In an attribute a name needs
    its ";", so that query strings like "?a=1&copy=2" stay as they are."""
    c = _c(c)

    def text_of(p: Column) -> Column:
        name = F.substring(p, 2, 64)
        named = F.try_element_at(_table(NAMED), name)
        named = F.when(p.endswith(";"), named) if attribute else named
        return F.when(p.startswith("&"), F.coalesce(_numeric(p), named, p)).otherwise(p)

    decoded = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(REFERENCE_RE), 1), text_of), "")
    return F.when(c.contains("&"), decoded).otherwise(c)


def hrefs(html) -> Column:
    """Values of the href attributes of all anchors, in document order,
    references decoded; anchors without one are left out."""
    return _hrefs_of(html, ANCHOR_RE)


def base_href(html) -> Column:
    """Value of the href attribute of the first base element that has one,
    references decoded; NULL without one."""
    return F.try_element_at(_hrefs_of(html, BASE_RE), F.lit(1))


def _hrefs_of(html, element_re: str) -> Column:
    def href(attributes: Column) -> Column:
        each = F.regexp_extract_all(attributes, F.lit(ATTRIBUTE_RE), 0)
        first = F.try_element_at(F.filter(each, lambda a: a.rlike(HREF_NAME_RE)), F.lit(1))
        value = F.regexp_replace(first, HREF_NAME_RE, "")
        quoted = value.rlike("""^["']""")
        return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    elements = F.regexp_extract_all(strip_blocks(html), F.lit(element_re), 1)
    found = F.filter(F.transform(elements, href), lambda h: h.isNotNull())
    return F.transform(found, lambda h: unescape(h, attribute=True))


def has_title(html) -> Column:
    return F.coalesce(strip_blocks(html).rlike(TITLE_RE), F.lit(False))


def title(html) -> Column:
    """text of the first <title>, references decoded; NULL if no title."""
    t = unescape(F.regexp_extract(strip_blocks(html), TITLE_RE, 1))
    return F.when(has_title(html), t)


def strip_blocks(html) -> Column:
    h = F.regexp_replace(_c(html), COMMENT_RE, "")
    h = F.regexp_replace(h, SCRIPT_RE, "")
    return F.regexp_replace(h, STYLE_RE, "")


def paragraphs(html) -> Column:
    """array of paragraph texts (tags stripped, references decoded)."""
    pieces = F.split(strip_blocks(html), P_OPEN_RE)
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))
    return F.transform(pieces, lambda p: unescape(
        F.regexp_replace(F.regexp_replace(p, P_END_RE, ""), TAG_RE, "")))


def paragraph_text(html, sep: str = "") -> Column:
    """paragraphs joined with ``sep`` (the reference joins with none)."""
    return F.array_join(paragraphs(html), sep)


def clean_text(c) -> Column:
    """remove everything but word characters and white space."""
    return F.regexp_replace(_c(c), NON_WORD_RE, "")
