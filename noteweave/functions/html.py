"""HTML token expressions: splitting, tag fields, entity decoding."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.functions.sqltext import literal

# --- tokens -------------------------------------------------------------------
# A comment, a whole script/style/title element, a tag, a bogus comment, a run of
# text, or a stray '<'.  What is left open, a quote included, ends with the page, so no
# character is scanned for an end twice.  Possessive quantifiers keep matching
# linear and off the Java call stack.
_RAW = r"<{0}(?:[\s/][^>]*)?>[\s\S]*?(?:</{0}[\s/]*>|\z)"
TOKEN = (
    r"(?i)<!--(?:-?>|[\s\S]*?(?:--!?>|\z))"
    + "".join("|" + _RAW.format(name) for name in ("script", "style", "title"))
    + r"""|</?[a-z](?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+(?:>|\z)"""
    + r"|<[!?/][^>]*+(?:>|\z)|[^<]+|<"
)
RAW_START = r"(?i)^<(?:script|style|title)[\s/>]"
TAG_START = r"^</?[a-zA-Z]"
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def is_text(token: Column) -> Column:
    return ~F.startswith(token, F.lit("<")) | (token == "<")


def is_tag(token: Column) -> Column:
    """A single start or end tag (not a comment, not a script/style/title)."""
    return F.regexp_like(token, F.lit(TAG_START)) & ~F.regexp_like(token, F.lit(RAW_START))


def token_kind(token: Column) -> Column:
    return (
        F.when(is_text(token), F.lit("text"))
        .when(F.regexp_like(token, F.lit(RAW_START)), F.lit("raw"))
        .when(F.startswith(token, F.lit("</")) & is_tag(token), F.lit("close"))
        .when(is_tag(token), F.lit("open"))
        .otherwise(F.lit("comment"))
    )


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, TAG_NAME, 1))


def attribute(token: Column, name: str) -> Column:
    """Value of an attribute of a start tag, ``''`` when absent.

    The attributes before it are walked in order, so a value that looks like one is not taken for it.
    """
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    before = rf"""(?:[\s/]*+(?!{name}\s*=)[^\s"'<>/=]++(?:\s*+=\s*+{value})?+)*+"""
    wanted = rf"""[\s/]*+{name}\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    pattern = rf"(?i)^<[a-z][^\s/>]*+(?=[\s/]){before}{wanted}"
    return F.concat(*[F.coalesce(F.regexp_extract(token, pattern, group), F.lit("")) for group in (1, 2, 3)])


def class_names(token: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(attribute(token, "class"), r"\s+", " ")), " ")


# --- entities --------------------------------------------------------------------
#: Names of the HTML standard by their first letter, since a map is searched from its start; those without a semicolon are also read
#: as the beginning of a longer word.
_NAMES = json.dumps({letter: {n: c for n, c in html5.items() if n[0] == letter} for letter in sorted({n[0] for n in html5})}, ensure_ascii=False)
_OPEN_NAMES = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True))
_NUMERIC = r"#[0-9]+;?|#[xX][0-9a-fA-F]+;?"
_ENTITY_OR_TEXT = rf"&(?:{_NUMERIC}|[a-zA-Z][a-zA-Z0-9]*+;?)|[^&]+|&"
_INVALID = "\ufffd"


def _char(code: str) -> str:
    """Character of a numeric reference under the HTML rules."""
    return f"""CASE
        WHEN {code} IS NULL OR {code} = 0 OR {code} > {0x10FFFF} OR {code} BETWEEN {0xD800} AND {0xDFFF}
            THEN {literal(_INVALID)}
        WHEN {code} BETWEEN {0x80} AND {0x9F} THEN decode(unhex(hex({code})), 'windows-1252')
        ELSE decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') END"""


def decode_entities(x: str) -> str:
    """Replace named and numeric character references."""
    decimal = f"regexp_extract(piece, {literal('^&#([0-9]+)')}, 1)"
    significant = f"concat('0', ltrim('0', regexp_extract(piece, {literal('^&#[xX]([0-9a-fA-F]+)')}, 1)))"
    hexadecimal = f"if(length({significant}) <= 9, cast(conv({significant}, 16, 10) AS bigint), NULL)"
    names = f"from_json({literal(_NAMES)}, 'map<string,map<string,string>>')"

    def named(x: str) -> str:
        return f"try_element_at(try_element_at({names}, substring({x}, 1, 1)), {x})"

    start = f"regexp_extract(piece, {literal(f'^&({_OPEN_NAMES})')}, 1)"
    opened = f"concat(coalesce({named(start)}, '&'), substring(piece, 2 + length({start})))"
    pieces = f"regexp_extract_all({x}, {literal(_ENTITY_OR_TEXT)}, 0)"
    return f"""CASE WHEN contains({x}, '&') THEN array_join(transform({pieces}, piece -> CASE
        WHEN NOT startswith(piece, '&') OR piece = '&' THEN piece
        WHEN regexp_like(piece, '^&#[0-9]') THEN {_char(f"try_cast({decimal} AS bigint)")}
        WHEN startswith(piece, '&#') THEN {_char(hexadecimal)}
        ELSE coalesce({named("substring(piece, 2)")}, {opened}) END), '') ELSE {x} END"""


# Tags a browser puts on their own line when it renders text.
LINE_TAGS = [
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav",
    "ol", "option", "p", "pre", "section", "table", "td", "th", "tr", "ul",
]
_LINE_TAG = rf"(?i)^</?(?:{'|'.join(LINE_TAGS)})[\s/>]"


def token_texts(tokens: str, rendered: bool = False) -> str:
    """Array aligned with an array of tokens: decoded text, an empty string for the rest.

    For rendered pages a line tag gives a newline, as visible text would.
    """
    other = f"if(regexp_like(t, {literal(_LINE_TAG)}), '\\n', '')" if rendered else "''"
    return f"transform({tokens}, t -> if(NOT startswith(t, '<') OR t = '<', {decode_entities('t')}, {other}))"
