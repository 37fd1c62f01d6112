"""String and time expressions (Column in, Column out, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.functions.sqltext import SPACE, SPACES

# Largest absolute epoch second a JavaScript date can hold.
MAX_EPOCH = 8_640_000_000_000
# Characters XML 1.0 does not allow (a string cannot hold lone surrogates).
XML_ILLEGAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"


def fill(template: str, **columns: Column) -> Column:
    """Put columns into the ``{name}`` places of a literal template."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(columns[name])
    return F.concat(*parts)


def present(text: Column) -> Column:
    """True for a non-null, non-empty string."""
    return F.coalesce(text != "", F.lit(False))


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def strip_control(text: Column) -> Column:
    """Remove the control characters XML forbids, and DEL."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def escape_markup(text: Column) -> Column:
    """Escape ``& < >``."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def escape_html(text: Column) -> Column:
    """Drop control characters, then escape ``& < > " '``."""
    text = escape_markup(strip_control(text))
    for raw, entity in (('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def leading_int(text: Column) -> Column:
    """Leading integer of a string, null when there is none or it is too long."""
    return F.regexp_extract(text, rf"^{SPACE}*([+-]?[0-9]+)", 1).try_cast("bigint")


def compact_time(epoch_seconds: Column) -> Column:
    """Epoch seconds to ``yyyyMMddTHHmmssZ``; the session time zone is UTC."""
    in_range = epoch_seconds.between(-MAX_EPOCH, MAX_EPOCH)
    return F.when(in_range, F.date_format(F.timestamp_seconds(epoch_seconds), "yyyyMMdd'T'HHmmss'Z'"))


def enex_time(text: Column) -> Column:
    """Epoch seconds given as text to ``yyyyMMddTHHmmssZ``; null when not numeric."""
    return compact_time(leading_int(text))


def split_tags(tags: Column) -> Column:
    """Comma list to array without blank entries; null when nothing is left."""
    kept = F.filter(F.split(tags, ","), lambda tag: js_trim(tag) != "")
    return F.when(F.size(kept) > 0, kept)


def has_illegal_xml(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(XML_ILLEGAL)), F.lit(False))
