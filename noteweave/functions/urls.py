"""URL and content-type expressions: file class, file name, stub bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.functions import fixed
from noteweave.functions.sqltext import escape_markup as escape_sql
from noteweave.functions.sqltext import fill as fill_sql
from noteweave.functions.sqltext import literal, literals
from noteweave.functions.text import escape_markup, fill, js_trim

# Lenient: Java's URI parser rejects characters that browsers' parsers accept.
PATH = r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)"
EXTENSION = r"\.([a-z0-9]+)\z"


def url_path(url: Column) -> Column:
    """Path of a URL as written; null when the text is not a URL."""
    return F.when(F.regexp_like(url, F.lit(PATH)), F.regexp_extract(url, PATH, 1))


def file_name(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.nullif(last, F.lit("")), F.lit("file"))


def _extension(url: str) -> str:
    """SQL: lower-case extension at the end of the path, empty when there is none."""
    path = f"lower(regexp_extract({url}, {literal(PATH)}, 1))"
    return f"regexp_extract({path}, {literal(EXTENSION)}, 1)"


def file_class(url: str = "url") -> Column:
    """Class of a URL column that names a file, null for everything else."""
    cases = " ".join(
        f"WHEN {_extension(url)} IN ({literals(extensions)}) THEN {literal(name)}"
        for name, extensions in fixed.FILE_CLASSES.items()
    )
    return F.expr(f"CASE {cases} END")


def is_binary_url(url: str = "url") -> Column:
    extensions = [ext for group in fixed.FILE_CLASSES.values() for ext in group]
    return F.expr(f"coalesce({_extension(url)} IN ({literals(extensions)}), false)")


def file_stub(url: str = "url") -> Column:
    """Body for a URL column that names a file; null for other URLs."""
    path = f"lower(regexp_extract({url}, {literal(PATH)}, 1))"
    places = {
        "url": escape_sql(url),
        "file": f"coalesce(nullif(element_at(split({path}, '/'), -1), ''), 'file')",
        "ext": f"upper({_extension(url)})",
    }
    cases = " ".join(
        f"WHEN {_extension(url)} IN ({literals(extensions)}) THEN {fill_sql(fixed.FILE_STUBS[name], **places)}"
        for name, extensions in fixed.FILE_CLASSES.items()
    )
    return F.expr(f"CASE {cases} END")


def is_text_type(content_type: Column) -> Column:
    hits = [F.contains(F.coalesce(content_type, F.lit("")), F.lit(t)) for t in fixed.TEXT_CONTENT_TYPES]
    return hits[0] | hits[1]


def mime_type(content_type: Column) -> Column:
    return js_trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1))


def content_type_stub(url: Column, content_type: Column) -> Column:
    """Body for a response that is not text; the file name keeps its case."""
    return fill(
        fixed.CONTENT_TYPE_STUB,
        url=escape_markup(url),
        file=file_name(url_path(url)),
        mime=mime_type(content_type),
    )
