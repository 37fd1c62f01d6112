"""Expressions that turn a bookmark (and page content) into note fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.functions import fixed
from noteweave.functions.text import escape_html, fill, present, strip_control


def note_title(title: Column, url: Column) -> Column:
    """Escaped title; the URL stands in for a missing or empty one."""
    return escape_html(F.coalesce(F.nullif(title, F.lit("")), url, F.lit("")))


def note_content(title: Column, url: Column, status: Column, content: Column, day: Column) -> Column:
    """Note document; ``title``, ``url`` and ``status`` are escaped already."""
    article = fill(
        fixed.ARTICLE_BODY, title=title, url=url, status=status, content=strip_control(content), day=day
    )
    link = fill(fixed.LINK_BODY, title=title, url=url, status=status)
    body = F.when(present(content), article).otherwise(link)
    return fill(fixed.NOTE_DOCUMENT, body=body)


def has_failure_mark(content: Column) -> Column:
    first, second = fixed.FAILURE_MARKS
    return F.contains(content, F.lit(first)) | F.contains(content, F.lit(second))


def label_line(method: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in fixed.METHOD_LABELS.items():
        label = F.when(method == name, F.lit(text)).otherwise(label)
    return fill(fixed.LABEL_LINE, label=label)


def add_method_label(content: Column, method: Column) -> Column:
    """Append how the content was obtained.

    A failure text gets the failure label after its first one-line paragraph;
    null and empty content stay as they are.
    """
    failed = F.regexp_replace(
        content,
        r"^([\s\S]*?)(<p>[^\n\r\x{2028}\x{2029}]*?</p>)",
        "$1$2" + fixed.LABEL_LINE.format(label=fixed.METHOD_LABELS["failed"]),
    )
    return (
        F.when(~present(content), content)
        .when(has_failure_mark(content), failed)
        .otherwise(F.concat(content, label_line(method)))
    )
