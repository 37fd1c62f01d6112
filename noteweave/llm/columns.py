"""Column names that cannot clash with those of an input table."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it until no taken name is equal to it (names differ by more than their case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name
