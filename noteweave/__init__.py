"""noteweave: bookmarks and page snapshots to structured notes, as Spark jobs."""

from noteweave.session import build_session, configure

__all__ = ["build_session", "configure"]
