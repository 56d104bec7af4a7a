"""Registered queries over the fixture tables."""

from . import chains, files, forms, registered, speech, streams, timeline, trellises  # noqa: F401  (registers their queries)
from .catalogue import SQL
from .catalogue import Q as QUERIES

__all__ = ["QUERIES", "SQL"]
