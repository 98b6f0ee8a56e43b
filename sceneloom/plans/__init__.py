"""Queries over a document that is built from the plain tables, and their SQL."""

from . import deck, describing, detail, drawing, files, listings, making  # noqa: F401  they register their queries
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
