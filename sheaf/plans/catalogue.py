"""All queries of the core and their SQL."""

from __future__ import annotations

from . import book, problems, streams, tables, units  # noqa: F401

FLAGSHIP = "attr_ranges"


def queries() -> dict[str, book.Query]:
    return dict(book.QUERIES) | problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(book.SQL) | problems.SQL
