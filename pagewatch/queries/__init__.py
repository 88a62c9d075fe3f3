"""Registered queries over the driver tables."""

from __future__ import annotations


def _load() -> None:
    from pagewatch.queries import files, grading, pages, runs, streams, texts  # noqa: F401


def all_queries():
    from pagewatch.queries.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql():
    from pagewatch.queries.registry import SQL

    _load()
    return dict(SQL)
