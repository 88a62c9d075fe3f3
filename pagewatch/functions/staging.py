"""Evaluate an expression once.

The optimizer merges projections and copies expressions into filters. For a
costly expression that is read many times this multiplies the work, so such
values are bound here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but later filters and projections read the values instead of copying them.

    A one-element generator produces the columns; predicates are not pushed through it.
    """
    kept = [c for c in df.columns if c not in columns]
    struct = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(struct)))
