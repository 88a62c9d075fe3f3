"""Text columns: whitespace, truncation, word tests, row flattening."""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from pagewatch import fixed_values as fv


def normalize_space(text: Column) -> Column:
    """Squeeze every Unicode whitespace run (NBSP, U+3000 included) to one blank."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), fv.UNTIDY_WHITESPACE, " "))


def truncate(text: Column, limit: int = 500) -> Column:
    """Squeezed text, cut to ``limit`` characters of which the last is an ellipsis."""
    squeezed = normalize_space(text)
    return F.when(
        F.length(squeezed) > limit, F.concat(F.left(squeezed, F.lit(limit - 1)), F.lit("…"))
    ).otherwise(squeezed)


def message_preview(text: Column) -> Column:
    return F.left(normalize_space(text), F.lit(fv.PREVIEW_CHARS))


def any_word(text: Column, words: Sequence[str]) -> Column:
    """True when ``text`` holds at least one of ``words`` (plain substrings, case kept)."""
    if not words:
        return F.lit(False)
    return text.rlike("|".join(re.escape(word) for word in words))


#: Lists up to this length become one generated test per word; longer ones are walked as one literal
#: array, so that the plan stays small. The values are the same.
FLAT_WORDS = 128


def literal(values: Sequence, kind: str) -> Column:
    """A literal array of any length: one constant, however many elements it has."""
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), f"array<{kind}>")


def word_flags(text: Column, words: Sequence[str]) -> Column:
    """Per word: is it a substring of ``text``?"""
    if not words:
        return F.array().cast("array<boolean>")
    if len(words) <= FLAT_WORDS:
        return F.array(*[F.contains(text, F.lit(w)) for w in words])
    return F.transform(literal(words, "string"), lambda w: F.contains(text, w))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Like ``any_word`` for a plain column, without a regex."""
    if not words:
        return F.lit(False)
    if len(words) <= FLAT_WORDS:
        return any_of([F.contains(text, F.lit(w)) for w in words])
    return F.exists(literal(words, "string"), lambda w: F.contains(text, w))


def words_in(text: Column, words: Sequence[str]) -> Column:
    """The words found in ``text``, in list order."""
    if not words:
        return F.array().cast("array<string>")
    if len(words) <= FLAT_WORDS:
        return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))
    return F.filter(literal(words, "string"), lambda w: F.contains(text, w))


def count_words(text: Column, words: Sequence[str]) -> Column:
    if len(words) <= FLAT_WORDS:
        return total_of([F.contains(text, F.lit(w)).cast("int") for w in words])
    return F.size(words_in(text, words))


def _halves(terms: Sequence[Column], join: Callable[[Column, Column], Column]) -> Column:
    """Terms joined as a balanced tree: the nesting grows with the logarithm of their number."""
    if len(terms) == 1:
        return terms[0]
    middle = len(terms) // 2
    return join(_halves(terms[:middle], join), _halves(terms[middle:], join))


def total_of(terms: Sequence[Column]) -> Column:
    return _halves(terms, operator.add) if terms else F.lit(0)


def any_of(conditions: Sequence[Column]) -> Column:
    return _halves(conditions, operator.or_) if conditions else F.lit(False)


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def strip(value: Column) -> Column:
    """Without Unicode whitespace at either end."""
    return F.regexp_replace(value, f"^{fv.WHITESPACE}|{fv.WHITESPACE}$", "")


def list_values(text: Column) -> Column:
    """Elements of a ``;``-separated cell, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(text, ";"), lambda v: strip(v)), lambda v: v != "")


def join_list(values: Column) -> Column:
    return F.concat_ws("; ", values)


def join_map(entries: Column) -> Column:
    return F.array_join(
        F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | "
    )


def csv_safe(value: Column) -> Column:
    """Quote cells a spreadsheet would run as a formula."""
    risky = F.regexp_replace(value, "^" + fv.WHITESPACE, "").rlike(r"^[=+\-@]")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def non_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))
