"""Row predicates and rule-based grades."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions.dates import is_recent, is_stale
from pagewatch.functions.text import any_word, contains_any, words_in


def grade_rank(grade: Column) -> Column:
    rank = F.lit(9)
    for position, name in enumerate(fv.GRADE_ORDER):
        rank = F.when(grade == name, position).otherwise(rank)
    return rank


def status_rank(status: Column) -> Column:
    rank = F.lit(9)
    for position, name in enumerate(fv.REPORT_STATUS_ORDER):
        rank = F.when(status == name, position).otherwise(rank)
    return rank


def at_least(grade: Column, minimum: str) -> Column:
    return grade_rank(grade) <= fv.GRADE_ORDER.index(minimum)


def is_changed(change_type: Column, is_new: Column) -> Column:
    """A recorded change type decides; without one the newness flag does."""
    kind = F.coalesce(change_type, F.lit(""))
    return F.when(kind != "", kind.isin(*fv.CHANGE_TYPES)).otherwise(F.coalesce(is_new, F.lit(False)))


def is_alert_target(
    change_type: Column, is_new: Column, grade: Column, status: Column, notice_date: Column,
    as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS,
) -> Column:
    return (
        is_changed(change_type, is_new)
        & grade.isin("A", "B")
        & (status != fv.STATUS_CLOSED)
        & is_recent(notice_date, as_of, max_age)
    )


def is_graduate_target(
    is_new: Column, grade: Column, notice_date: Column, as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS
) -> Column:
    return is_new & grade.isin("A", "B") & is_recent(notice_date, as_of, max_age)


def is_portal_row(board_type: Column) -> Column:
    return F.contains(board_type, F.lit(fv.PORTAL_MARK))


def marks_seen(
    is_new: Column, url: Column, grade: Column, notice_date: Column,
    as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS,
) -> Column:
    """New rows that will never alert (grade C or too old) and so count as seen."""
    return is_new & (url != "") & ((grade == "C") | is_stale(notice_date, as_of, max_age))


def is_weak_c(grade: Column, title: Column, title_words: Sequence[str] = fv.WEAK_TITLE_WORDS) -> Column:
    return (grade == "C") & ~any_word(F.lower(title), title_words)


def parses_attachments(
    title: Column, preliminary_grade: Column, title_words: Sequence[str] = fv.ATTACHMENT_TITLE_WORDS
) -> Column:
    return preliminary_grade.isin("A", "B", "C") | any_word(F.lower(title), title_words)


def reads_images(grade: Column, image_urls: Column) -> Column:
    return grade.isin("A", "B") & (F.size(image_urls) > 0)


def portal_grade(
    name: Column,
    negative_words: Sequence[str] = fv.PORTAL_NEGATIVE_WORDS,
    general: str = fv.PORTAL_GENERAL,
    school: str = fv.PORTAL_SCHOOL,
) -> Column:
    return (
        F.when(any_word(F.lower(name), [w.lower() for w in negative_words]), "D")
        .when(F.contains(name, F.lit(general)), "A")
        .when(F.contains(name, F.lit(school)), "B")
        .otherwise("D")
    )


@dataclass(frozen=True)
class GraduateWords:
    """Word lists of the graduate rules, compared without case; defaults are the fixed Korean lists."""

    years: tuple[str, ...] = fv.YEAR_WORDS
    schools: tuple[str, ...] = fv.SCHOOL_WORDS
    general: str = fv.PORTAL_GENERAL
    admissions: tuple[str, ...] = fv.ADMISSION_WORDS
    title_admissions: tuple[str, ...] = fv.ADMISSION_WORDS + fv.TITLE_ADMISSION_EXTRA
    negatives: tuple[str, ...] = fv.GRADUATE_NEGATIVE_WORDS
    excluded_titles: tuple[str, ...] = fv.EXCLUDED_TITLE_WORDS
    terms: tuple[str, ...] = fv.TERM_WORDS

    def __post_init__(self) -> None:
        for name, value in list(vars(self).items()):
            low = value.lower() if isinstance(value, str) else tuple(word.lower() for word in value)
            object.__setattr__(self, name, low)


def graduate_rule(
    low_title: Column, low_text: Column, strict_title: Column, words: GraduateWords = GraduateWords()
) -> Column:
    """Name of the rule that decides a graduate notice (a key of ``GRADUATE_REASONS``).

    Title and text (which includes the title) come squeezed and lower-cased.
    """
    title_year = contains_any(low_title, words.years)
    year = title_year | contains_any(low_text, words.years)
    admission = contains_any(low_text, words.admissions)
    general = F.contains(low_text, F.lit(words.general))
    return (
        F.when(contains_any(low_title, words.excluded_titles), "excluded")
        .when(strict_title & ~(title_year & contains_any(low_title, words.title_admissions)), "title")
        .when(contains_any(low_text, words.negatives) & ~general, "negative")
        .when(year & general & admission, "general")
        .when(year & contains_any(low_text, words.schools) & admission, "school")
        .otherwise("none")
    )


def graduate_grade(rule: Column) -> Column:
    return F.when(rule == "general", "A").when(rule == "school", "B").otherwise("D")


def graduate_reason(rule: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, message in fv.GRADUATE_REASONS.items():
        text = F.when(rule == name, message).otherwise(text)
    return text


def graduate_matches(
    low_title: Column, low_text: Column, rule: Column, words: GraduateWords = GraduateWords()
) -> Column:
    """Matched words list by list; a word in two lists appears twice. Empty when excluded by title."""
    found = F.concat(
        words_in(low_title, words.years),
        words_in(low_text, words.schools),
        words_in(low_text, words.admissions),
        words_in(low_text, words.negatives),
        words_in(low_title, words.terms),
    )
    return F.when(rule == "excluded", F.array().cast("array<string>")).otherwise(found)
