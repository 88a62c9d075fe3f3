"""Course evidence: homepages and notice pages that name courses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions.staging import computed_once
from pagewatch.functions.text import any_word, normalize_space, truncate, words_in
from pagewatch.functions.urls import is_public_http_url


@dataclass(frozen=True)
class CourseWords:
    names: tuple[str, ...]
    searches: tuple[str, ...]
    departments: tuple[str, ...] = fv.DEPARTMENTS


def has_course_signal(text: Column, words: CourseWords) -> Column:
    return any_word(text, words.names + words.searches)


def matched_courses(text: Column, words: CourseWords) -> Column:
    return F.array_distinct(words_in(text, words.names))


def matched_departments(text: Column, words: CourseWords) -> Column:
    return F.array_distinct(words_in(text, words.departments))


def page_evidence(parsed: DataFrame, words: CourseWords) -> DataFrame:
    """What a page itself says: signal, courses, departments and an excerpt. Texts go no further."""
    text = normalize_space(F.col("page_text"))
    rows = parsed.where(F.col("parse_error").isNull() & is_public_http_url(F.col("url")))
    found = (
        computed_once(rows.select("url", "page_text"), {"_text": text})
        .where(has_course_signal(F.col("_text"), words))
        .select(
            "url",
            matched_departments(F.col("_text"), words).alias("departments"),
            matched_courses(F.col("_text"), words).alias("courses"),
            truncate(F.col("_text"), fv.EVIDENCE_CHARS).alias("excerpt"),
        )
    )
    # of several pages of one url the greatest in field order counts
    return found.groupBy("url").agg(F.max(F.struct("departments", "courses", "excerpt")).alias("e")).select("url", "e.*")


def find_evidence(parsed: DataFrame, words: CourseWords) -> DataFrame:
    """One row per page with evidence: ``page_url`` and ``evidence(url, departments, courses, excerpt)``.

    A page whose link labels ask for courses has that label in its own text, so
    it is evidence itself and no link has to be followed.
    """
    own = page_evidence(parsed, words)
    return own.select(F.col("url").alias("page_url"), F.struct(*own.columns).alias("evidence"))


def _searched(items: DataFrame, universities: DataFrame) -> DataFrame:
    """Items with the pages to search for evidence: ``_home`` and ``_self``, null where none is wanted."""
    domains = universities.select(
        F.col("name").alias("university_name"), F.get("domains", F.lit(0)).alias("_domain")
    )
    joined = items.join(domains, "university_name", "left")
    likely = F.col("computer_course_status") == fv.STATUS_LIKELY
    searched = F.col("grade").isin("A", "B", "C") & ~likely & (F.coalesce("_domain", F.lit("")) != "")
    return joined.withColumns(
        {
            "_home": F.when(searched, F.concat(F.lit("https://www."), "_domain")),
            "_self": F.when(searched & (F.col("url") != ""), F.col("url")),
            "_searched": searched,
        }
    )


def wanted_pages(items: DataFrame, universities: DataFrame) -> DataFrame:
    """Urls of the pages ``enrich`` will ask evidence of."""
    rows = _searched(items.select("university_name", "computer_course_status", "grade", "url"), universities)
    return rows.select(F.explode(F.array("_home", "_self")).alias("url")).where(F.col("url").isNotNull()).distinct()


def enrich(items: DataFrame, universities: DataFrame, evidence: DataFrame, words: CourseWords) -> DataFrame:
    """Add departments, courses and evidence to A-C rows.

    Rows already likely to offer courses only have their title searched. For the
    rest the university's homepage comes before the notice page.
    """
    joined = _searched(items, universities)
    searched = F.col("_searched")
    likely = F.col("computer_course_status") == fv.STATUS_LIKELY
    graded = F.col("grade").isin("A", "B", "C")
    home = evidence.select(F.col("page_url").alias("_home"), F.col("evidence").alias("_e0"))
    own = evidence.select(F.col("page_url").alias("_self"), F.col("evidence").alias("_e1"))
    rows = joined.join(home, "_home", "left").join(own, "_self", "left")
    best = F.coalesce("_e0", "_e1")
    none = F.array().cast("array<string>")
    courses = (
        F.when(graded & likely, matched_courses(F.concat(F.lit(" "), "title"), words))
        .when(searched, F.coalesce(best["courses"], none))
        .otherwise(none)
    )
    blank = F.lit("")
    return rows.withColumns(
        {
            "possible_departments": F.when(searched, F.coalesce(best["departments"], none)).otherwise(none),
            "possible_computer_courses": courses,
            "course_evidence_url": F.when(searched, F.coalesce(best["url"], blank)).otherwise(blank),
            "course_evidence_text": F.when(searched, F.coalesce(best["excerpt"], blank)).otherwise(blank),
            "computer_course_status": F.when(
                searched & (F.size(F.coalesce(best["courses"], none)) > 0), fv.STATUS_CHECK
            ).otherwise(F.col("computer_course_status")),
        }
    ).drop("_domain", "_home", "_self", "_searched", "_e0", "_e1")
