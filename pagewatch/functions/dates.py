"""Dates, application periods, recency and the business-day rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions.staging import bind, computed_once
from pagewatch.functions.text import any_word, non_empty, normalize_space

FULLWIDTH_DIGITS = "０１２３４５６７８９"


def fold_digits(text: Column) -> Column:
    return F.translate(text, FULLWIDTH_DIGITS, "0123456789")


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL when the three parts do not name one."""
    return F.concat_ws("-", year, month, day).try_cast("date")


def parse_date(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def iso_or_blank(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit(""))


def first_date(text: Column) -> Column:
    """First date-like triple as ``yyyy-mm-dd`` text; deliberately not validated."""
    digits = fold_digits(F.coalesce(text, F.lit("")))

    def written(pattern: str, century: str) -> Column:
        y, m, d = (F.regexp_extract(digits, pattern, i) for i in (1, 2, 3))
        return F.when(
            y != "", F.concat(F.lit(century), y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
        )

    return F.coalesce(written(fv.LONG_DATE_PATTERN, ""), written(fv.SHORT_DATE_PATTERN, "20"), F.lit(""))


def application_range(text: Column, context_words: Sequence[str] = fv.RANGE_CONTEXT_WORDS) -> Column:
    """First ordered date range in a line or sentence that names an application.

    Returns ``struct<start: date, end: date>`` or NULL.
    """
    pattern = "(?i)" + fv.RANGE_PATTERN
    pieces = F.split(fold_digits(text), r"[\n\r]|(?<=[.!?])" + fv.WHITESPACE)
    segments = F.filter(F.transform(pieces, normalize_space), lambda s: any_word(s, context_words))
    # a hit is taken apart in one pass: its groups, with a mark between that no text part of it has
    mark = "\x1f"
    groups = mark.join(f"${i}" for i in range(1, 7))

    def to_range(hit: Column) -> Column:
        def dates_of(part: Column) -> Column:
            year, month, day, end_year, end_month, end_day = (F.get(part, F.lit(i)) for i in range(6))
            return F.struct(
                date_of(year, month, day).alias("start"),
                date_of(F.coalesce(non_empty(end_year), year), end_month, end_day).alias("end"),
            )

        return bind(F.split(F.regexp_replace(hit, pattern, groups), mark), dates_of)

    found = F.flatten(
        F.transform(
            segments,
            lambda s: F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), to_range),
        )
    )
    ordered = F.filter(found, lambda r: F.coalesce(r["end"] >= r["start"], F.lit(False)))
    # The word test is cheap and most texts fail it, so the split runs only on the rest.
    return F.when(any_word(text, context_words), F.try_element_at(ordered, F.lit(1)))


def deadline_status(start: Column, end: Column, as_of: Column) -> Column:
    left = F.datediff(end, as_of)
    return (
        F.when(start.isNull() & end.isNull(), fv.STATUS_UNKNOWN)
        .when(as_of < start, fv.STATUS_UPCOMING)
        .when(as_of > end, fv.STATUS_CLOSED)
        .when(left <= 3, fv.STATUS_URGENT)
        .when(left <= 7, fv.STATUS_SOON)
        .otherwise(fv.STATUS_OPEN)
    )


def periods_of(title: Column, sources: Column, context_words: Sequence[str] = fv.RANGE_CONTEXT_WORDS) -> Column:
    return F.filter(
        F.transform(
            sources,
            lambda s: F.struct(
                s["name"].alias("name"),
                application_range(F.concat(title, F.lit("\n"), s["text"]), context_words).alias("period"),
            ),
        ),
        lambda p: p["period"].isNotNull(),
    )


def with_dates(
    df: DataFrame, sources: Column, as_of: Column, *, title: str = "title", notice_date: str = "notice_date"
) -> DataFrame:
    """Add the period columns from an ordered ``array<struct<name,text>>`` of text sources.

    The title is read along with every source, the first source with a period
    wins, and the others only confirm or contradict it.
    """
    df = computed_once(df, {"_periods": periods_of(F.col(title), sources)})
    first = F.try_element_at(F.col("_periods"), F.lit(1))
    df = computed_once(df, {"_start": first["period"]["start"], "_end": first["period"]["end"]})
    same = lambda p: (p["period"]["start"] == F.col("_start")) & (p["period"]["end"] == F.col("_end"))
    return df.withColumns(
        {
            notice_date: iso_or_blank(parse_date(F.col(notice_date))),
            "application_start_date": iso_or_blank(F.col("_start")),
            "application_end_date": iso_or_blank(F.col("_end")),
            "deadline_status": deadline_status(F.col("_start"), F.col("_end"), as_of),
            "date_source": F.array_join(F.transform(F.filter("_periods", same), lambda p: p["name"]), ", "),
            "date_conflict": F.exists("_periods", lambda p: ~same(p)),
        }
    ).drop("_periods", "_start", "_end")


def age_days(notice_date: Column, as_of: Column) -> Column:
    return F.datediff(as_of, parse_date(notice_date))


def max_age_setting(value: str | None) -> int:
    """Configured age limit: bad or absent text means the default, negatives mean 0."""
    try:
        return max(0, int(value)) if value is not None else fv.DEFAULT_MAX_AGE_DAYS
    except ValueError:
        return fv.DEFAULT_MAX_AGE_DAYS


def is_recent(notice_date: Column, as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS) -> Column:
    return F.coalesce(age_days(notice_date, as_of).between(0, max_age), F.lit(False))


def is_stale(notice_date: Column, as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS) -> Column:
    return F.coalesce(age_days(notice_date, as_of) > max_age, F.lit(False))


def semester(title: Column) -> Column:
    label = F.lit("")
    for name in reversed(fv.SEMESTERS):
        label = F.when(F.contains(title, F.lit(name)), F.lit(name)).otherwise(label)
    return label


def should_run(trigger: Column, ts_utc: Column) -> Column:
    """Manual triggers always run, scheduled ones on Seoul weekdays, others never."""
    seoul = F.from_utc_timestamp(ts_utc, "Asia/Seoul")
    return (
        F.when(trigger == "workflow_dispatch", F.lit(True))
        .when(trigger == "schedule", F.weekday(seoul) < 5)
        .otherwise(F.lit(False))
    )
