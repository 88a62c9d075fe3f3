"""Keep one row per key: the first, or the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions.dates import semester
from pagewatch.functions.hashing import graduate_fingerprint, notice_key
from pagewatch.functions.text import strip


def first_per_key(df: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """First row by ``seq`` per key; ``seq`` is unique.

    Only keys and places are grouped, with a hash aggregate that combines in the
    tasks; the rows are then found by their places.
    """
    first = df.groupBy(key.alias("_key")).agg(F.min(seq).alias("_first")).select("_first")
    return df.join(first, F.col(seq).eqNullSafe(F.col("_first")), "left_semi")


def last_per_key(df: DataFrame, key: Column, order: Column) -> DataFrame:
    best = df.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*df.columns), order).alias("_row"))
    return best.select("_row.*")


def dedupe_notices(items: DataFrame, seq: str = "seq") -> DataFrame:
    key = notice_key(F.col("url"), F.col("university_name"), F.col("title"), F.col("attachment_urls"))
    return first_per_key(items, key, seq)


def item_fingerprint(items: DataFrame) -> Column:
    return graduate_fingerprint(
        *[
            F.col(c)
            for c in ("university_name", "board_type", "title", "notice_date", "matched_keywords", "attachment_urls")
        ]
    )


def dedupe_graduate(items: DataFrame, seq: str = "seq") -> DataFrame:
    return first_per_key(items, item_fingerprint(items), seq)


def history_key() -> Column:
    url, title, university = (strip(F.col(c)) for c in ("url", "title", "university_name"))
    whole_row = F.concat_ws("\x1f", F.lit("row"), *fv.HISTORY_FIELDS)
    return (
        F.when(url != "", F.concat_ws("\x1f", F.lit("url"), url))
        .when(title != "", F.concat_ws("\x1f", F.lit("title"), university, title))
        .otherwise(whole_row)
    )


def history_rows(items: DataFrame, min_score: int = fv.HISTORY_MIN_SCORE) -> DataFrame:
    """Results worth keeping for good, in the history layout."""
    return items.where(F.col("registration_score") >= min_score).select(
        "university_name", "region", semester(F.col("title")).alias("semester"), "notice_date",
        "application_start_date", "application_end_date", "url", "title", F.col("source_type").alias("source"),
    )


def keyed_history(rows: DataFrame) -> DataFrame:
    """History rows with the ``key`` that a table of them is dealt by."""
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in fv.HISTORY_FIELDS]).withColumn("key", history_key())


def merge_history(existing: DataFrame, current: DataFrame) -> DataFrame:
    """Merged history; this run beats earlier ones, within a side the greatest row wins."""
    fields = list(fv.HISTORY_FIELDS)

    def side(rows: DataFrame, number: int) -> DataFrame:
        return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in fields], F.lit(number).alias("_side"))

    both = side(existing, 0).unionByName(side(current, 1))
    kept = last_per_key(both, history_key(), F.struct("_side", *fields))
    return kept.select(*fields)


