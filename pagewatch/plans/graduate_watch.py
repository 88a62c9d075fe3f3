"""The graduate-admission watch: standing pages, board notices and portal rows, graded by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.durable import stored
from pagewatch.functions import rules
from pagewatch.functions.staging import computed_once
from pagewatch.functions.text import any_word, normalize_space
from pagewatch.operators import attachments as att
from pagewatch.operators import changes, dedupe, details, health
from pagewatch.operators.portals import with_region
from pagewatch.plans import course_watch
from pagewatch.sources.config import active_boards


def rule_graded(notices: DataFrame, text: Column, words: rules.GraduateWords = rules.GraduateWords()) -> DataFrame:
    """Add grade, matched words and reason; standing pages may have any title."""
    lowered = computed_once(
        notices.withColumn("_whole", F.concat_ws("\n", F.col("title"), text)),
        {
            "_low_title": F.lower(normalize_space(F.col("title"))),
            "_low_text": F.lower(normalize_space(F.col("_whole"))),
        },
    ).drop("_whole")
    title, low_text = F.col("_low_title"), F.col("_low_text")
    ruled = computed_once(lowered, {"_rule": rules.graduate_rule(title, low_text, ~F.col("is_direct"), words)})
    return ruled.withColumns(
        {
            "grade": rules.graduate_grade(F.col("_rule")),
            "matched_keywords": rules.graduate_matches(title, low_text, F.col("_rule"), words),
            "reason": rules.graduate_reason(F.col("_rule")),
        }
    ).drop("_rule", "_low_title", "_low_text")


def graduate_items(
    notices: DataFrame, universities: DataFrame, attachment_texts: DataFrame | None, checked_at: Column,
    words: rules.GraduateWords = rules.GraduateWords(), target_years: tuple[str, ...] = fv.TARGET_YEARS,
) -> DataFrame:
    """Rows graded A or B. Attachments are read only where the page text alone gives no D."""
    body = F.col("body_text")
    if attachment_texts is None:
        texted = notices.withColumn("_text", body)
    else:
        wanted = rule_graded(notices, body, words).where(F.col("grade") != "D").select("seq", "attachment_urls")
        found = att.with_attachment_texts(wanted, attachment_texts, keep_blank=True)
        joined = notices.join(found.select("seq", "attachment_texts"), "seq", "left")
        extra = F.transform(F.coalesce("attachment_texts", F.array()), lambda a: a["text"])
        texted = joined.withColumn("_text", F.array_join(F.concat(F.array(body), extra), "\n"))
    graded = rule_graded(texted, F.col("_text"), words).where(F.col("grade") != "D")
    # Standing pages are a source of notices, not notices, unless their title names a target year.
    graded = graded.where(~F.col("is_direct") | any_word(F.col("title"), target_years))
    places = universities.select(
        F.col("name").alias("university_name"),
        F.coalesce("region_name", "region", F.lit("")).alias("region"),
        F.coalesce("city", F.lit("")).alias("city"),
    )
    return graded.join(places, "university_name", "left").select(
        "seq",
        checked_at.alias("checked_at"),
        "university_name",
        F.coalesce("region", F.lit("")).alias("region"),
        F.coalesce("city", F.lit("")).alias("city"),
        "board_type", "title", "url", "notice_date", "grade", "matched_keywords", "reason", "attachment_urls",
        F.lit(False).alias("is_new"),
    )


def all_notices(direct: DataFrame, crawled: DataFrame) -> DataFrame:
    """Standing pages first, then board notices, as one ordered set.

    Board sequence numbers are not negative, so shifted far below zero standing pages come first.
    """
    fields = ["seq", "university_name", "board_type", "title", "url", "notice_date", "body_text",
              "attachment_urls", "is_direct"]
    first = direct.withColumn("seq", F.col("board_idx") - F.lit(1 << 62))
    rest = crawled.withColumn("is_direct", F.lit(False))
    return first.select(*fields).unionByName(rest.select(*fields))


def with_portals(items: DataFrame, *portals: DataFrame) -> DataFrame:
    """Portal rows after all others, portal by portal; every row keeps a place of its own."""
    for number, rows in enumerate(portals):
        placed = rows.withColumn("seq", F.col("seq") + F.lit((1 << 61) + (number << 56)))
        items = items.unionByName(placed.select(*items.columns))
    return items


def run(
    pages: DataFrame, boards: DataFrame, universities: DataFrame, *, seen: DataFrame, previous_results: DataFrame,
    as_of: Column, checked_at: Column, portals: tuple[DataFrame, ...] = (), known_only: bool = False, attachment_texts: DataFrame | None = None,
    keyword_hint: str = "2026", cap: int | None = None, max_age: int = fv.DEFAULT_MAX_AGE_DAYS,
) -> DataFrame:
    """Deduplicated graduate rows with ``is_new``. Urls are not skipped beforehand: pages change in place.

    ``portals`` are tables of portal rows; their regions come from the universities,
    and ``known_only`` keeps rows of these universities only.
    """
    notices, outcomes, _, parsed = course_watch.crawl(
        pages, boards, universities, as_of, keyword_hint=keyword_hint, cap=cap, max_age=max_age
    )
    kept = health.trusted(notices, health.run_counters(outcomes))
    direct = details.standing_pages(active_boards(boards, universities), parsed)
    items = graduate_items(all_notices(direct, kept), universities, attachment_texts, checked_at)
    placed = [with_region(rows, universities, known_only) for rows in portals]
    unique = dedupe.dedupe_graduate(stored(with_portals(items, *placed)))
    return stored(changes.mark_graduate_new(unique, seen, previous_results))
