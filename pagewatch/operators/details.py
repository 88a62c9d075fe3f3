"""Detail pages: date, body, attachments, images, and standing pages as notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions import urls
from pagewatch.functions.dates import first_date
from pagewatch.functions.staging import bind
from pagewatch.functions.text import contains_any, distinct_in_order, non_empty, normalize_space

MIN_SELECTED_CHARS = 80


def _first_found(texts: Column) -> Column:
    """First date found in an array of texts, in array order."""
    dates = F.transform(texts, lambda t: first_date(t))
    return F.try_element_at(F.filter(dates, lambda d: d != ""), F.lit(1))


def posted_date(meta_dates: Column, date_texts: Column, page_text: Column) -> Column:
    """Date from meta tags, else from date elements, else from labelled text; blank when none."""
    labelled = F.regexp_extract(normalize_space(page_text), fv.POSTED_DATE_PATTERN, 1)
    # first_date reads its text many times; squeezing white space neither makes nor breaks a label
    in_text = F.when(contains_any(page_text, fv.POSTED_DATE_LABELS), bind(labelled, first_date)).otherwise("")
    return F.coalesce(_first_found(meta_dates), _first_found(date_texts), in_text)


def page_title(title_texts: Column, fallback: Column, most: int | None = None) -> Column:
    named = F.filter(F.transform(title_texts, normalize_space), lambda t: t != "")
    first = F.try_element_at(named, F.lit(1))
    return F.coalesce(first if most is None else F.left(first, F.lit(most)), fallback)


def main_text(body_texts: Column, body_text: Column) -> Column:
    """Text of the first content element that holds more than a line, else of the whole page."""
    long_enough = F.filter(
        F.transform(body_texts, normalize_space), lambda t: F.length(t) > MIN_SELECTED_CHARS
    )
    return F.coalesce(F.try_element_at(long_enough, F.lit(1)), normalize_space(body_text))


def attachment_urls(page_url: Column, links: Column) -> Column:
    """Public attachment targets outside page chrome, first occurrence order."""
    wanted = F.filter(links, lambda a: ~a["in_chrome"] & urls.is_attachment_link(a["href"], a["text"]))
    targets = F.transform(wanted, lambda a: urls.resolve_reference(page_url, a["href"]))
    return F.array_distinct(F.filter(targets, lambda u: urls.is_public_http_url(u)))


def image_urls(page_url: Column, images: Column, most: int | None = None) -> Column:
    """Public content images in page order; all of them unless ``most`` says otherwise."""
    sources = F.transform(
        images,
        lambda i: F.trim(F.coalesce(non_empty(i["src"]), non_empty(i["data_src"]), i["data_original"])),
    )
    targets = F.transform(
        F.filter(sources, lambda s: urls.is_content_image(s)), lambda s: urls.resolve_reference(page_url, s)
    )
    public = F.filter(targets, lambda u: urls.is_public_http_url(u))
    found = distinct_in_order(public)
    return found if most is None else F.slice(found, 1, most)


def crawled_notices(frontier: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Candidates joined with their parsed detail page; a missing or broken page is a failed detail."""
    facts = detail_pages.select(
        "url",
        posted_date(F.col("meta_dates"), F.col("date_texts"), F.col("page_text")).alias("_page_date"),
        main_text(F.col("body_texts"), F.col("body_text")).alias("body_text"),
        attachment_urls(F.col("url"), F.col("links")).alias("attachment_urls"),
        image_urls(F.col("url"), F.col("images")).alias("image_urls"),
        F.col("parse_error").isNull().alias("_parsed"),
        F.col("parse_error"),
    )
    none = F.array().cast("array<string>")
    joined = frontier.join(facts, "url", "left")
    ok = F.coalesce(F.col("_parsed"), F.lit(False))
    return joined.select(
        *[F.col(c) for c in frontier.columns if c != "notice_date"],
        F.coalesce(non_empty(F.when(ok, F.col("_page_date"))), F.col("notice_date")).alias("notice_date"),
        F.when(ok, F.col("body_text")).otherwise("").alias("body_text"),
        F.when(ok, F.col("attachment_urls")).otherwise(none).alias("attachment_urls"),
        F.when(ok, F.col("image_urls")).otherwise(none).alias("image_urls"),
        ok.alias("detail_succeeded"),
        F.when(~ok, F.coalesce("parse_error", F.lit("no page"))).otherwise("").alias("error"),
    )


def standing_pages(boards: DataFrame, parsed: DataFrame) -> DataFrame:
    """Boards marked ``scan_page`` as notices of their own; pages that failed are left out."""
    marked = boards.where(F.coalesce("scan_page", F.lit(False)))
    pages = parsed.where(F.col("parse_error").isNull()).select(
        "url", "title_texts", "body_texts", "body_text", "links"
    )
    named = F.concat_ws(" ", "university_name", "board_type")
    return marked.join(pages, "url").select(
        "board_idx",
        "university_name",
        "board_type",
        page_title(F.col("title_texts"), named).alias("title"),
        "url",
        F.lit("").alias("notice_date"),
        main_text(F.col("body_texts"), F.col("body_text")).alias("body_text"),
        attachment_urls(F.col("url"), F.col("links")).alias("attachment_urls"),
        F.lit(True).alias("is_direct"),
    )
