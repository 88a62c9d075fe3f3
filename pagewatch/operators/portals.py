"""Application portals as notice rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv, schemas
from pagewatch.functions.rules import portal_grade
from pagewatch.functions.text import any_word, non_empty, normalize_space
from pagewatch.operators.ordering import drop_layout, sorted_ranges, with_position


def portal_rows(
    df: DataFrame, *, portal: str, name: Column, url: Column, board_type: Column, reason: Column,
    as_of: Column, checked_at: Column,
) -> DataFrame:
    """Rows in the graduate layout: university is the first word, the check date stands in for a posting date."""
    none = F.array().cast("array<string>")
    return df.withColumn("_name", name).select(
        "seq",
        checked_at.alias("checked_at"),
        F.coalesce(non_empty(F.split("_name", " ")[0]), F.col("_name")).alias("university_name"),
        F.lit("").alias("region"),
        F.lit("").alias("city"),
        board_type.alias("board_type"),
        F.col("_name").alias("title"),
        url.alias("url"),
        F.date_format(as_of, "yyyy-MM-dd").alias("notice_date"),
        portal_grade(F.col("_name")).alias("grade"),
        F.array(F.lit(fv.PORTAL_SCHOOL), F.lit(portal)).alias("matched_keywords"),
        reason.alias("reason"),
        none.alias("attachment_urls"),
        F.lit(False).alias("is_new"),
    )


def numbered(rows: DataFrame, part: str, place: str) -> DataFrame:
    """``seq`` from 0 in the order of (part, place): distinct however many files or pages there are."""
    placed = with_position(sorted_ranges(rows, [part], [place]), "seq")
    return drop_layout(placed).withColumn("seq", F.col("seq") - 1)


def list_portal(parsed: DataFrame, as_of: Column, checked_at: Column, term: str = "") -> DataFrame:
    """Graduate sections of a portal list page; only clearly general graduate schools (A) are kept."""
    links = parsed.select("page_id", F.posexplode("links").alias("pos", "a")).where(
        F.col("a.list_heading").isNotNull()
    )
    heading = normalize_space(F.col("a.list_heading"))
    rows = links.select(
        heading.alias("heading"),
        normalize_space(F.col("a.bare_text")).alias("name"),
        F.col("a.href").alias("href"), F.col("a.icon_title").alias("state"), "page_id", "pos",
    ).where(F.contains("heading", F.lit(fv.PORTAL_SCHOOL)) & F.contains("heading", F.lit(term)))
    state = F.coalesce(non_empty(F.col("state")), F.lit(fv.STATUS_CHECK))
    return portal_rows(
        numbered(rows, "page_id", "pos"),
        portal=fv.PORTAL_LIST,
        name=F.col("name"),
        url=F.col("href"),
        board_type=F.concat_ws(" ", F.lit(fv.PORTAL_LIST), "heading"),
        reason=F.format_string(fv.PORTAL_LIST_REASON, F.col("heading"), state),
        as_of=as_of,
        checked_at=checked_at,
    ).where(F.col("grade") == "A")


def payload_services(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Services of JSON payloads that travel as strings inside JSON objects; payloads stand in order of a hash."""
    data = F.from_json(F.get_json_object(raw, "$.d"), schemas.PORTAL_PAYLOAD)
    services = payloads.select(F.xxhash64(raw).alias("_payload"), F.posexplode(data["Univdata"]).alias("_pos", "s"))
    return numbered(services, "_payload", "_pos").select("seq", "s.*")


def api_portal(services: DataFrame, as_of: Column, checked_at: Column, term: str = "") -> DataFrame:
    """Graduate services; a term only filters names that state one; D rows are dropped."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = services.withColumn(
        "name", normalize_space(F.concat(text("ShortName"), F.lit(" "), text("ServiceName")))
    )
    wanted = F.contains("name", F.lit(fv.PORTAL_SCHOOL)) | F.contains(
        text("CategorytypeName"), F.lit(fv.PORTAL_SCHOOL)
    )
    if term:
        wanted = wanted & (~any_word(F.col("name"), fv.PORTAL_TERMS) | F.contains("name", F.lit(term)))
    period = F.concat(
        F.left(text("WriteFromTime"), F.lit(10)), F.lit(" ~ "), F.left(text("WriteToTime"), F.lit(10))
    )
    return portal_rows(
        named.where(wanted),
        portal=fv.PORTAL_API,
        name=F.col("name"),
        url=F.coalesce(non_empty(F.col("Link")), F.lit(fv.PORTAL_API_PAGE)),
        board_type=F.lit(fv.PORTAL_API_BOARD),
        reason=F.format_string(fv.PORTAL_API_REASON, period),
        as_of=as_of,
        checked_at=checked_at,
    ).where(F.col("grade") != "D")


def with_region(rows: DataFrame, universities: DataFrame, restrict: bool) -> DataFrame:
    """Fill region and city from the university table; with a region filter on, unknown universities go.

    A name that the table has more than once counts once, with the least of its places.
    """
    own = F.struct(F.coalesce("region_name", "region", F.lit("")).alias("region"), F.coalesce("city", F.lit("")).alias("city"))
    places = universities.groupBy(F.col("name").alias("university_name")).agg(F.min(own).alias("_place"))
    if restrict:
        rows = rows.join(places, "university_name", "left_semi")
    joined = rows.join(places, "university_name", "left")
    return joined.withColumns({c: F.coalesce(f"_place.{c}", F.lit("")) for c in ("region", "city")}).drop("_place")
