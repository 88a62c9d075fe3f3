"""Notice-like tables derived from the driver tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions import dates, text
from pagewatch.functions.hashing import content_fingerprint
from pagewatch.functions.scoring import Vocabulary, with_classification

AS_OF_TEXT = "2026-06-15"
CHECKED_AT = "2026-06-15T09:00:00+09:00"
# Vocabulary for the driver's invented prose.
WORDS = {
    "registration_positive": {"tion": 30, "license": 60, "und": 45, "that": 25},
    "registration_negative": {"que": -40},
    "external_positive": {"with": 20, "this": 15},
    "external_negative": {"les": -20},
    "computer_positive": {"from": 25, "ment": 20},
    "computer_negative": {"date": -10},
}
EXCLUDED = ("Copyright", "lorem ipsum")
VOCABULARY = Vocabulary.from_maps(WORDS)


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(offset: Column) -> Column:
    return F.date_add(F.lit("2026-06-01").cast("date"), offset.cast("int"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as crawled notices; exact copies share their url."""
    return notice_columns(table(spark, sf_dir, "documents"))


def notice_columns(docs: DataFrame) -> DataFrame:
    start = day(F.col("n_chars") % 20)
    end = F.date_add(start, (F.col("n_chars") % 25).cast("int"))
    files = F.array(
        F.concat(F.lit("https://files.example.com/"), "lang", F.lit("/"), (F.col("n_chars") % 7).cast("string"), F.lit(".hwpx")),
        F.concat(F.lit("https://files.example.com/"), "lang", F.lit(".pdf")),
    )
    dated = F.when(F.col("n_chars") % 11 == 0, "").otherwise(F.date_format(day(F.col("n_chars") % 30), "yyyy-MM-dd"))
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("NATION_"), F.substring("source", 4, 10)).alias("university_name"),
        F.col("source").alias("board_type"),
        text.normalize_space(F.substring_index("text", "\n", 1)).alias("title"),
        F.concat(F.lit("https://www.example.com/notice/"), F.sha1("text")).alias("url"),
        dated.alias("notice_date"),
        text.normalize_space(F.col("text")).alias("body_text"),
        F.when(F.col("n_chars") % 3 == 0, F.array().cast("array<string>")).otherwise(files).alias("attachment_urls"),
        dates.iso_or_blank(start).alias("application_start_date"),
        dates.iso_or_blank(end).alias("application_end_date"),
        dates.deadline_status(start, end, as_of()).alias("deadline_status"),
    )


def ns(x: str) -> str:
    """SQL of whitespace squeezing."""
    return f"trim(regexp_replace({x}, '{fv.WHITESPACE}', ' ', 'g'))"


def status_sql(start: str, end: str, today: str = f"DATE '{AS_OF_TEXT}'") -> str:
    return (
        f"CASE WHEN {start} IS NULL AND {end} IS NULL THEN '날짜확인필요' WHEN {today} < {start} THEN '접수예정' "
        f"WHEN {today} > {end} THEN '마감됨' WHEN {end} - {today} <= 3 THEN '긴급' "
        f"WHEN {end} - {today} <= 7 THEN '마감임박' ELSE '모집중' END"
    )


_FILES = (
    "'https://files.example.com/'||lang||'/'||(n_chars%7)::VARCHAR||'.hwpx'",
    "'https://files.example.com/'||lang||'.pdf'",
)
NOTICES_SQL = f"""
v_dates AS (SELECT *, DATE '2026-06-01' + (n_chars % 20)::INT AS ds,
                   DATE '2026-06-01' + (n_chars % 20)::INT + (n_chars % 25)::INT AS de FROM documents),
v_notice AS (
  SELECT doc_id AS seq, 'NATION_' || substr(source, 4, 10) AS university_name, source AS board_type,
         {ns("split_part(text, chr(10), 1)")} AS title,
         'https://www.example.com/notice/' || sha1(text) AS url,
         CASE WHEN n_chars % 11 = 0 THEN '' ELSE strftime(DATE '2026-06-01' + (n_chars % 30)::INT, '%Y-%m-%d') END AS notice_date,
         {ns("text")} AS body_text,
         CASE WHEN n_chars % 3 = 0 THEN []::VARCHAR[] ELSE [{", ".join(_FILES)}] END AS attachment_urls,
         strftime(ds, '%Y-%m-%d') AS application_start_date, strftime(de, '%Y-%m-%d') AS application_end_date,
         {status_sql("ds", "de")} AS deadline_status
  FROM v_dates)
"""


def _points_sql(family: str, polarity: str) -> str:
    words = WORDS[f"{family}_{polarity}"]
    return "(" + " + ".join(f"CASE WHEN contains(low, '{w.lower()}') THEN {p} ELSE 0 END" for w, p in words.items()) + ")"


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w.lower()}')" for w in words) + ")"


_COMPUTER_HIT = _any_sql(WORDS["computer_positive"])
_MATCHES = ", ".join(
    f"CASE WHEN contains(low, '{w.lower()}')"
    + (f" AND NOT {_COMPUTER_HIT}" if group == "computer_negative" else "")
    + f" THEN '{w}' END"
    for group, words in WORDS.items()
    for w in words
)
_EXCLUDED = " OR ".join(f"contains(hay, '{w}')" for w in EXCLUDED)
FRESH_SQL = (
    "CASE deadline_status WHEN '모집중' THEN 50 WHEN '접수예정' THEN 45 WHEN '마감임박' THEN 40 "
    "WHEN '긴급' THEN 35 WHEN '날짜확인필요' THEN 10 WHEN '마감됨' THEN -30 ELSE 10 END"
)
SCORED_SQL = f"""
v_low AS (SELECT *, title || chr(10) || body_text AS hay, lower(title || chr(10) || body_text) AS low FROM v_notice),
v_scored AS (
  SELECT * EXCLUDE (hay, low),
         {_points_sql("registration", "positive")} + {_points_sql("registration", "negative")} AS registration_score,
         {_points_sql("external", "positive")} + {_points_sql("external", "negative")} AS external_score,
         {_points_sql("computer", "positive")} + CASE WHEN {_COMPUTER_HIT} THEN 0 ELSE {_points_sql("computer", "negative")} END AS computer_score,
         {FRESH_SQL} AS freshness_score,
         list_filter([{_MATCHES}], lambda m: m IS NOT NULL) AS matched_keywords,
         ({_EXCLUDED}) AS excluded
  FROM v_low),
v_graded AS (
  SELECT *, CASE WHEN excluded THEN 'D' WHEN deadline_status = '마감됨' THEN 'D'
      WHEN registration_score >= 70 AND external_score >= 25 AND computer_score >= 25 AND freshness_score > 0 THEN 'A'
      WHEN registration_score >= 45 AND external_score >= 20
           AND registration_score + greatest(external_score, 0) + greatest(computer_score, 0) + freshness_score >= 100 THEN 'B'
      WHEN registration_score >= 20 OR computer_score >= 30 THEN 'C' ELSE 'D' END AS grade,
    CASE WHEN external_score >= 30 THEN '가능성 높음' WHEN external_score <= -20 THEN '불가 가능성 높음' ELSE '확인 필요' END AS external_applicant_status,
    CASE WHEN computer_score >= 30 THEN '가능성 높음' WHEN computer_score <= 0 THEN '관련성 낮음' ELSE '확인 필요' END AS computer_course_status
  FROM v_scored)
"""
# Title words that save a grade C here (the fixed list is Korean).
STRONG_TITLE = ("th", "ion")
ITEMS_SQL = f"""
v_print AS (SELECT *, sha256(array_to_string([title, body_text] || list_sort(attachment_urls), chr(10))) AS content_fingerprint FROM v_graded),
v_item AS (
  SELECT *, CASE seq % 5 WHEN 0 THEN '' WHEN 1 THEN 'new' WHEN 2 THEN 'content_changed' WHEN 3 THEN 'unchanged' ELSE 'grade_changed' END AS change_type,
         seq % 2 = 0 AS is_new
  FROM v_print)
"""


def with_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classification(notices(spark, sf_dir), VOCABULARY, text="body_text", exclusion_terms=EXCLUDED)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded notices with a fingerprint and made-up run flags."""
    kind = F.lit("grade_changed")
    for number, name in enumerate(("", "new", "content_changed", "unchanged")):
        kind = F.when(F.col("seq") % 5 == number, name).otherwise(kind)
    none = F.array().cast("array<string>")
    return graded(spark, sf_dir).withColumns(
        {
            "content_fingerprint": content_fingerprint(
                F.col("title"), F.col("body_text"), F.col("attachment_urls"), none
            ),
            "change_type": kind,
            "is_new": F.col("seq") % 2 == 0,
        }
    )


def recent_sql(date: str = "notice_date", days: int = 7) -> str:
    return (
        f"coalesce(DATE '{AS_OF_TEXT}' - try_cast(nullif({date}, '') AS DATE) BETWEEN 0 AND {days}, false)"
    )


def stale_sql(date: str = "notice_date", days: int = 7) -> str:
    return f"coalesce(DATE '{AS_OF_TEXT}' - try_cast(nullif({date}, '') AS DATE) > {days}, false)"


CHANGED_SQL = (
    "CASE WHEN change_type <> '' THEN change_type IN ('new','content_changed','grade_changed','deadline_changed') "
    "ELSE is_new END"
)
TARGET_SQL = f"({CHANGED_SQL} AND grade IN ('A','B') AND deadline_status <> '마감됨' AND {recent_sql()})"


def universities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name, key, rkey = [c for c in nation.columns if c.endswith("name")][0], "n_nationkey", "n_regionkey"
    joined = nation.join(region, F.col(rkey) == F.col("r_regionkey"))
    shown = F.when(F.col(key) % 2 == 0, F.concat(F.lit("Area "), F.col("r_name")))
    return joined.select(
        F.col(name).alias("name"),
        F.col("r_name").alias("region"),
        shown.alias("region_name"),
        F.concat(F.lit("City "), F.col(key).cast("string")).alias("city"),
        F.array(F.concat(F.lower(name), F.lit(".example.com"))).alias("domains"),
        F.col(key).cast("int").alias("priority"),
        F.lit("").alias("notes"),
    )


UNIVERSITIES_SQL = """
v_university AS (
  SELECT n_name AS name, r_name AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'Area ' || r_name END AS region_name,
         'City ' || n_nationkey::VARCHAR AS city FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as boards; some are disabled, some belong to no configured university."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("board_idx"),
        F.concat(F.lit("NATION_"), (F.col("s_nationkey") + F.when(key % 10 == 9, 100).otherwise(0)).cast("string")).alias(
            "university_name"
        ),
        F.col("s_name").alias("board_type"),
        F.concat(F.lit("https://board.example.com/"), key.cast("string")).alias("url"),
        F.when(key % 4 == 0, F.lit(None).cast("boolean")).otherwise(key % 7 != 3).alias("enabled"),
    )


BOARDS_SQL = """
v_board AS (
  SELECT s_suppkey AS board_idx,
         'NATION_' || (s_nationkey + CASE WHEN s_suppkey % 10 = 9 THEN 100 ELSE 0 END)::VARCHAR AS university_name,
         s_name AS board_type, 'https://board.example.com/' || s_suppkey::VARCHAR AS url,
         CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 7 <> 3 END AS enabled FROM supplier)
"""
