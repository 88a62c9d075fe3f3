"""Text, date and key operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch import fixed_values as fv
from pagewatch.durable import stored
from pagewatch.functions import dates, hashing, text
from pagewatch.operators import dedupe
from pagewatch.queries import tables as t
from pagewatch.queries.registry import query
from pagewatch.sources.sinks import flatten_rows, guarded_rows

NS = t.ns("text")


@query("whitespace_squeeze", f"SELECT doc_id, {NS} AS squeezed FROM documents")
def whitespace_squeeze(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.normalize_space(F.col("text")).alias("squeezed"))


@query(
    "ellipsis_cut",
    f"""SELECT doc_id, CASE WHEN length({NS}) > 350 THEN left({NS}, 349) || '…' ELSE {NS} END AS cut,
    left({NS}, 240) AS preview FROM documents""",
)
def ellipsis_cut(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        text.truncate(F.col("text"), fv.EVIDENCE_CHARS).alias("cut"),
        text.message_preview(F.col("text")).alias("preview"),
    )


_STYLES = ("등록 %s-%s-%s", "작성 20%s. %s. %s", "게시일：20%s년 %s월 %s일", "ver %s.%s.%s", "１９%s-%s-%s")


def _date_line(fmt: str):
    d = F.col("o_orderdate")
    return F.format_string(fmt, F.date_format(d, "yy"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"))


_DATE_LINE_SQL = "CASE o_orderkey % 6 " + " ".join(
    f"WHEN {i} THEN printf('{s}', strftime(o_orderdate, '%y'), month(o_orderdate)::VARCHAR, day(o_orderdate)::VARCHAR)"
    for i, s in enumerate(_STYLES)
) + " ELSE 'no date' END"
_FOLDED = "translate(line, '０１２３４５６７８９', '0123456789')"


@query(
    "first_dates",
    f"""WITH v AS (SELECT o_orderkey, {_DATE_LINE_SQL} AS line FROM orders),
    m AS (SELECT o_orderkey, line, regexp_extract({_FOLDED}, '{fv.LONG_DATE_PATTERN}', ['y','m','d']) AS a,
                 regexp_extract({_FOLDED}, '{fv.SHORT_DATE_PATTERN}', ['y','m','d']) AS b FROM v)
    SELECT o_orderkey, line, CASE WHEN a.y <> '' THEN a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0')
      WHEN b.y <> '' THEN '20' || b.y || '-' || lpad(b.m, 2, '0') || '-' || lpad(b.d, 2, '0') ELSE '' END AS found
    FROM m""",
)
def first_dates(spark, sf_dir):
    line = F.lit("no date")
    for number, style in enumerate(_STYLES):
        line = F.when(F.col("o_orderkey") % 6 == number, _date_line(style)).otherwise(line)
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return rows.withColumn("found", dates.first_date(F.col("line")))


@query(
    "formula_guard",
    """WITH v AS (SELECT event_id, CASE event_type WHEN 'click' THEN '=' WHEN 'view' THEN '  +' WHEN 'error' THEN '-'
      WHEN 'signup' THEN '@' ELSE '' END || event_type AS cell FROM events)
    SELECT event_id, CASE WHEN regexp_matches(cell, '^\\s*[=+@-]') THEN '''' || cell ELSE cell END AS cell FROM v""",
)
def formula_guard(spark, sf_dir):
    kind = F.col("event_type")
    mark = (
        F.when(kind == "click", "=").when(kind == "view", "  +").when(kind == "error", "-").when(kind == "signup", "@")
        .otherwise("")
    )
    rows = t.table(spark, sf_dir, "events").select("event_id", F.concat(mark, kind).alias("cell"))
    return guarded_rows(rows)


@query(
    "flattened_rows",
    t.with_sql(
        """SELECT seq, title, array_to_string(attachment_urls, '; ') AS attachment_urls,
        'a: ' || board_type || ' | b: ' || notice_date AS ocr_evidence, '' AS absent FROM v_notice""",
        t.NOTICES_SQL,
    ),
)
def flattened_rows(spark, sf_dir):
    rows = t.notices(spark, sf_dir).withColumn(
        "ocr_evidence", F.create_map(F.lit("a"), "board_type", F.lit("b"), "notice_date")
    )
    return flatten_rows(rows, ("seq", "title", "attachment_urls", "ocr_evidence", "absent"))


@query(
    "list_cells",
    """WITH v AS (SELECT event_id, ' ' || event_type || ' ;; ' || user_id::VARCHAR || ';' || event_type AS cell FROM events),
    l AS (SELECT event_id, list_filter(list_transform(string_split(cell, ';'), lambda x: trim(x)), lambda x: x <> '') AS a FROM v)
    SELECT event_id, array_to_string(a, '|') AS listed, len(list_distinct(a)) AS n_distinct, a[1] || '|' || a[2] AS in_order FROM l""",
)
def list_cells(spark, sf_dir):
    cell = F.concat(F.lit(" "), "event_type", F.lit(" ;; "), F.col("user_id").cast("string"), F.lit(";"), "event_type")
    rows = t.table(spark, sf_dir, "events").select("event_id", text.list_values(cell).alias("a"))
    distinct = text.distinct_in_order(F.col("a"))
    return rows.select(
        "event_id",
        F.array_join("a", "|").alias("listed"),
        F.size(distinct).cast("bigint").alias("n_distinct"),
        F.array_join(distinct, "|").alias("in_order"),
    )


# ----------------------------------------------------------------- dates
def _period_line(spark, sf_dir):
    """Order dates as application periods in several spellings (dates moved 25 years on)."""
    o = t.table(spark, sf_dir, "orders")
    start = F.to_date(F.add_months("o_orderdate", 300))
    end = F.date_add(start, (F.col("o_orderkey") % 40).cast("int") - 3)
    full, short = F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "MM.dd")
    style = F.col("o_orderkey") % 5
    line = (
        F.when(style == 0, F.concat(F.lit("접수기간 "), full, F.lit(" ~ "), F.date_format(end, "yyyy-MM-dd")))
        .when(style == 1, F.concat(F.lit("신청 "), full, F.lit("부터 "), short))
        .when(style == 2, F.concat(F.lit("게시 "), full, F.lit(" ~ "), short))
        .when(style == 3, F.concat(F.lit("안내문. 원서접수 "), full, F.lit(" 00 - "), short, F.lit("! 등록 끝")))
        .otherwise(F.concat(F.lit("안내\n수강 "), full, F.lit(" to "), F.date_format(end, "yyyy/M/d")))
    )
    return o.select("o_orderkey", line.alias("line"), start.alias("s"), end.alias("e"))


_PERIOD_SQL = """
v_span AS (SELECT o_orderkey, (o_orderdate + INTERVAL 300 MONTH)::DATE AS s,
                  (o_orderdate + INTERVAL 300 MONTH)::DATE + (o_orderkey % 40)::INT - 3 AS e FROM orders),
v_line AS (SELECT o_orderkey, s, e, CASE o_orderkey % 5
   WHEN 0 THEN '접수기간 ' || strftime(s, '%Y-%m-%d') || ' ~ ' || strftime(e, '%Y-%m-%d')
   WHEN 1 THEN '신청 ' || strftime(s, '%Y-%m-%d') || '부터 ' || strftime(e, '%m.%d')
   WHEN 2 THEN '게시 ' || strftime(s, '%Y-%m-%d') || ' ~ ' || strftime(e, '%m.%d')
   WHEN 3 THEN '안내문. 원서접수 ' || strftime(s, '%Y-%m-%d') || ' 00 - ' || strftime(e, '%m.%d') || '! 등록 끝'
   ELSE '안내' || chr(10) || '수강 ' || strftime(s, '%Y-%m-%d') || ' to ' || year(e)::VARCHAR || '/' || month(e)::VARCHAR || '/' || day(e)::VARCHAR END AS line
  FROM v_span)
"""


def _range_sql(source: str, key: str, texts: str) -> str:
    """CTEs finding the first valid period per (key) in the rows of ``source``."""
    words = "|".join(fv.RANGE_CONTEXT_WORDS)
    pattern = fv.RANGE_PATTERN
    return f"""
{source}_seg AS (SELECT {key}, unnest(segs) AS seg, generate_subscripts(segs, 1) AS si FROM (
   SELECT {key}, regexp_split_to_array(regexp_replace({texts}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '[\\n\\r]') AS segs FROM {source})),
{source}_hit AS (SELECT {key}, si, unnest(hits) AS hit, generate_subscripts(hits, 1) AS hi FROM (
   SELECT {key}, si, regexp_extract_all({t.ns("seg")}, '(?i){pattern}') AS hits FROM {source}_seg WHERE regexp_matches(seg, '{words}'))),
{source}_parts AS (SELECT {key}, si, hi, regexp_extract(hit, '(?i){pattern}', ['y','m','d','y2','m2','d2']) AS p FROM {source}_hit),
{source}_range AS (SELECT {key}, si, hi, try_cast(p.y || '-' || p.m || '-' || p.d AS DATE) AS ds,
   try_cast(CASE WHEN p.y2 = '' THEN p.y ELSE p.y2 END || '-' || p.m2 || '-' || p.d2 AS DATE) AS de FROM {source}_parts),
{source}_first AS (SELECT {key}, arg_min(ds, si * 1000 + hi) AS ds, arg_min(de, si * 1000 + hi) AS de
   FROM {source}_range WHERE ds IS NOT NULL AND de IS NOT NULL AND de >= ds GROUP BY {key})
"""


@query(
    "application_periods",
    t.with_sql(
        f"""SELECT l.o_orderkey, coalesce(strftime(f.ds, '%Y-%m-%d'), '') AS starts, coalesce(strftime(f.de, '%Y-%m-%d'), '') AS ends,
        {t.status_sql("f.ds", "f.de", "DATE '2023-06-15'")} AS status
        FROM v_line l LEFT JOIN v_line_first f USING (o_orderkey)""",
        _PERIOD_SQL,
        _range_sql("v_line", "o_orderkey", "line"),
    ),
)
def application_periods(spark, sf_dir):
    rows = _period_line(spark, sf_dir).withColumn("p", dates.application_range(F.col("line")))
    return rows.select(
        "o_orderkey",
        dates.iso_or_blank(F.col("p.start")).alias("starts"),
        dates.iso_or_blank(F.col("p.end")).alias("ends"),
        dates.deadline_status(F.col("p.start"), F.col("p.end"), F.lit("2023-06-15").cast("date")).alias("status"),
    )


_SOURCES_SQL = """
v_source AS (
  SELECT o_orderkey, 0 AS ord, '본문' AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE line END AS txt FROM v_line
  UNION ALL SELECT o_orderkey, 1, '첨부:a', '등록 ' || strftime(s, '%Y.%m.%d') || '~' || strftime(e, '%Y.%m.%d') FROM v_line
  UNION ALL SELECT o_orderkey, 2, '이미지 OCR:b', CASE WHEN o_orderkey % 4 = 0 THEN '등록 2030-01-01 ~ 2030-02-01' ELSE line END FROM v_line),
v_titled AS (SELECT o_orderkey, ord, name, 'notice' || chr(10) || txt AS line FROM v_source)
"""


@query(
    "period_sources",
    t.with_sql(
        """SELECT o.o_orderkey, coalesce(strftime(a.ds, '%Y-%m-%d'), '') AS application_start_date,
          coalesce(strftime(a.de, '%Y-%m-%d'), '') AS application_end_date,
          coalesce(a.date_source, '') AS date_source, coalesce(a.date_conflict, false) AS date_conflict
        FROM orders o LEFT JOIN (
          SELECT o_orderkey, any_value(fs) AS ds, any_value(fe) AS de,
            string_agg(name, ', ' ORDER BY ord) FILTER (ds = fs AND de = fe) AS date_source,
            bool_or(NOT (ds = fs AND de = fe)) AS date_conflict
          FROM (SELECT r.*, t.name, first_value(ds) OVER w AS fs, first_value(de) OVER w AS fe
                FROM v_titled_first r JOIN v_titled t USING (o_orderkey, ord) WINDOW w AS (PARTITION BY o_orderkey ORDER BY ord))
          GROUP BY o_orderkey) a USING (o_orderkey)""",
        _PERIOD_SQL,
        _SOURCES_SQL,
        _range_sql("v_titled", "o_orderkey, ord", "line"),
    ),
)
def period_sources(spark, sf_dir):
    line, key = F.col("line"), F.col("o_orderkey")
    second = F.concat(
        F.lit("등록 "), F.date_format("s", "yyyy.MM.dd"), F.lit("~"), F.date_format("e", "yyyy.MM.dd")
    )
    sources = [
        (F.lit(fv.SOURCE_BODY), F.when(key % 3 == 0, "none").otherwise(line)),
        (F.lit("첨부:a"), second),
        (F.lit("이미지 OCR:b"), F.when(key % 4 == 0, "등록 2030-01-01 ~ 2030-02-01").otherwise(line)),
    ]
    array = F.array(*[F.struct(n.alias("name"), x.alias("text")) for n, x in sources])
    rows = _period_line(spark, sf_dir).withColumns({"title": F.lit("notice"), "notice_date": F.lit("")})
    dated = dates.with_dates(rows, array, F.lit("2023-06-15").cast("date"))
    return dated.select(
        "o_orderkey", "application_start_date", "application_end_date", "date_source", "date_conflict"
    )


@query(
    "deadline_statuses",
    f"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderdate)::DATE END AS s,
      CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderdate)::DATE + (o_orderkey % 400)::INT END AS e FROM orders)
    SELECT o_orderkey, {t.status_sql("s", "e", "DATE '1998-06-15'")} AS status FROM v""",
)
def deadline_statuses(spark, sf_dir):
    o, key = t.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    start = F.when(key % 5 != 0, day)
    end = F.when(key % 7 != 0, F.date_add(day, (key % 400).cast("int")))
    return o.select(
        "o_orderkey", dates.deadline_status(start, end, F.lit("1998-06-15").cast("date")).alias("status")
    )


@query(
    "valid_dates",
    """WITH v AS (SELECT l_orderkey, l_linenumber, 2020 + l_linenumber AS y, l_partkey % 14 AS m, l_suppkey % 33 AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, coalesce(strftime(try_cast(y || '-' || m || '-' || d AS DATE), '%Y-%m-%d'), '') AS made,
      coalesce(strftime(try_cast(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE), '%Y-%m-%d'), '') AS parsed FROM v""",
)
def valid_dates(spark, sf_dir):
    y, m, d = (
        (F.lit(2020) + F.col("l_linenumber")).cast("string"),
        (F.col("l_partkey") % 14).cast("string"),
        (F.col("l_suppkey") % 33).cast("string"),
    )
    written = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        dates.iso_or_blank(dates.date_of(y, m, d)).alias("made"),
        dates.iso_or_blank(dates.parse_date(written)).alias("parsed"),
    )


@query(
    "semesters",
    """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2026 1학기 안내' WHEN 1 THEN '2학기 모집, 1학기 제외'
       WHEN 2 THEN o_orderpriority ELSE '2 학기' END AS title FROM orders)
    SELECT o_orderkey, CASE WHEN contains(title, '2학기') THEN '2학기' WHEN contains(title, '1학기') THEN '1학기' ELSE '' END AS semester FROM v""",
)
def semesters(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    title = (
        F.when(k == 0, "2026 1학기 안내").when(k == 1, "2학기 모집, 1학기 제외").when(k == 2, F.col("o_orderpriority"))
        .otherwise("2 학기")
    )
    return t.table(spark, sf_dir, "orders").select("o_orderkey", dates.semester(title).alias("semester"))


@query(
    "notice_ages",
    t.with_sql(
        f"""SELECT seq, DATE '{t.AS_OF_TEXT}' - try_cast(nullif(notice_date, '') AS DATE) AS age,
        {t.recent_sql()} AS recent, {t.stale_sql()} AS stale FROM v_notice""",
        t.NOTICES_SQL,
    ),
)
def notice_ages(spark, sf_dir):
    day = F.col("notice_date")
    return t.notices(spark, sf_dir).select(
        "seq",
        dates.age_days(day, t.as_of()).cast("bigint").alias("age"),
        dates.is_recent(day, t.as_of()).alias("recent"),
        dates.is_stale(day, t.as_of()).alias("stale"),
    )


@query(
    "business_day_runs",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false
      ELSE isodow(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Seoul') <= 5 END AS runs FROM events""",
)
def business_day_runs(spark, sf_dir):
    kind = F.col("event_type")
    trigger = F.when(kind == "signup", "workflow_dispatch").when(kind == "error", "push").otherwise("schedule")
    return t.table(spark, sf_dir, "events").select(
        "event_id", dates.should_run(trigger, F.col("ts").cast("timestamp")).alias("runs")
    )


# ------------------------------------------------------------------ keys
_BARE = f"{t.ns(f'''regexp_replace(regexp_replace(lower(title), '{fv.TITLE_BRACKETS_PATTERN}', ' ', 'g'), '{fv.TITLE_TERMS_PATTERN}', ' ', 'g')''')}"


@query(
    "notice_keys",
    t.with_sql(
        f"""SELECT seq, sha256(array_to_string([title, body_text] || list_sort(attachment_urls) || ['z', 'zz'], chr(10))) AS content_fingerprint,
        sha1(university_name || '::' || title) AS title_key,
        {_BARE.replace("title", "v_notice.title")} AS bare_title,
        url || array_to_string(attachment_urls, '|') AS dedupe_key,
        sha256('chat' || chr(10) || 'report:' || seq::VARCHAR) AS delivery_id FROM v_notice""",
        t.NOTICES_SQL,
    ),
)
def notice_keys(spark, sf_dir):
    rows = t.notices(spark, sf_dir)
    images = F.array(F.lit("zz"), F.lit("z"))
    return rows.select(
        "seq",
        hashing.content_fingerprint(F.col("title"), F.col("body_text"), F.col("attachment_urls"), images).alias(
            "content_fingerprint"
        ),
        hashing.title_key(F.col("university_name"), F.col("title")).alias("title_key"),
        hashing.normalized_title(F.col("title")).alias("bare_title"),
        hashing.notice_key(F.col("url"), F.col("university_name"), F.col("title"), F.col("attachment_urls")).alias(
            "dedupe_key"
        ),
        hashing.delivery_id(F.lit("chat"), F.concat(F.lit("report:"), F.col("seq").cast("string"))).alias(
            "delivery_id"
        ),
    )


CANDIDATE_KEY_SQL = (
    "'{ns}-candidate:' || sha256(array_to_string(['{ns}', url, content_fingerprint, change_type, grade, deadline_status, "
    "{date}, title, array_to_string(list_sort(attachment_urls), '|')], chr(10)))"
)


@query(
    "delivery_keys",
    t.with_sql(
        f"""SELECT seq, {CANDIDATE_KEY_SQL.format(ns="course", date="notice_date")} AS course_key,
        {CANDIDATE_KEY_SQL.format(ns="graduate-portal", date="''")} AS portal_key FROM v_item""",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL,
    ),
)
def delivery_keys(spark, sf_dir):
    from pagewatch.operators.reports import delivery_key

    rows = t.items(spark, sf_dir)
    return rows.select(
        "seq",
        delivery_key(rows, "course").alias("course_key"),
        delivery_key(rows, "graduate-portal").alias("portal_key"),
    )


@query(
    "deduped_notices",
    t.with_sql(
        """SELECT min(seq) AS seq, arg_min(title, seq) AS title, url, arg_min(notice_date, seq) AS notice_date
        FROM v_notice GROUP BY url, array_to_string(attachment_urls, '|')""",
        t.NOTICES_SQL,
    ),
)
def deduped_notices(spark, sf_dir):
    return dedupe.dedupe_notices(t.notices(spark, sf_dir)).select("seq", "title", "url", "notice_date")


GRADUATE_PRINT_SQL = (
    "sha1(array_to_string([university_name, board_type, {bare}, CASE WHEN contains(board_type, '어플라이') THEN '' ELSE notice_date END, "
    "array_to_string(list_sort(matched_keywords), '|'), array_to_string(list_sort(attachment_urls), '|')], '::'))"
).format(bare=_BARE)


@query(
    "deduped_graduate_notices",
    t.with_sql(
        f"""SELECT fp, min(seq) AS seq, arg_min(title, seq) AS title FROM (
          SELECT *, {GRADUATE_PRINT_SQL} AS fp FROM (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN '유웨이어플라이' ELSE board_type END AS board_type,
             university_name || ' ' || grade AS title) FROM v_graded)) GROUP BY fp""",
        t.NOTICES_SQL, t.SCORED_SQL,
    ),
)
def deduped_graduate_notices(spark, sf_dir):
    rows = t.graded(spark, sf_dir).withColumns(
        {
            "board_type": F.when(F.col("seq") % 3 == 0, "유웨이어플라이").otherwise(F.col("board_type")),
            "title": F.concat_ws(" ", "university_name", "grade"),
        }
    )
    print_ = dedupe.item_fingerprint(rows)
    # graded once, into narrow rows that the dedupe reads twice
    kept = dedupe.first_per_key(stored(rows.select(print_.alias("fp"), "seq", "title")), F.col("fp"))
    return kept.select("fp", "seq", "title")


_HISTORY = ", ".join(fv.HISTORY_FIELDS)


@query(
    "merged_history",
    t.with_sql(
        f"""SELECT {_HISTORY} FROM (
          SELECT *, row_number() OVER (PARTITION BY k ORDER BY side DESC, university_name DESC, region DESC, semester DESC,
             notice_date DESC, application_start_date DESC, application_end_date DESC, url DESC, title DESC, source DESC) AS rn
          FROM (SELECT *, CASE WHEN trim(url) <> '' THEN 'u' || trim(url) WHEN trim(title) <> '' THEN 't' || trim(university_name) || chr(31) || trim(title)
                  ELSE 'r' || concat_ws(chr(31), {_HISTORY}) END AS k FROM (
            SELECT 0 AS side, university_name, 'old' AS region, '' AS semester, notice_date, '' AS application_start_date,
              '' AS application_end_date, CASE WHEN seq % 2 = 0 THEN url ELSE '' END AS url, title, 'x' AS source FROM v_notice
            UNION ALL SELECT 1, university_name, '', CASE WHEN contains(title, '2학기') THEN '2학기' WHEN contains(title, '1학기') THEN '1학기' ELSE '' END,
              notice_date, application_start_date, application_end_date, CASE WHEN seq % 2 = 0 THEN url ELSE '' END, title, 'board'
              FROM v_graded WHERE registration_score >= 40))) WHERE rn = 1""",
        t.NOTICES_SQL, t.SCORED_SQL,
    ),
)
def merged_history(spark, sf_dir):
    some_url = F.when(F.col("seq") % 2 == 0, F.col("url")).otherwise("")
    old = t.notices(spark, sf_dir).select(
        "university_name", F.lit("old").alias("region"), F.lit("").alias("semester"), "notice_date",
        F.lit("").alias("application_start_date"), F.lit("").alias("application_end_date"),
        some_url.alias("url"), "title", F.lit("x").alias("source"),
    )
    now = t.graded(spark, sf_dir).withColumns({"url": some_url, "region": F.lit(""), "source_type": F.lit("board")})
    return dedupe.merge_history(old, dedupe.history_rows(now))
