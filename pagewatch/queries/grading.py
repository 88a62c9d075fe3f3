"""Scores, grades, row predicates and reports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch import fixed_values as fv
from pagewatch.durable import stored
from pagewatch.functions import rules, text, urls
from pagewatch.functions.scoring import Vocabulary, Word, keyword_hits_long, with_classification
from pagewatch.operators import dedupe, portals, reports
from pagewatch.plans.course_watch import demoted
from pagewatch.plans.graduate_watch import rule_graded
from pagewatch.queries import tables as t
from pagewatch.queries.registry import query
from pagewatch.queries.texts import CANDIDATE_KEY_SQL, GRADUATE_PRINT_SQL

_WORD_ROWS = ", ".join(
    f"('{group.split('_')[0]}', '{group.split('_')[1]}', '{w}', {p})"
    for group, words in t.WORDS.items()
    for w, p in words.items()
)


@query(
    "keyword_hits",
    t.with_sql(
        f"""SELECT seq, family, polarity, word, points FROM v_notice
        JOIN (VALUES {_WORD_ROWS}) w(family, polarity, word, points)
        ON contains(lower(title || chr(10) || body_text), lower(word))""",
        t.NOTICES_SQL,
    ),
)
def keyword_hits(spark, sf_dir):
    haystack = F.concat("title", F.lit("\n"), "body_text")
    return keyword_hits_long(t.notices(spark, sf_dir), t.VOCABULARY, "seq", haystack).drop("ord")


@query(
    "keyword_scores",
    t.with_sql(
        """SELECT seq, registration_score, external_score, computer_score, freshness_score,
        external_applicant_status, computer_course_status, array_to_string(matched_keywords, ',') AS matched FROM v_graded""",
        t.NOTICES_SQL, t.SCORED_SQL,
    ),
)
def keyword_scores(spark, sf_dir):
    return t.graded(spark, sf_dir).select(
        "seq", "registration_score", "external_score", "computer_score", "freshness_score",
        "external_applicant_status", "computer_course_status", F.array_join("matched_keywords", ",").alias("matched"),
    )


#: A vocabulary as large as a user's own may be: the most frequent words of the documents.
MANY_WORDS = 2_000
_MANY_SQL = f"""v_count AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM documents) GROUP BY word),
v_rank AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM v_count ORDER BY r LIMIT {MANY_WORDS}),
v_words AS (SELECT word, r, ['registration', 'external', 'computer'][r % 3 + 1] AS family,
  CASE WHEN r % 5 = 0 THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN r % 5 = 0 THEN -(r % 7) - 1 ELSE r % 7 + 1 END AS points FROM v_rank),
v_hits AS (SELECT doc_id, w.* FROM documents JOIN v_words w ON contains(lower(text), word)),
v_wins AS (SELECT *, family = 'computer' AND polarity = 'negative' AND bool_or(family = 'computer' AND polarity = 'positive')
  OVER (PARTITION BY doc_id) AS overruled FROM v_hits)"""


def many_words(docs) -> Vocabulary:
    """At most ``MANY_WORDS`` words with made-up families and points; a configuration, so it is read to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(MANY_WORDS).collect()
    found = []
    for place, row in enumerate(top):
        negative, points = place % 5 == 0, place % 7 + 1
        family = ("registration", "external", "computer")[place % 3]
        found.append(Word(family, "negative" if negative else "positive", row["word"], -points if negative else points))
    return Vocabulary(tuple(found))


@query("large_vocabulary_hits", f"WITH {_MANY_SQL} SELECT word, family, polarity, points, count(*) AS n_docs, sum(doc_id) AS ids FROM v_hits GROUP BY ALL")
def large_vocabulary_hits(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    hits = keyword_hits_long(docs, many_words(docs), "doc_id", F.col("text"))
    return hits.groupBy("word", "family", "polarity", "points").agg(
        F.count("*").alias("n_docs"), F.sum("doc_id").alias("ids")
    )


@query(
    "large_vocabulary_scores",
    f"""WITH {_MANY_SQL} SELECT doc_id, coalesce(sum(points) FILTER (family = 'registration'), 0) AS registration_score,
    coalesce(sum(points) FILTER (family = 'external'), 0) AS external_score,
    coalesce(sum(points) FILTER (family = 'computer' AND NOT overruled), 0) AS computer_score,
    coalesce(string_agg(word, ',' ORDER BY list_position(['registration', 'external', 'computer'], family), polarity DESC, r)
      FILTER (NOT overruled), '') AS matched
    FROM documents LEFT JOIN v_wins USING (doc_id) GROUP BY doc_id""",
)
def large_vocabulary_scores(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", F.lit("").alias("title"), "text", F.lit(fv.STATUS_UNRELATED).alias("deadline_status"))
    scored = with_classification(texts, many_words(docs), exclusion_terms=())
    return scored.select(
        "doc_id", "registration_score", "external_score", "computer_score", F.array_join("matched_keywords", ",").alias("matched")
    )


_WEAK = "grade = 'C' AND NOT (" + " OR ".join(f"contains(lower(title), '{w}')" for w in fv.WEAK_TITLE_WORDS) + ")"
_REASON_SQL = f"""CASE grade WHEN 'A' THEN printf('{fv.REASON_A}', deadline_status) WHEN 'B' THEN printf('{fv.REASON_B}', deadline_status)
  WHEN 'C' THEN printf('{fv.REASON_C}', registration_score, external_applicant_status, computer_course_status) ELSE '{fv.REASON_D}' END"""


@query(
    "graded_notices",
    t.with_sql(f"SELECT seq, excluded, grade, {_REASON_SQL} AS reason FROM v_graded", t.NOTICES_SQL, t.SCORED_SQL),
)
def graded_notices(spark, sf_dir):
    rows = t.graded(spark, sf_dir)
    excluded = text.contains_any(F.concat("title", F.lit("\n"), "body_text"), t.EXCLUDED)
    return rows.select("seq", excluded.alias("excluded"), "grade", "reason")


_MARKED = "CASE WHEN seq % 4 = 0 THEN title || ' 시간제' ELSE title END"
DEMOTED_SQL = f"""
v_marked AS (SELECT * REPLACE ({_MARKED} AS title), {_REASON_SQL} AS reason FROM v_graded),
v_demoted AS (SELECT * REPLACE (CASE WHEN {_WEAK} THEN 'D' ELSE grade END AS grade,
    CASE WHEN {_WEAK} THEN '{fv.REASON_WEAK_C}' ELSE reason END AS reason) FROM v_marked)
"""


def _demoted(spark, sf_dir):
    title = F.when(F.col("seq") % 4 == 0, F.concat("title", F.lit(" 시간제"))).otherwise(F.col("title"))
    return demoted(t.graded(spark, sf_dir).withColumn("title", title))


@query(
    "weak_candidates",
    t.with_sql("SELECT seq, grade, reason FROM v_demoted", t.NOTICES_SQL, t.SCORED_SQL, DEMOTED_SQL),
)
def weak_candidates(spark, sf_dir):
    return _demoted(spark, sf_dir).select("seq", "grade", "reason")


@query(
    "grade_counts",
    t.with_sql(
        """SELECT grade, count(*) AS n FROM (SELECT arg_min(grade, seq) AS grade FROM v_demoted
        GROUP BY url, array_to_string(attachment_urls, '|')) GROUP BY grade""",
        t.NOTICES_SQL, t.SCORED_SQL, DEMOTED_SQL,
    ),
)
def grade_counts(spark, sf_dir):
    """The flagship: score, grade, demote, dedupe, count."""
    return reports.counts_by(dedupe.dedupe_notices(_demoted(spark, sf_dir)), "grade")


@query(
    "counts_by_board",
    """SELECT CASE WHEN key = '' THEN 'unknown' ELSE key END AS key, count(*) AS n
    FROM (SELECT CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS key FROM events) GROUP BY 1""",
)
def counts_by_board(spark, sf_dir):
    kind = F.col("event_type")
    rows = t.table(spark, sf_dir, "events").select(F.when(kind == "error", "").otherwise(kind).alias("key"))
    return reports.counts_by(rows, "key")


# Rules of the graduate mode, with words that occur in the driver's prose.
GRADUATE = rules.GraduateWords(
    years=("tion", "und"), schools=("ent", "en"), general="that", admissions=("ing", "eau", "en"),
    title_admissions=("e", "ing"), negatives=("les", "sch"), excluded_titles=("xx", "aux"), terms=("en", "th", "er"),
)


def _has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _found(column: str, words) -> str:
    return ", ".join(f"CASE WHEN contains({column}, '{w}') THEN '{w}' END" for w in words)


GRADUATE_SQL = f"""
v_texts AS (SELECT seq, seq % 9 = 0 AS is_direct, lower({t.ns("title")}) AS lt, lower({t.ns("title || chr(10) || body_text")}) AS lx FROM v_notice),
v_rule AS (SELECT *, CASE WHEN {_has("lt", GRADUATE.excluded_titles)} THEN 'excluded'
    WHEN NOT is_direct AND NOT ({_has("lt", GRADUATE.years)} AND {_has("lt", GRADUATE.title_admissions)}) THEN 'title'
    WHEN {_has("lx", GRADUATE.negatives)} AND NOT contains(lx, 'that') THEN 'negative'
    WHEN ({_has("lt", GRADUATE.years)} OR {_has("lx", GRADUATE.years)}) AND contains(lx, 'that') AND {_has("lx", GRADUATE.admissions)} THEN 'general'
    WHEN ({_has("lt", GRADUATE.years)} OR {_has("lx", GRADUATE.years)}) AND {_has("lx", GRADUATE.schools)} AND {_has("lx", GRADUATE.admissions)} THEN 'school'
    ELSE 'none' END AS rule FROM v_texts)
"""


@query(
    "graduate_grades",
    t.with_sql(
        f"""SELECT seq, CASE rule WHEN 'general' THEN 'A' WHEN 'school' THEN 'B' ELSE 'D' END AS grade,
        CASE rule {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.GRADUATE_REASONS.items())} END AS reason,
        CASE WHEN rule = 'excluded' THEN '' ELSE array_to_string(list_filter([{_found("lt", GRADUATE.years)}, {_found("lx", GRADUATE.schools)},
          {_found("lx", GRADUATE.admissions)}, {_found("lx", GRADUATE.negatives)}, {_found("lt", GRADUATE.terms)}], lambda w: w IS NOT NULL), ',') END AS matched
        FROM v_rule""",
        t.NOTICES_SQL, GRADUATE_SQL,
    ),
)
def graduate_grades(spark, sf_dir):
    rows = t.notices(spark, sf_dir).withColumn("is_direct", F.col("seq") % 9 == 0)
    graded = rule_graded(rows, F.col("body_text"), GRADUATE)
    return graded.select("seq", "grade", "reason", F.array_join("matched_keywords", ",").alias("matched"))


_PORTAL_NAMES = ("한국대학교 일반대학원 ", "서울대 대학원 ", "계약학과 일반대학원 ", "부산대 학부 ", "글로벌 MBA 대학원 ")


@query(
    "portal_rows",
    f"""WITH v AS (SELECT p_partkey AS seq, CASE p_partkey % 5 {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_PORTAL_NAMES))} END || p_name AS title FROM part),
    g AS (SELECT seq, title, CASE WHEN {" OR ".join(f"contains(lower(title), '{w.lower()}')" for w in fv.PORTAL_NEGATIVE_WORDS)} THEN 'D'
      WHEN contains(title, '일반대학원') THEN 'A' WHEN contains(title, '대학원') THEN 'B' ELSE 'D' END AS grade FROM v)
    SELECT seq, title, string_split(title, ' ')[1] AS university_name, grade, '{t.AS_OF_TEXT}' AS notice_date,
      '대학원,진학사어플라이' AS matched, '{fv.PORTAL_API_BOARD}' AS board_type FROM g WHERE grade <> 'D'""",
)
def portal_rows(spark, sf_dir):
    key = F.col("p_partkey")
    prefix = F.lit(None).cast("string")
    for number, name in enumerate(_PORTAL_NAMES):
        prefix = F.when(key % 5 == number, name).otherwise(prefix)
    services = t.table(spark, sf_dir, "part").select(
        key.alias("seq"), prefix.alias("ShortName"), F.col("p_name").alias("ServiceName"),
        F.lit("대학원").alias("CategorytypeName"), F.lit("").alias("Link"), F.lit("").alias("WriteFromTime"),
        F.lit("").alias("WriteToTime"),
    )
    rows = portals.api_portal(services, t.as_of(), F.lit(t.CHECKED_AT))
    return rows.select(
        "seq", "title", "university_name", "grade", "notice_date",
        F.array_join("matched_keywords", ",").alias("matched"), "board_type",
    )


@query(
    "alert_targets",
    t.with_sql(
        f"""SELECT seq, {t.CHANGED_SQL} AS changed, {t.TARGET_SQL} AS target,
        is_new AND grade IN ('A','B') AND {t.recent_sql()} AS graduate_target, contains(board_type, '어플라이') AS portal FROM v_item""",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL,
    ),
)
def alert_targets(spark, sf_dir):
    c = F.col
    target = rules.is_alert_target(
        c("change_type"), c("is_new"), c("grade"), c("deadline_status"), c("notice_date"), t.as_of()
    )
    return t.items(spark, sf_dir).select(
        "seq",
        rules.is_changed(c("change_type"), c("is_new")).alias("changed"),
        target.alias("target"),
        rules.is_graduate_target(c("is_new"), c("grade"), c("notice_date"), t.as_of()).alias("graduate_target"),
        rules.is_portal_row(c("board_type")).alias("portal"),
    )


@query(
    "stage_gates",
    t.with_sql(
        f"""SELECT seq, grade IN ('A','B','C') OR {_has("lower(title)", fv.ATTACHMENT_TITLE_WORDS)} AS parses_attachments,
        grade IN ('A','B') AND len(attachment_urls) > 0 AS reads_images FROM v_marked""",
        t.NOTICES_SQL, t.SCORED_SQL, DEMOTED_SQL,
    ),
)
def stage_gates(spark, sf_dir):
    title = F.when(F.col("seq") % 4 == 0, F.concat("title", F.lit(" 시간제"))).otherwise(F.col("title"))
    return t.graded(spark, sf_dir).select(
        "seq",
        rules.parses_attachments(title, F.col("grade")).alias("parses_attachments"),
        rules.reads_images(F.col("grade"), F.col("attachment_urls")).alias("reads_images"),
    )


@query(
    "at_least_grade_b",
    t.with_sql("SELECT seq, grade FROM v_graded WHERE grade IN ('A', 'B')", t.NOTICES_SQL, t.SCORED_SQL),
)
def at_least_grade_b(spark, sf_dir):
    return t.graded(spark, sf_dir).where(rules.at_least(F.col("grade"), "B")).select("seq", "grade")


# --------------------------------------------------------------- reports
_STATUS_COUNTS = "'" + "','".join(fv.REPORT_STATUS_ORDER) + "'"


@query(
    "run_summary",
    t.with_sql(
        f"""SELECT count(*) AS deduped_count, count(*) FILTER (grade <> 'D') AS public_count, count(*) FILTER ({t.TARGET_SQL}) AS candidate_count,
        (SELECT string_agg(grade || ':' || n, ', ' ORDER BY grade) FROM (SELECT grade, count(*) AS n FROM v_item GROUP BY 1)) AS grades,
        (SELECT string_agg(deadline_status || ':' || n, ', ' ORDER BY deadline_status) FROM (SELECT deadline_status, count(*) AS n FROM v_item GROUP BY 1)) AS statuses,
        '{t.CHECKED_AT}' AS checked_at FROM v_item""",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL,
    ),
)
def run_summary(spark, sf_dir):
    row = reports.run_summary(t.items(spark, sf_dir), t.as_of(), checked_at=F.lit(t.CHECKED_AT))

    def line(name: str):
        entries = F.transform(F.map_entries(name), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
        return F.array_join(F.sort_array(entries), ", ")

    return row.select(
        "deduped_count", "public_count", "candidate_count", line("grade_counts").alias("grades"),
        line("status_counts").alias("statuses"), "checked_at",
    )


@query(
    "report_header",
    t.with_sql(
        """SELECT count(*) AS total, count(*) FILTER (grade = 'A') AS grade_a, count(*) FILTER (grade = 'B') AS grade_b,
        count(*) FILTER (is_new) AS new FROM v_item""",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL,
    ),
)
def report_header(spark, sf_dir):
    return reports.report_header(t.items(spark, sf_dir))


_RANK_SQL = "CASE grade WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END"
_STATUS_SQL = (
    "CASE deadline_status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(fv.REPORT_STATUS_ORDER)) + " ELSE 9 END"
)


@query(
    "report_preview",
    t.with_sql(
        f"""SELECT seq, grade, university_name, title, url, change_type, is_new FROM v_item
        WHERE grade IN ('A','B') AND ({t.CHANGED_SQL}) AND {t.recent_sql()} ORDER BY {_RANK_SQL}, seq LIMIT 5""",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL,
    ),
)
def report_preview(spark, sf_dir):
    return reports.preview(t.items(spark, sf_dir), t.as_of()).select(
        "seq", "grade", "university_name", "title", "url", "change_type", "is_new"
    )


@query(
    "course_report",
    t.with_sql(
        f"""SELECT row_number() OVER (ORDER BY {_RANK_SQL}, {_STATUS_SQL}, university_name, seq) - 1 AS line, seq FROM v_item WHERE grade <> 'D'""",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL,
    ),
)
def course_report(spark, sf_dir):
    return _numbered(reports.course_report(_report_items(spark, sf_dir)))


@query(
    "graduate_report",
    t.with_sql(
        f"SELECT row_number() OVER (ORDER BY {_RANK_SQL}, university_name, title, seq) - 1 AS line, seq FROM v_item",
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL,
    ),
)
def graduate_report(spark, sf_dir):
    return _numbered(reports.graduate_report(_report_items(spark, sf_dir)))


def _report_items(spark, sf_dir):
    """What the reports order by, graded once: sorting reads its input twice."""
    return stored(t.items(spark, sf_dir).select("seq", "grade", "deadline_status", "university_name", "title"))


def _numbered(ordered):
    """Line numbers of an already sorted frame: partition offsets plus the place in the partition."""
    from pagewatch.operators.ordering import drop_layout, with_position

    rows = ordered.select("seq", F.monotonically_increasing_id().alias("_at"))
    layout = stored(rows).withColumn("_range", F.shiftright("_at", 33))
    placed = drop_layout(with_position(layout))
    return placed.select((F.col("position") - 1).alias("line"), "seq")


@query(
    "portal_digests",
    t.with_sql(
        """SELECT batch, count(*) AS n, 'graduate-portal:' || sha256(string_agg(k, chr(10) ORDER BY k, seq)) AS digest_key
        FROM (SELECT k, seq, (row_number() OVER (ORDER BY k, seq) - 1) // 25 AS batch FROM (
            SELECT seq, %s AS k FROM v_item WHERE grade IN ('A','B','C'))) GROUP BY batch"""
        % CANDIDATE_KEY_SQL.format(ns="graduate-portal", date="''"),
        t.NOTICES_SQL, t.SCORED_SQL, t.ITEMS_SQL,
    ),
)
def portal_digests(spark, sf_dir):
    rows = reports.portal_digests(t.items(spark, sf_dir).where(F.col("grade") != "D"))
    return rows.select("batch", F.size("items").cast("bigint").alias("n"), "digest_key")


@query(
    "empty_summary",
    t.with_sql(
        f"""SELECT sha1(concat_ws('::', '17', '4', count(*), coalesce(sum(('0x' || substr(fp, 1, 13))::BIGINT), 0),
          coalesce(sum(('0x' || substr(fp, 14, 13))::BIGINT), 0), coalesce(sum(('0x' || substr(fp, 27, 14))::BIGINT), 0))) AS fingerprint, count(*) AS candidate_count,
        17 AS active_count, 4 AS disabled_count, true AS send FROM (
          SELECT {GRADUATE_PRINT_SQL} AS fp FROM v_graded WHERE grade IN ('A', 'B'))""",
        t.NOTICES_SQL, t.SCORED_SQL,
    ),
)
def empty_summary(spark, sf_dir):
    rows = t.graded(spark, sf_dir).where(F.col("grade").isin("A", "B"))
    current = reports.set_fingerprint(rows, 17, 4)
    stored = reports.set_fingerprint(rows, 16, 5)
    return reports.sends_empty_summary(current, stored)


# ------------------------------------------------------------------ urls
_URL_TAILS = (
    "view.do;jsessionid=ABC123?key=1&nttNo=%s#top", "a/b;x=1?p=%s", "redirect?url=%%2Fmenu%%2F%s", "page?q=%s#frag",
    "redirect?url=https%%3A%%2F%%2Fother.example.org%%2Fa%%3Fb%%3D%s", "plain/%s",
)


@query(
    "canonical_urls",
    f"""SELECT o_orderkey, CASE o_orderkey % 6
      WHEN 0 THEN 'https://h.example.com/view.do?key=1&nttNo=' || o_orderkey WHEN 1 THEN 'https://h.example.com/a/b?p=' || o_orderkey
      WHEN 2 THEN 'https://h.example.com/menu/' || o_orderkey WHEN 3 THEN 'https://h.example.com/page?q=' || o_orderkey
      WHEN 4 THEN 'https://other.example.org/a?b=' || o_orderkey ELSE 'https://h.example.com/plain/' || o_orderkey END AS url FROM orders""",
)
def canonical_urls(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = F.lit(None).cast("string")
    for number, tail in enumerate(_URL_TAILS):
        raw = F.when(key % 6 == number, F.format_string("https://h.example.com/" + tail, key.cast("string"))).otherwise(raw)
    return t.table(spark, sf_dir, "orders").select("o_orderkey", urls.canonical_url(raw).alias("url"))


def _ipv4(column: str) -> str:
    return f"({column} // 16777216 % 256)::VARCHAR || '.' || ({column} // 65536 % 256)::VARCHAR || '.' || ({column} // 256 % 256)::VARCHAR || '.' || ({column} % 256)::VARCHAR"


def _number(dotted: str) -> int:
    return urls._ipv4_number(dotted)


_PRIVATE = " OR ".join(f"n BETWEEN {_number(a)} AND {_number(b)}" for a, b in fv.PRIVATE_IPV4)


@query(
    "public_urls",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, (l_partkey * 2654435761 + l_suppkey * 40503 + l_orderkey * 7919) % 4294967296 AS h,
       l_linenumber % 7 AS k FROM lineitem),
    w AS (SELECT *, CASE WHEN k = 0 THEN 167772160 + h % 16777216 WHEN k = 1 THEN 3232235520 + h % 65536 ELSE h END AS n FROM v),
    u AS (SELECT *, CASE k WHEN 2 THEN 'ftp://' WHEN 3 THEN 'https://user@' ELSE 'http://' END
       || CASE k WHEN 4 THEN 'a.localhost:80' WHEN 5 THEN 'board.example.com:8080' ELSE {_ipv4("n")} END || '/p' AS url FROM w)
    SELECT l_orderkey, l_linenumber, url, CASE WHEN k IN (2, 3, 4) THEN false WHEN k = 5 THEN true ELSE NOT ({_PRIVATE}) END AS public FROM u""",
)
def public_urls(spark, sf_dir):
    line = t.table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 7
    h = (F.col("l_partkey") * 2654435761 + F.col("l_suppkey") * 40503 + F.col("l_orderkey") * 7919) % 4294967296
    n = F.when(k == 0, F.lit(167772160) + h % 16777216).when(k == 1, F.lit(3232235520) + h % 65536).otherwise(h)
    dotted = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    host = F.when(k == 4, "a.localhost:80").when(k == 5, "board.example.com:8080").otherwise(dotted)
    scheme = F.when(k == 2, "ftp://").when(k == 3, "https://user@").otherwise("http://")
    rows = line.select("l_orderkey", "l_linenumber", F.concat(scheme, host, F.lit("/p")).alias("url"))
    return rows.withColumn("public", urls.is_public_http_url(F.col("url")))


_SUFFIXES = (".hwpx", ".hwp", ".docx", ".pdf?x=.zip", "", ";v=1.xls")


@query(
    "file_types",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.hwpx' WHEN 1 THEN '.hwp' WHEN 2 THEN '.docx' WHEN 3 THEN '.pdf'
       ELSE CASE WHEN p_size % 3 = 0 THEN '.xlsx' WHEN p_size % 3 = 1 THEN '.hwp' ELSE '' END END AS suffix FROM part""",
)
def file_types(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    tail = F.lit(None).cast("string")
    for number, suffix in enumerate(_SUFFIXES):
        tail = F.when(key % 6 == number, suffix).otherwise(tail)
    url = F.concat(F.lit("https://files.example.com/f"), key.cast("string"), tail)
    disposition = F.when(size % 3 == 0, "attachment; filename=\"plan.xlsx\"").otherwise("inline")
    mime = F.when(size % 3 == 1, "Application/X-HWP; charset=utf-8").otherwise("text/html")
    return t.table(spark, sf_dir, "part").select("p_partkey", urls.detect_suffix(url, disposition, mime).alias("suffix"))
