"""Page, link, course and attachment operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch import fixed_values as fv
from pagewatch.durable import stored
from pagewatch.functions.urls import looks_like_notice
from pagewatch.operators import attachments, courses, details, links, page_parse
from pagewatch.queries import tables as t
from pagewatch.queries.registry import query
from pagewatch.sources.pages import read_pages

HINT = "th"


def _parsed(spark, sf_dir):
    return page_parse.parse_pages(read_pages(spark, f"{sf_dir}/pages.parquet"))


LINKS_SQL = r"""
v_anchor AS (SELECT page_id, url AS page_url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root,
    unnest(hits) AS hit, generate_subscripts(hits, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS hits FROM pages)),
v_part AS (SELECT page_id, page_url, root, pos, regexp_extract(hit, 'href="([^"]*)"', 1) AS href,
    trim(replace(regexp_extract(hit, '>([^<]*)<', 1), '&amp;', '&')) AS title FROM v_anchor),
v_link AS (SELECT *, CASE WHEN href LIKE '/%' THEN root || href ELSE href END AS url FROM v_part)
"""
_NOISE = " OR ".join(f"contains(lower(title), '{w}')" for w in fv.LINK_NOISE_WORDS)
_FILES = " OR ".join(f"contains(lower(url), '{w}')" for w in fv.FILE_SUFFIXES)
_MENU = ", ".join(f"'{m}'" for m in fv.MENU_TITLES)
_PASSES = f"""(length(title) BETWEEN 3 AND 180 AND url <> page_url AND lower(title) NOT IN ({_MENU})
  AND (contains(lower(title), '{HINT}') OR {" OR ".join(f"contains(lower(title), '{w}')" for w in fv.LINK_TARGET_WORDS)}
       OR regexp_matches(lower(url), '{fv.DETAIL_URL_PATTERN}'))
  AND NOT ({_FILES}) AND NOT ({_NOISE}) AND NOT regexp_matches(lower(url), '{fv.RSS_PATTERN}')
  AND (contains(lower(title), '{HINT}') OR (NOT regexp_matches(lower(title), '{fv.FILE_TITLE_PATTERN}')
       AND regexp_matches(lower(url) || ' ' || title, '{fv.NOTICE_PATTERN}'))))"""


@query(
    "candidate_links",
    t.with_sql(
        f"""SELECT page_id, min(pos) AS pos, arg_min(title, pos) AS title, url, '' AS notice_date
        FROM v_link WHERE {_PASSES} GROUP BY page_id, url""",
        LINKS_SQL,
    ),
)
def candidate_links(spark, sf_dir):
    found = links.candidate_links(_parsed(spark, sf_dir), "page_id", HINT)
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "title", "url", "notice_date")


_TEST_TITLES = ("공지 %s", "로그인 %s", "모집요강 %s.pdf", "2026 th 안내 %s", "x", "수강 신청 %s")
_TEST_PATHS = ("/bbs/%s/view.do", "/page/%s", "/article?articleNo=%s", "/rss/%s", "/file%s.zip", "/")
_NEAR = "https://h.example.com"


@query(
    "notice_link_tests",
    t.with_sql(
        f"SELECT l_orderkey, l_linenumber, title, url, {_PASSES.replace('url <> page_url', 'same = 0')} AND NOT far AS accepted FROM v_try",
        f"""v_try AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 = 0 AS far,
          CASE l_partkey % 6
            {" ".join(f"WHEN {i} THEN printf('{x}', l_partkey::VARCHAR)" if "%s" in x else f"WHEN {i} THEN '{x}'" for i, x in enumerate(_TEST_TITLES))} END AS title,
          CASE WHEN l_suppkey % 5 = 0 THEN 'https://far.example.org' ELSE '{_NEAR}' END || CASE l_orderkey % 6
            {" ".join(f"WHEN {i} THEN printf('{x}', l_partkey::VARCHAR)" if "%s" in x else f"WHEN {i} THEN '{x}'" for i, x in enumerate(_TEST_PATHS))} END AS url,
          CASE WHEN l_orderkey % 6 = 5 AND l_suppkey % 5 <> 0 THEN 1 ELSE 0 END AS same FROM lineitem)""",
    ),
)
def notice_link_tests(spark, sf_dir):
    def pick(key, texts):
        out = F.lit(None).cast("string")
        for number, pattern in enumerate(texts):
            value = F.format_string(pattern, F.col("l_partkey").cast("string")) if "%s" in pattern else F.lit(pattern)
            out = F.when(F.col(key) % 6 == number, value).otherwise(out)
        return out

    host = F.when(F.col("l_suppkey") % 5 == 0, "https://far.example.org").otherwise(_NEAR)
    rows = t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", pick("l_partkey", _TEST_TITLES).alias("title"),
        F.concat(host, pick("l_orderkey", _TEST_PATHS)).alias("url"),
    )
    accepted = looks_like_notice(F.col("title"), F.col("url"), F.lit(_NEAR + "/"), HINT)
    return rows.withColumn("accepted", accepted)


CANDIDATES_SQL = """
v_candidate AS (SELECT l_suppkey AS board_idx, l_orderkey * 10 + l_linenumber AS pos,
   'https://h.example.com/' || l_partkey::VARCHAR AS url,
   CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS notice_date
   FROM (SELECT DISTINCT ON (l_suppkey, l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate))
"""
_CANDIDATE_ORDER = "PARTITION BY board_idx ORDER BY notice_date = '', notice_date DESC, pos"
_CUTOFF = "1998-06-08"


def _candidates(spark, sf_dir):
    line = t.table(spark, sf_dir, "lineitem")
    one = line.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_shipdate")).alias("r")
    )
    return one.select(
        F.col("l_suppkey").alias("board_idx"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat(F.lit("https://h.example.com/"), F.col("r.l_partkey").cast("string")).alias("url"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.date_format("r.l_shipdate", "yyyy-MM-dd")).alias(
            "notice_date"
        ),
    )


@query(
    "ordered_candidates",
    t.with_sql(
        f"SELECT board_idx, pos, row_number() OVER ({_CANDIDATE_ORDER}) AS board_rank FROM v_candidate", CANDIDATES_SQL
    ),
)
def ordered_candidates(spark, sf_dir):
    return links.ordered_candidates(_candidates(spark, sf_dir)).select("board_idx", "pos", "board_rank")


@query(
    "crawl_frontier",
    t.with_sql(
        f"""SELECT board_idx, pos, board_rank, row_number() OVER (ORDER BY board_rank, board_idx) - 1 AS turn FROM (
          SELECT board_idx, pos, row_number() OVER ({_CANDIDATE_ORDER}) AS board_rank FROM v_candidate
          WHERE (notice_date = '' OR notice_date >= '{_CUTOFF}')
            AND url NOT IN (SELECT 'https://h.example.com/' || p_partkey::VARCHAR FROM part WHERE p_size < 10))
        WHERE board_rank <= {fv.LINKS_PER_BOARD}""",
        CANDIDATES_SQL,
    ),
)
def crawl_frontier(spark, sf_dir):
    from pagewatch.operators.ordering import drop_layout, sorted_ranges, with_position

    seen = t.table(spark, sf_dir, "part").where("p_size < 10").select(
        F.concat(F.lit("https://h.example.com/"), F.col("p_partkey").cast("string")).alias("key")
    )
    as_of = F.lit("1998-06-15").cast("date")
    fresh = links.not_yet_handled(_candidates(spark, sf_dir), seen, as_of, 7)
    frontier = links.capped_frontier(fresh).select(
        "board_idx", "pos", F.col("board_rank").cast("bigint").alias("board_rank")
    )
    turns = with_position(sorted_ranges(frontier, [], ["board_rank", "board_idx"]))
    return drop_layout(turns).withColumn("turn", F.col("position") - 1).drop("position")


_TEXT_SQL = """
v_plain AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS bare FROM pages),
v_body AS (SELECT page_id, regexp_replace(bare, '(?is)<(nav|header|footer)[^>]*>.*?</(nav|header|footer)>', ' ', 'g') AS body, bare FROM v_plain)
"""


def _unescaped(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _visible(column: str) -> str:
    return t.ns(_unescaped(f"regexp_replace({column}, '<[^>]*>', ' ', 'g')"))


@query(
    "page_texts",
    t.with_sql(
        f"SELECT page_id, {_visible('body')} AS body_text, {_visible('bare')} AS page_text FROM v_body", _TEXT_SQL
    ),
)
def page_texts(spark, sf_dir):
    from pagewatch.functions.text import normalize_space

    return _parsed(spark, sf_dir).select(
        "page_id",
        details.main_text(F.col("body_texts"), F.col("body_text")).alias("body_text"),
        normalize_space(F.col("page_text")).alias("page_text"),
    )


@query(
    "page_titles",
    f"""SELECT page_id, {t.ns(_unescaped("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))} AS title FROM pages""",
)
def page_titles(spark, sf_dir):
    named = details.page_title(F.col("title_texts"), F.lit("board"))
    return _parsed(spark, sf_dir).select("page_id", named.alias("title"))


@query(
    "page_details",
    """SELECT page_id, '2026-06-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS posted, page_id % 13 + 1 AS n_images,
      regexp_extract(url, '^https?://[^/]+') || '/files/' || page_id || '.pdf' AS attachments FROM pages""",
)
def page_details(spark, sf_dir):
    """pages with a date, up to thirteen images, a repeated one and a layout image, and a file in them."""
    page = F.col("page_id")
    images = F.transform(F.sequence(F.lit(0), (page % 13).cast("int")), lambda k: F.format_string('<img src="/photo/%d.png">', k))
    extra = F.concat(
        F.format_string('<meta property="article:published_time" content="2026-06-%02dT10:00:00">', page % 28 + 1),
        F.array_join(images, ""), F.lit('<img src="/photo/0.png"><img src="/logo.png">'),
        F.format_string('<a href="/files/%d.pdf">file</a>', page),
    )
    pages = read_pages(spark, f"{sf_dir}/pages.parquet").withColumn("html", F.concat(extra, "html"))
    rows = page_parse.parse_pages(pages)
    files = details.attachment_urls(F.col("url"), F.col("links"))
    return rows.select(
        "page_id",
        details.posted_date(F.col("meta_dates"), F.col("date_texts"), F.col("page_text")).alias("posted"),
        F.size(details.image_urls(F.col("url"), F.col("images"))).cast("bigint").alias("n_images"),
        F.nullif(F.array_join(files, " "), F.lit("")).alias("attachments"),
    )


PROBE = ("license", "tion", "the ", "http")


@query(
    "keyword_probe",
    f"""SELECT page_id, contains(url, 'blog') AS skipped, CASE WHEN contains(url, 'blog') THEN 0 ELSE
    {" + ".join(f"contains(html, '{w}')::BIGINT" for w in PROBE)} END AS keyword_hits FROM pages""",
)
def keyword_probe(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet").withColumn("enabled", ~F.contains("url", F.lit("blog")))
    return links.keyword_probe(pages, PROBE).select(
        "page_id", "skipped", F.col("keyword_hits").cast("bigint").alias("keyword_hits")
    )


@query(
    "discovered_links",
    t.with_sql(
        """SELECT page_id, link_rank, title AS text, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS link_rank
        FROM v_link WHERE contains(lower(title || ' ' || url), 'th') OR contains(lower(title || ' ' || url), 'au')) WHERE link_rank <= 20""",
        LINKS_SQL,
    ),
)
def discovered_links(spark, sf_dir):
    found = links.discovered_links(_parsed(spark, sf_dir), "page_id", ("th", "au"))
    return found.withColumn("link_rank", F.col("link_rank").cast("bigint"))


# --------------------------------------------------------------- courses
COURSES = courses.CourseWords(names=("license", "heenwh", "eauque"), searches=("course list",), departments=("tion", "ment"))
_SITE = "https://p.example.com/"


def _course_pages(spark, sf_dir):
    """pages with sequential urls, each linking to another page under a course label."""
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    total = pages.count()
    link = F.concat(F.lit('<a href="/'), ((F.col("page_id") * 7 + 3) % total).cast("string"), F.lit('">the course list</a>'))
    plain = F.concat(F.lit('<a href="/'), ((F.col("page_id") + 1) % total).cast("string"), F.lit('">next</a>'))
    html = F.concat(plain, "html")
    labelled = F.when(F.col("page_id") % 3 == 0, F.concat(link, html)).otherwise(html)
    return pages.select("page_id", F.concat(F.lit(_SITE), F.col("page_id").cast("string")).alias("url"), labelled.alias("html"))


def _list(column: str, words) -> str:
    return f"array_to_string(list_filter([{', '.join(f'''CASE WHEN contains({column}, '{w}') THEN '{w}' END''' for w in words)}], lambda w: w IS NOT NULL), ',')"


_OWN_WORDS = " OR ".join(f"contains(txt, '{w}')" for w in COURSES.names)
EVIDENCE_SQL = f"""
v_course AS (SELECT b.page_id, '{_SITE}' || b.page_id::VARCHAR AS url,
   {t.ns("CASE WHEN b.page_id % 3 = 0 THEN 'the course list ' ELSE '' END || 'next ' || " + _visible('bare'))} AS txt FROM v_body b),
v_own AS (SELECT page_id, url, {_list("txt", COURSES.departments)} AS departments, {_list("txt", COURSES.names)} AS courses,
   CASE WHEN length(txt) > 350 THEN left(txt, 349) || '…' ELSE txt END AS excerpt
   FROM v_course WHERE {_OWN_WORDS} OR contains(txt, 'course list'))
"""


@query(
    "course_signals",
    t.with_sql(
        f"""SELECT seq, {_list("body_text", COURSES.names)} AS courses, {_list("body_text", COURSES.departments)} AS departments,
        {" OR ".join(f"contains(body_text, '{w}')" for w in COURSES.names + COURSES.searches)} AS signal FROM v_notice""",
        t.NOTICES_SQL,
    ),
)
def course_signals(spark, sf_dir):
    text = F.col("body_text")
    return t.notices(spark, sf_dir).select(
        "seq",
        F.array_join(courses.matched_courses(text, COURSES), ",").alias("courses"),
        F.array_join(courses.matched_departments(text, COURSES), ",").alias("departments"),
        courses.has_course_signal(text, COURSES).alias("signal"),
    )


@query(
    "course_evidence",
    t.with_sql(
        "SELECT url AS page_url, url, departments, courses, excerpt FROM v_own", _TEXT_SQL, EVIDENCE_SQL
    ),
)
def course_evidence(spark, sf_dir):
    parsed = stored(page_parse.parse_pages(_course_pages(spark, sf_dir)))
    found = courses.find_evidence(parsed, COURSES)
    return found.select(
        "page_url", "evidence.url", F.array_join("evidence.departments", ",").alias("departments"),
        F.array_join("evidence.courses", ",").alias("courses"), "evidence.excerpt",
    )


_NAMED = ", ".join(f"CASE WHEN contains(' ' || i.title, '{w}') THEN '{w}' END" for w in COURSES.names)


@query(
    "enriched_notices",
    t.with_sql(
        f"""SELECT i.seq, coalesce(CASE WHEN searched THEN e.url END, '') AS evidence_url,
          CASE WHEN searched THEN coalesce(e.departments, '') WHEN true THEN '' END AS departments,
          CASE WHEN graded AND likely THEN array_to_string(list_filter([{_NAMED}], lambda w: w IS NOT NULL), ',')
               WHEN searched THEN coalesce(e.courses, '') ELSE '' END AS courses,
          CASE WHEN searched AND coalesce(e.courses, '') <> '' THEN '확인 필요' ELSE computer_course_status END AS status
        FROM (SELECT * REPLACE ('{_SITE}' || (seq % (SELECT count(*) FROM pages))::VARCHAR AS url), grade IN ('A','B','C') AS graded, computer_course_status = '가능성 높음' AS likely,
                grade IN ('A','B','C') AND computer_course_status <> '가능성 높음' AND university_name IN (SELECT name FROM v_university) AS searched FROM v_graded) i
        LEFT JOIN v_own e ON e.url = i.url""",
        _TEXT_SQL, EVIDENCE_SQL, t.NOTICES_SQL, t.SCORED_SQL, t.UNIVERSITIES_SQL,
    ),
)
def enriched_notices(spark, sf_dir):
    evidence = courses.find_evidence(stored(page_parse.parse_pages(_course_pages(spark, sf_dir))), COURSES)
    total = t.table(spark, sf_dir, "pages").count()
    url = F.concat(F.lit(_SITE), (F.col("seq") % total).cast("string"))
    rows = t.graded(spark, sf_dir).withColumn("url", url)
    done = courses.enrich(rows, t.universities(spark, sf_dir), evidence, COURSES)
    return done.select(
        "seq", F.col("course_evidence_url").alias("evidence_url"),
        F.array_join("possible_departments", ",").alias("departments"),
        F.array_join("possible_computer_courses", ",").alias("courses"),
        F.col("computer_course_status").alias("status"),
    )


# ----------------------------------------------------------- attachments
@query(
    "attachment_texts",
    t.with_sql(
        """SELECT n.seq, coalesce(string_agg('text of ' || u.url, chr(10) ORDER BY u.pos), '') AS texts FROM v_notice n
        LEFT JOIN (SELECT seq, unnest(attachment_urls) AS url, generate_subscripts(attachment_urls, 1) AS pos FROM v_notice) u
          ON u.seq = n.seq AND NOT contains(u.url, '3.hwpx') GROUP BY n.seq""",
        t.NOTICES_SQL,
    ),
)
def attachment_texts(spark, sf_dir):
    rows = t.notices(spark, sf_dir).select("seq", "attachment_urls")
    blank = F.contains("url", F.lit("3.hwpx"))
    texts = attachments.wanted_attachments(rows).withColumn(
        "text", F.when(blank, "").otherwise(F.concat(F.lit("text of "), "url"))
    )
    joined = attachments.with_attachment_texts(rows, texts)
    return joined.select("seq", F.array_join(F.transform("attachment_texts", lambda a: a["text"]), "\n").alias("texts"))
