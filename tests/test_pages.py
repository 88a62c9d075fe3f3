"""Pages to links, notices and texts."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewatch import schemas
from pagewatch.operators import attachments, details, health, links, page_parse, portals
from pagewatch.plans import course_watch, graduate_watch
from pagewatch.sources.config import empty

BASE = "https://university.example/board/list"
BOARD = """<html><head><title>알림마당</title><style>dt { color: red }</style></head><body>
<header><a href="/about">기관 소개</a></header>
<dl class="bulletin">
 <dt>26.06.09 <a href="/bulletin/read?seq=900">도서관 휴관 안내</a></dt><dd>월요일 하루 쉽니다</dd>
 <dt>26.03.27 <a href="/bulletin/read?seq=871" title="셔틀버스 노선 변경"></a></dt><dd>정류장이 바뀝니다</dd>
</dl>
<table><caption>지난 글</caption><tr><th>글</th><th>날짜</th></tr>
 <tr><td><a href="/bulletin/read?seq=900#top">휴관 안내 (다시)</a></td><td>2026-06-10</td></tr>
 <tr><td><a href="/bulletin/read?seq=12">기숙사 점검 일정</a></td><td>2026년 6월 2일</td></tr>
</table></body></html>"""
DETAIL = """<html><head><meta name="date" content="2026-06-11"></head><body><header><a href="/x.pdf">머리</a></header>
<h1>  </h1><h2>제목 둘</h2><div class="view"><p>{body}</p><a href="/files/a.pdf">첨부</a><a href="get?id=1">download</a>
<a href="/files/a.pdf">again</a><a href="http://127.0.0.1/b.pdf">b</a>
<img src="/logo.png"><img data-src="/p.png"><img src="data:xx"><img src="/p.png"></div>
<footer>끝</footer></body></html>"""


def parsed(spark, *pages):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], schemas.PAGES)
    return page_parse.parse_pages(rows)


def test_candidates(spark):
    rows = parsed(spark, (BASE, BOARD)).withColumn("board_idx", F.col("page_id"))
    got = {r.url: (r.title, r.notice_date) for r in links.candidate_links(rows).collect()}
    place = "https://university.example/bulletin/read?seq="
    assert {u: d for u, (_, d) in got.items()} == {place + "900": "2026-06-09", place + "871": "2026-03-27", place + "12": "2026-06-02"}
    assert [got[place + n][0] for n in ("900", "871", "12")] == ["도서관 휴관 안내", "셔틀버스 노선 변경", "기숙사 점검 일정"]


def test_deep_nesting_is_parsed_in_one_pass():
    import time

    deep = "".join(f"<div><a href='/n?seq={i}'>공고 {i}</a>" for i in range(20_000))
    stray = "</span>" * 20_000 + "<b>" * 5_000 + "<li>x" * 5_000
    began = time.process_time()
    page = page_parse._Tree(deep + stray)
    assert time.process_time() - began < 3
    outer, inner = page.nodes[0], page.nodes[2 * 19_998]
    assert (outer.links, inner.links) == (20_000, 2)
    assert page_parse._context_node(page.nodes[2 * 19_999 + 1]) is page.nodes[2 * 19_999]
    assert page_parse._context_node(page.nodes[1]) is None


def test_known_universities_restrict_portal_rows_without_doubling(spark):
    rows = spark.createDataFrame([("한국대", 1), ("없는대", 2)], "university_name string, n int")
    known = spark.createDataFrame([("한국대", "서울", None, "b"), ("한국대", "서울", None, "a")], "name string, region string, region_name string, city string")
    assert [(r.n, r.region, r.city) for r in portals.with_region(rows, known, restrict=True).collect()] == [(1, "서울", "a")]
    assert sorted((r.n, r.city) for r in portals.with_region(rows, known, restrict=False).collect()) == [(1, "a"), (2, "")]


def test_details(spark):
    body = "본문 " * 60
    row = parsed(spark, (BASE, DETAIL.format(body=body))).select(
        details.posted_date(F.col("meta_dates"), F.col("date_texts"), F.col("page_text")).alias("posted"),
        details.page_title(F.col("title_texts"), F.lit("board")).alias("title"),
        details.main_text(F.col("body_texts"), F.col("body_text")).alias("body"),
        details.attachment_urls(F.col("url"), F.col("links")).alias("files"),
        details.image_urls(F.col("url"), F.col("images")).alias("images"),
    ).head()
    assert (row.posted, row.title) == ("2026-06-11", "제목 둘")
    assert row.body == f"{body.strip()} 첨부 download again b"
    assert row.files == ["https://university.example/files/a.pdf", "https://university.example/board/get?id=1"]
    assert row.images == ["https://university.example/p.png"]


@pytest.mark.parametrize("html,want", [
    ("<time datetime='2026-06-09T10:00'>x</time><span class='regdate'>2026-06-01</span>", "2026-06-09"),
    ("<td class='a write-date'>26.6.5</td>", "2026-06-05"),
    ("<p>등록일 : 2026년 6월 4일</p>", "2026-06-04"),
    ("<p>2026-06-04</p>", ""),
    ("<script>작성일 2026-06-04</script>", ""),
])
def test_posted_date(spark, html, want):
    row = parsed(spark, (BASE, html)).select(
        details.posted_date(F.col("meta_dates"), F.col("date_texts"), F.col("page_text")).alias("d")
    ).head()
    assert row.d == want


def test_broken_and_missing_pages_are_isolated(spark):
    got = parsed(spark, ("a", None), ("b", "<p>x")).orderBy("page_id").select("parse_error", "page_text").collect()
    assert got[0].parse_error == "no page" and got[1].page_text == "x"


def test_context_needs_few_links(spark):
    many = "<div>" + "".join(f"<b><a href='/n?ntt={i}'>공고 {i} 번</a></b>" for i in range(3)) + " 2026-01-01</div>"
    row = parsed(spark, (BASE, many)).select("links", "contexts").head()
    assert [row.contexts[a.context] for a in row.links] == ["공고 0 번", "공고 1 번", "공고 2 번"]


def test_order_and_filters(spark):
    rows = [(0, 0, "u0", ""), (0, 1, "u1", "2026-04-03"), (0, 2, "u2", "2026-06-20"), (0, 3, "u3", "2020-01-01")]
    frame = spark.createDataFrame(rows, "board_idx long, pos long, url string, notice_date string")
    ordered = links.ordered_candidates(frame).orderBy("board_rank").collect()
    assert [r.url for r in ordered] == ["u2", "u1", "u3", "u0"]
    seen = spark.createDataFrame([("u2",)], "key string")
    kept = links.not_yet_handled(frame, seen, F.lit("2026-04-08").cast("date"), 7)
    assert sorted(r.url for r in kept.collect()) == ["u0", "u1"]
    capped = links.capped_frontier(frame, cap=2).orderBy("board_rank").collect()
    assert [r.url for r in capped] == ["u2", "u1"]


def test_cap_is_applied_before_the_shuffle(spark):
    frame = spark.range(100).selectExpr("id % 3 board_idx", "id pos", "string(id) url", "if(id > 5, '', '2026-06-01') notice_date")
    plan = links.capped_frontier(frame)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("ok,failed,verdict", [(0, 3, "all boards failed"), (2, 2, "below safe majority"), (3, 1, "ok"), (0, 0, "ok")])
def test_health_gate(spark, ok, failed, verdict):
    counters = spark.createDataFrame([(ok, failed)], "boards_succeeded long, boards_failed long")
    if verdict == "ok":
        health.require_healthy(counters)
    else:
        with pytest.raises(health.CrawlHealthError, match=verdict):
            health.require_healthy(counters)


PORTAL = """<div class="list"><h4>2026 후기 대학원</h4><a href="https://p.example/1"><i title="접수중">접</i>한국대 일반대학원 <span><i>U</i></span></a>
<a href="https://p.example/2">한국대 교육대학원</a></div><div class="list"><h4>편입</h4><a href="https://p.example/3">서울대 일반대학원</a></div>"""


def test_list_portal(spark):
    as_of = F.lit("2026-06-15").cast("date")
    rows = portals.list_portal(parsed(spark, ("https://p.example", PORTAL)), as_of, F.lit("now")).collect()
    assert [(r.title, r.university_name, r.url, r.grade) for r in rows] == [
        ("한국대 일반대학원", "한국대", "https://p.example/1", "A")
    ]
    assert rows[0].reason == "유웨이어플라이 '2026 후기 대학원' 목록에서 원서접수 확인됨 (상태: 접수중)."
    assert portals.list_portal(parsed(spark, ("u", PORTAL)), as_of, F.lit("now"), "전기").count() == 0


def test_api_portal(spark):
    raw = (
        '{"d": "{\\"Univdata\\": [{\\"ShortName\\": \\"한국대\\", \\"ServiceName\\": \\"일반대학원 후기\\", \\"Link\\": \\"\\", '
        '\\"WriteFromTime\\": \\"2026-06-01T00:00\\", \\"WriteToTime\\": \\"2026-06-10T00:00\\"}, '
        '{\\"ShortName\\": \\"서울대\\", \\"ServiceName\\": \\"전문대학원\\"}, {\\"ShortName\\": \\"학부\\", \\"ServiceName\\": \\"수시\\"}]}"}'
    )
    services = portals.payload_services(spark.createDataFrame([(raw,)], "raw string"))
    as_of = F.lit("2026-06-15").cast("date")
    rows = portals.api_portal(services, as_of, F.lit("now")).collect()
    assert [r.title for r in rows] == ["한국대 일반대학원 후기"]
    assert rows[0].reason.endswith("(접수기간: 2026-06-01 ~ 2026-06-10).")
    assert portals.api_portal(services, as_of, F.lit("now"), "전기").count() == 0
    univ = spark.createDataFrame([("서울대", "seoul", None, "서울", [], 1, "")], schemas.UNIVERSITIES)
    assert portals.with_region(portals.api_portal(services, as_of, F.lit("n")), univ, True).count() == 0


def archive(**files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), content)
    return buffer.getvalue()


W = 'xmlns:w="http://w"'
DOCX = archive(word__document_DOT_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>모집</w:t><w:tab/><w:t>요강</w:t></w:r></w:p><w:p><w:t>둘</w:t></w:p></w:body></w:document>")
HWPX = archive(Contents__section0_DOT_xml="<s xmlns:h='http://h'><h:p><h:t> 하나 </h:t><h:t>둘</h:t></h:p><h:p><h:t>셋</h:t></h:p></s>")


def test_attachment_texts(spark):
    files = [
        ("https://f.example/a.docx", DOCX), ("https://f.example/b.hwpx", HWPX), ("https://f.example/c.docx", b"broken"),
        ("https://f.example/d.pdf", b"%PDF"), ("https://f.example/e.zip", b"z"),
    ]
    frame = spark.createDataFrame([(u, len(c), c) for u, c in files], "url string, length long, content binary")
    typed = attachments.typed_files(frame)
    got = {r.url[-6:]: r for r in attachments.extract_texts(typed).collect()}
    assert got["a.docx"].text == "모집\t요강\n둘" and got["b.hwpx"].text == "하나 둘\n셋"
    assert got["c.docx"].text == "" and "BadZipFile" in got["c.docx"].error
    assert got["/d.pdf"].text == "" and got["/e.zip"].error == "no reader for .zip"
    refused = attachments.extract_texts(attachments.typed_files(frame, max_bytes=10)).where("error LIKE '%over 10'")
    assert refused.count() == sum(len(c) > 10 for _, c in files) > 0
    small = attachments.extract_texts(typed, max_expanded=50).where("text <> ''")
    assert small.count() == 0
    known = spark.createDataFrame([("https://f.example/a.docx", got["a.docx"].content_hash, "remembered")], "url string, content_hash string, extracted_text string")
    again = {r.url[-6:]: r.text for r in attachments.extract_changed(typed, known).collect()}
    assert again["a.docx"] == "remembered" and again["b.hwpx"] == "하나 둘\n셋"


def test_xlsx_text():
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c><c t="inlineStr"><is><t>줄</t></is></c></row></sheetData></worksheet>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://r"><sheets><sheet name="a" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><r Id="rId1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>공고</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert attachments.xlsx_text(buffer.getvalue()) == "공고\n7\n줄"


def _board_row(idx, url, scan=False, enabled=True):
    return (idx, "한국대", "공지", url, enabled, scan, "")


BOARD_SCHEMA = "board_idx long, university_name string, board_type string, url string, enabled boolean, scan_page boolean, notes string"


def test_graduate_watch_end_to_end(spark):
    board = '<ul><li><a href="/bbs/view.do?ntt=1">2026학년도 후기 일반대학원 신입생 모집요강</a> 2026-06-12</li></ul>'
    detail = "<div class='view'>" + "일반대학원 원서접수 안내 " * 20 + "</div>"
    standing = "<h1>2026학년도 대학원 모집요강</h1><main>" + "입학전형 " * 40 + "</main>"
    pages = [(1, BASE, board), (2, "https://university.example/bbs/view.do?ntt=1", detail),
             (3, "https://university.example/stand", standing)]
    boards = spark.createDataFrame(
        [_board_row(0, BASE), _board_row(1, "https://university.example/stand", True), _board_row(2, "x", enabled=False)],
        BOARD_SCHEMA,
    )
    univ = spark.createDataFrame([("한국대", "seoul", "서울", "서울", ["k.example"], 1, "")], schemas.UNIVERSITIES)
    before = empty(spark, schemas.GRADUATE_RESULTS).withColumn("seq", F.lit(0).cast("bigint"))
    rows = graduate_watch.run(
        spark.createDataFrame(pages, schemas.PAGES), boards, univ, seen=empty(spark, schemas.SEEN),
        previous_results=before, as_of=F.lit("2026-06-15").cast("date"), checked_at=F.lit("now"),
    ).orderBy("seq").collect()
    assert [(r.title, r.grade, r.notice_date, r.is_new) for r in rows] == [
        ("2026학년도 대학원 모집요강", "B", "", True),
        ("2026학년도 후기 일반대학원 신입생 모집요강", "A", "2026-06-12", True),
    ]
    assert rows[0].region == "서울"


def test_image_texts_can_regrade(spark):
    from tests.test_columns import VOCABULARY

    none = []
    notices = spark.createDataFrame(
        [(1, "한국대", "공지", "시간제등록생", "u1", "2026-06-12", "성인학습자", none, ["i1"]),
         (2, "한국대", "공지", "캠프", "u2", "2026-06-12", "", none, ["i1"])],
        "seq long, university_name string, board_type string, title string, url string, notice_date string, body_text string, "
        "attachment_urls array<string>, image_urls array<string>",
    )
    univ = spark.createDataFrame([("한국대", "seoul", "서울", "서울", ["k.example"], 1, "")], schemas.UNIVERSITIES)
    ocr = spark.createDataFrame([("i1", "접수 2026-06-01 ~ 2026-06-05 자격시험")], "url string, text string")
    got = course_watch.graded_items(
        notices, univ, VOCABULARY, None, F.lit("2026-06-15").cast("date"), F.lit("now"), ocr
    ).orderBy("seq").collect()
    assert (got[0].grade, got[0].ocr_checked, got[0].deadline_status, got[0].date_source) == ("D", True, "마감됨", "이미지 OCR:i1")
    assert (got[1].grade, got[1].ocr_checked, got[1].ocr_evidence) == ("D", False, {})


def test_a_labelled_date_is_looked_for_once_and_found_in_any_white_space(spark):
    """The whole page text was squeezed again for every part of the date read from it."""
    texts = [
        "공지 작성일자 　\n : \t2026. 6.\n7 끝", "등록일2025-12-31 게시일 2024-01-02", "게시일 : 곧, 작성일: 26.1.2", "작 성일 2026-06-07",
        "2026-06-07", "게시일：2019년 1월 2일", "", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, page_text string")
    none = F.array().cast("array<string>")
    found = rows.select("i", details.posted_date(none, none, F.col("page_text")).alias("date"))
    assert [r["date"] for r in found.orderBy("i").collect()] == ["2026-06-07", "2025-12-31", "", "", "", "2019-01-02", "", ""]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
