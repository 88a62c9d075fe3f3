"""Vectors of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions.automaton import finder
from pagewatch.functions import dates, hashing, rules, scoring, text, urls


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in frame.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_whitespace(spark):
    raw = ["a 　 b\n", "  ", None, "x\x1cy", "plain text"]
    assert column(spark, raw, text.normalize_space) == ["a b", "", "", "x y", "plain text"]


def test_truncate(spark):
    assert column(spark, ["abcdef", "abc"], lambda c: text.truncate(c, 4)) == ["abc…", "abc"]


def test_csv_guard(spark):
    raw = ['=HYPERLINK("bad")', "  +1", "-2", "@x", "fine = ok", ""]
    assert column(spark, raw, text.csv_safe) == ['\'=HYPERLINK("bad")', "'  +1", "'-2", "'@x", "fine = ok", ""]


def test_list_values(spark):
    assert column(spark, [" a ;; b;"], text.list_values) == [["a", "b"]]


def test_first_date(spark):
    raw = [
        "등록 2026. 6. 1", "26-6-1", "1999-01-02", "192.168.10.5", "none", "２０２６-０６-０１", "2026년 7월 8일",
    ]
    want = ["2026-06-01", "2026-06-01", "2099-01-02", "2068-10-05", "", "2026-06-01", "2026-07-08"]
    assert column(spark, raw, dates.first_date) == want


RANGES = [
    ("온라인 접수기간은 2026-09-03 ~ 2026-09-17 (18시까지)", ("2026-09-03", "2026-09-17")),
    ("신청 2026.07.01.~07.08.", ("2026-07-01", "2026-07-08")),
    ("접수 2026. 7. 1. ~ 2026. 7. 8.", None),
    ("접수기간 2026-06-20 ~ 2026-06-10", None),
    ("게시일 2026-06-01 설명회 2026-06-03 ~ 2026-06-04", None),
    ("안내\n원서접수 2026-12-20 부터 2027-01-05 까지", ("2026-12-20", "2027-01-05")),
    ("접수 2026-12-20 ~ 01-05", None),
    ("접수 2026-02-30 ~ 2026-03-02 이후 2026-03-04 ~ 03-05", ("2026-03-04", "2026-03-05")),
]


def test_application_range(spark):
    got = column(spark, [r for r, _ in RANGES], dates.application_range)
    want = [w if w is None else tuple(dt.date.fromisoformat(x) for x in w) for _, w in RANGES]
    assert [None if g is None else (g.start, g.end) for g in got] == want


def _sources(spark, *texts):
    rows = spark.createDataFrame([("공고", "2026-06-01", [{"name": n, "text": x} for n, x in texts])],
                                 "title string, notice_date string, sources array<struct<name:string,text:string>>")
    return dates.with_dates(rows, F.col("sources"), F.lit("2026-06-12").cast("date")).head()


def test_sources_agree(spark):
    row = _sources(spark, ("본문", "접수 2026-06-10 ~ 2026-06-20"), ("이미지 OCR", "접수 2026.06.10~2026.06.20"))
    assert (row.date_source, row.date_conflict, row.deadline_status) == ("본문, 이미지 OCR", False, "모집중")


def test_sources_differ(spark):
    row = _sources(spark, ("본문", "접수 2026-06-10 ~ 2026-06-20"), ("이미지 OCR", "접수 2026-06-11 ~ 2026-06-20"))
    assert (row.application_start_date, row.date_source, row.date_conflict) == ("2026-06-10", "본문", True)


def test_no_period(spark):
    row = _sources(spark, ("본문", "없음"))
    assert (row.application_start_date, row.deadline_status, row.date_source, row.date_conflict) == (
        "", "날짜확인필요", "", False,
    )


def test_deadline_status(spark):
    day = dt.date(2026, 6, 15)
    rows = [
        (None, None, "날짜확인필요"), (dt.date(2026, 6, 16), None, "접수예정"), (None, dt.date(2026, 6, 14), "마감됨"),
        (None, dt.date(2026, 6, 18), "긴급"), (None, dt.date(2026, 6, 22), "마감임박"),
        (None, dt.date(2026, 6, 23), "모집중"), (dt.date(2026, 6, 1), None, "모집중"),
    ]
    frame = spark.createDataFrame(rows, "s date, e date, want string")
    got = frame.select("want", dates.deadline_status(F.col("s"), F.col("e"), F.lit(day)).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_recency(spark):
    as_of = F.lit("2026-06-20").cast("date")
    days = ["2026-06-14", "2026-06-13", "2026-06-12", "2026-06-21", "", "bad", "2099-13-45"]
    assert column(spark, days, lambda c: dates.is_recent(c, as_of)) == [True, True, False, False, False, False, False]
    assert column(spark, days, lambda c: dates.is_stale(c, as_of)) == [False, False, True, False, False, False, False]


@pytest.mark.parametrize("value,want", [(None, 7), ("x", 7), ("-3", 0), ("12", 12)])
def test_max_age_setting(value, want):
    assert dates.max_age_setting(value) == want


def test_business_days(spark):
    rows = [("schedule", "2026-07-17 14:59:00", True), ("schedule", "2026-07-17 15:00:00", False),
            ("workflow_dispatch", "2026-07-18 00:00:00", True), ("push", "2026-07-15 00:00:00", False)]
    frame = spark.createDataFrame(rows, "k string, t string, want boolean")
    got = frame.select("want", dates.should_run(F.col("k"), F.col("t").cast("timestamp")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


VOCABULARY = scoring.Vocabulary.from_maps(
    {
        "registration_positive": {"시간제등록": 50, "시간제등록생": 60},
        "registration_negative": {"캠프": -35},
        "external_positive": {"성인학습자": 20, "본교 재학생": 15},
        "external_negative": {"본교 재학생": -50},
        "computer_positive": {"AI": 35},
        "computer_negative": {"미술": -10},
    }
)


def grade(spark, title, body, status="모집중"):
    rows = spark.createDataFrame([(title, body, status)], "title string, text string, deadline_status string")
    return scoring.with_classification(rows, VOCABULARY).head()


def test_overlapping_words_all_count(spark):
    row = grade(spark, "시간제등록생 모집", "")
    assert (row.registration_score, row.grade, row.external_score) == (110, "C", 0)
    assert row.reason == "참고 후보입니다. 등록 관련 점수 110, 외부 신청 확인 필요, 컴퓨터 과목 관련성 낮음."


def test_external_word_lifts_to_b(spark):
    assert grade(spark, "시간제등록", "성인학습자 대상").grade == "B"


def test_word_in_both_lists_and_positive_wins(spark):
    row = grade(spark, "본교 재학생", "email 미술")
    assert (row.external_score, row.computer_score) == (-35, 35)
    assert row.matched_keywords == ["본교 재학생", "AI"]


def test_hard_exclusion_and_closed(spark):
    assert grade(spark, "시간제등록생", "성인학습자 AI 자격시험").grade == "D"
    assert grade(spark, "시간제등록생", "성인학습자 AI", "마감됨").grade == "D"
    assert grade(spark, "시간제등록생", "성인학습자 본교 AI 성인학습자", "모집중").grade == "B"


def _graduate(spark, title, body, direct=False):
    from pagewatch.plans.graduate_watch import rule_graded

    rows = spark.createDataFrame([(title, body, direct)], "title string, body_text string, is_direct boolean")
    return rule_graded(rows, F.col("body_text")).head()


def test_graduate_rules(spark):
    row = _graduate(spark, "한빛대 일반대학원, 2027학년도 전기 신입생 모집요강 게시", "원서접수 기간과 입학전형 방법")
    assert row.grade == "A"
    assert row.matched_keywords == [
        "2027", "2027학년도", "일반대학원", "대학원", "모집요강", "신입생 모집", "입학전형", "원서접수", "전기",
    ]
    twice = _graduate(spark, "2026 대학원 추가모집", "").matched_keywords
    assert twice.count("추가모집") == 2
    for title in (
        "한빛대 대학원 2026학년도 최종 합격자 등록금 납부 기간", "대학원 2026학년도 전공별 면접 장소",
        "대학원 추가모집 2026학년도 수험생 유의사항", "산업체 계약학과 2026학년도 대학원 모집요강",
        "대학원 2027학년도 학석사연계과정 신청 공고",
    ):
        row = _graduate(spark, title, "본 대학 일반대학원의 입학전형과 원서접수 일정, 모집요강을 알립니다")
        assert (row.grade, row.matched_keywords) == ("D", [])
    assert _graduate(spark, "대학원 안내", "2026 대학원 모집요강").grade == "D"
    assert _graduate(spark, "대학원 안내", "2026 대학원 모집요강", direct=True).grade == "B"


def test_portal_grade(spark):
    names = ["한국대 일반대학원 일반전형", "한국대 대학원", "한국대 일반대학원 계약학과", "한국대 학부", "한국대 mba 대학원"]
    assert column(spark, names, rules.portal_grade) == ["A", "B", "D", "D", "D"]


def test_weak_c(spark):
    rows = spark.createDataFrame([("C", "인턴십 학생모집"), ("C", "시간제등록 안내"), ("B", "x")], "g string, t string")
    got = rows.select(rules.is_weak_c(F.col("g"), F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [True, False, False]


def test_public_urls(spark):
    good = ["http://8.8.8.8/", "https://example.com:443/p", "http://[2606:4700::1111]/", "http://[::ffff:8.8.8.8]/",
            "http://[2001:4:112::1]/", "http://256.1.1.1/"]
    bad = ["http://127.0.0.1/", "http://169.254.169.254/x", "http://[::1]/", "http://localhost./", "http://a.localhost",
           "https://u:p@x.com", "ftp://x.com", "http:///x", "/relative", "", "http://[fe80::1]/", "http://10.0.0.1",
           "http://[2001:db8::1]/"]
    assert column(spark, good, urls.is_public_http_url) == [True] * len(good)
    assert column(spark, bad, urls.is_public_http_url) == [False] * len(bad)


def test_canonical_urls(spark):
    base = "https://university.example"
    raw = [
        base + "/portal/show.do;jsessionid=Q9Z?page=4&id=8#top",
        base + "/redirect?url=%2Fguide%2Flist.do%3Fid%3D5",
        base + "/a;x=1/b;y=2?q=1",
        base + "/redirect?url=%2Fredirect%3Furl%3D%252Fdeep",
    ]
    assert column(spark, raw, urls.canonical_url) == [
        base + "/portal/show.do?page=4&id=8",
        base + "/guide/list.do?id=5",
        base + "/a;x=1/b?q=1",
        base + "/deep",
    ]


def test_resolve(spark):
    base = F.lit("https://h.example/a/b/c?x=1#f")
    raw = ["d", "../d", "/d/../e", "?y=2", "#z", "//o.example/p", "http://q.example/", "./", ""]
    assert column(spark, raw, lambda c: urls.resolve_reference(base, c)) == [
        "https://h.example/a/b/d", "https://h.example/a/d", "https://h.example/e", "https://h.example/a/b/c?y=2",
        "https://h.example/a/b/c?x=1#z", "https://o.example/p", "http://q.example/", "https://h.example/a/b/",
        "https://h.example/a/b/c?x=1",
    ]


def test_script_links(spark):
    u = "https://campus.example"
    rows = [
        (u + "/menu/news.do", "#", "", '{"scrtWrtiYn":true,"encMenuSeq":"m77","encMenuBoardSeq":"b12"}',
         u + "/menu/board/info/news.do?scrtWrtiYn=true&encMenuSeq=m77&encMenuBoardSeq=b12"),
        (u + "/home.html?menuno=31", "javascript:void(0);", "return submitForm(this,'view',4711);", "",
         u + "/home.html?menuno=31&act=view&bbsno=4711"),
        (u + "/cmn/board/GRAD_BOARD7/noticeList.do", "javascript:void(0);", "doDetail('95');", "",
         u + "/cmn/board/GRAD_BOARD7/95noticeDetail.do"),
        (u + "/notice/list", "#", "", "123", u + "/notice/list"),
    ]
    frame = spark.createDataFrame(rows, "b string, h string, o string, d string, want string")
    made = urls.link_url(F.col("b"), F.col("h"), F.col("o"), F.col("d"))
    got = frame.select("want", F.regexp_replace(made, "#.*$", "").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_notice_links(spark):
    base = "https://campus.example/board/list"
    rows = [
        ("공지사항", "https://campus.example/life/notice", False),
        ("공지 게시판", base, False),
        ("교수진", "https://campus.example/bbs/grad/faculty", False),
        ("학과 연혁", "https://campus.example/pages/view.do?menuNo=7", False),
        ("2026학년도 1학기 시간제등록생 추가모집", "https://campus.example/file?id=77", True),
        ("2026학년도 입학 일정", "https://campus.example/notice?articleNo=31", True),
        ("전형 일정표 모집.pdf", "https://campus.example/notice?articleNo=31", False),
        ("전형 일정표 모집", "https://campus.example/table.pdf", False),
        ("전형 일정표 모집", "https://other.example/notice?articleNo=31", False),
    ]
    frame = spark.createDataFrame(rows, "t string, u string, want boolean")
    got = frame.select("want", urls.looks_like_notice(F.col("t"), F.col("u"), F.lit(base)).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_file_types(spark):
    rows = [
        ("https://h.example/a.hwpx", "", "", ".hwpx"), ("https://h.example/download", 'attachment; filename="x.docx"', "", ".docx"),
        ("https://h.example/d", "", "application/pdf; charset=x", ".pdf"), ("https://h.example/d", "", "", ""),
    ]
    frame = spark.createDataFrame(rows, "u string, d string, c string, want string")
    got = frame.select("want", urls.detect_suffix(F.col("u"), F.col("d"), F.col("c")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_portal_print_ignores_date(spark):
    schema = "university_name string, board_type string, title string, notice_date string, m array<string>, a array<string>"
    rows = [("u", b, "[공지] 2026 전기 모집", d, ["b", "a"], []) for b in ("유웨이어플라이", "게시판") for d in ("1", "2")]
    cols = [F.col(c) for c in ("university_name", "board_type", "title", "notice_date", "m", "a")]
    got = [r.fp for r in spark.createDataFrame(rows, schema).select(hashing.graduate_fingerprint(*cols).alias("fp")).collect()]
    assert got[0] == got[1] and got[2] != got[3]


def test_order_ranks(spark):
    assert column(spark, ["A", "D", "x"], rules.grade_rank) == [0, 3, 9]
    assert column(spark, list(fv.REPORT_STATUS_ORDER) + ["x"], rules.status_rank) == [0, 1, 2, 3, 4, 5, 9]


# many words in one pass


@pytest.mark.parametrize(
    "words", [[], [""], ["a"], ["ab", "b", "ab", "", "abc", "bca"], ["시간제", "시간", "간제등", "\U0001f600"], [f"w{n}" for n in range(3000)]]
)
@pytest.mark.parametrize("text", ["", "a", "abcab", "시간제등록 \U0001f600", "w1 w2999 w12345 w"])
def test_finder_against_each_word(words, text):
    assert list(finder(words)(text)) == [i for i, w in enumerate(words) if w in text]


def _of_size(size):
    """Words that overlap, repeat and belong to every family, in no order of families."""
    kinds = [(f, p) for p in ("positive", "negative") for f in ("computer", "registration", "external")]
    return scoring.Vocabulary(
        tuple(scoring.Word(*kinds[n % 6], f"w{n // 2 % 211}" + "x" * (n % 2), n % 9 - 4) for n in range(size))
    )


def test_long_and_short_vocabularies_agree(spark, monkeypatch):
    texts = [("w1 w22x", "w100 W7X"), ("", ""), (None, "w1"), ("w210x w210", "w1x " * 5000), ("nothing", None)]
    rows = spark.createDataFrame(
        [(n, title, body, "모집중") for n, (title, body) in enumerate(texts)],
        "id int, title string, text string, deadline_status string",
    )
    vocabulary, out = _of_size(400), []
    for flat in (1, 1000):
        monkeypatch.setattr(scoring, "FLAT_WORDS", flat)
        monkeypatch.setattr("pagewatch.functions.text.FLAT_WORDS", flat)
        graded = sorted(scoring.with_classification(rows, vocabulary).collect())
        hits = sorted(scoring.keyword_hits_long(rows, vocabulary, "id", F.col("text")).collect())
        out.append((graded, hits))
    assert out[0] == out[1]
    assert out[0][1]


def test_positions_of_many_texts_are_python_objects_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from pagewatch.functions import automaton

    words = [f"w{i}x" for i in range(1_000)]
    text = " ".join(words[300:])
    batch = pa.array([text, None, ""] + [text] * 2_000)
    tracemalloc.start()
    (got,) = automaton.places_in(iter([batch]), words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist()[:4] == [list(range(300, 1_000)), [], [], list(range(300, 1_000))] and len(got) == len(batch)
    assert peak < 6 << 20  # the positions of all texts are 11 MB of pointers alone
    assert [len(a) for a in automaton.places_in(iter([batch[:0]]), words)] == [0]
