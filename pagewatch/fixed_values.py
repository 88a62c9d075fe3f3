"""Word lists, patterns, thresholds and messages that decide results.

Everything here is a fixed value: changing one changes grades, dates, keys or
stored texts. Functions take the lists as parameters with these defaults.
"""

# ---------------------------------------------------------------- fixed values
# Whitespace as Unicode defines it plus the four ASCII separators. Written as
# code points so that Java regex and RE2 agree on it.
_RARE_WHITESPACE = (
    r"\x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WHITESPACE = rf"[\x20{_RARE_WHITESPACE}]+"
# Whitespace that is not already one plain blank.
UNTIDY_WHITESPACE = rf"[{_RARE_WHITESPACE}][\x20{_RARE_WHITESPACE}]*|\x20[\x20{_RARE_WHITESPACE}]+"

# Scoring and grading
FAMILIES = ("registration", "external", "computer")
HARD_EXCLUSION_TERMS = ("자격증 발급", "자격증 신청", "자격 발급", "자격시험", "평생교육사", "교원자격")
FRESHNESS = {"모집중": 50, "접수예정": 45, "마감임박": 40, "긴급": 35, "날짜확인필요": 10, "마감됨": -30}
FRESHNESS_DEFAULT = 10
STATUS_LIKELY = "가능성 높음"
STATUS_UNLIKELY = "불가 가능성 높음"
STATUS_UNRELATED = "관련성 낮음"
STATUS_CHECK = "확인 필요"
WEAK_TITLE_WORDS = ("시간제", "등록생", "학점은행", "비학위", "외부 수강", "타교생", "일반인 수강")
ATTACHMENT_TITLE_WORDS = ("시간제", "등록생", "학점은행", "비학위", "외부 수강", "타교생")
REASON_A = "시간제등록 또는 외부 수강 관련성이 높고, 외부 신청 가능성과 컴퓨터 관련 과목 가능성이 함께 감지됨. 현재 상태: %s."
REASON_B = "공식 게시판에서 유력 후보가 발견되었으나 외부 신청 또는 컴퓨터 과목 여부 추가 확인 필요. 현재 상태: %s."
REASON_C = "참고 후보입니다. 등록 관련 점수 %d, 외부 신청 %s, 컴퓨터 과목 %s."
REASON_D = "제외 후보입니다. 공식 모집 공고 관련성, 외부 신청 가능성 또는 현재 유효성이 낮습니다."
REASON_WEAK_C = "C등급 약한 후보이지만 제목에 시간제등록 또는 외부 수강 신호가 없어 제외했습니다."

# Deadlines
STATUS_UNKNOWN = "날짜확인필요"
STATUS_UPCOMING = "접수예정"
STATUS_CLOSED = "마감됨"
STATUS_URGENT = "긴급"
STATUS_SOON = "마감임박"
STATUS_OPEN = "모집중"
RANGE_CONTEXT_WORDS = ("접수", "신청", "등록", "원서", "모집기간", "수강")
RANGE_PATTERN = (
    r"(20[0-9]{2})[^0-9]{0,5}([0-9]{1,2})[^0-9]{0,5}([0-9]{1,2})"
    r"[^0-9]{0,30}(?:~|부터|까지|-|to|until)[^0-9]{0,30}"
    r"(20[0-9]{2})?[^0-9]{0,5}([0-9]{1,2})[^0-9]{0,5}([0-9]{1,2})"
)
LONG_DATE_PATTERN = r"(20[0-9]{2})[.\-/년 ]+\s*([0-9]{1,2})[.\-/월 ]+\s*([0-9]{1,2})"
SHORT_DATE_PATTERN = r"([0-9]{2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{1,2})"
#: A text that matches the pattern below holds one of these.
POSTED_DATE_LABELS = ("게시일", "작성일", "등록일")
POSTED_DATE_PATTERN = (
    r"(?:게시일|작성일|등록일|작성일자)\s*[:：]?\s*"
    r"((?:19|20)[0-9]{2}[^0-9]{0,5}[0-9]{1,2}[^0-9]{0,5}[0-9]{1,2})"
)
DEFAULT_MAX_AGE_DAYS = 7
SEMESTERS = ("2학기", "1학기")
SOURCE_BODY = "본문"
SOURCE_ATTACHMENT_PREFIX = "첨부:"
SOURCE_OCR_PREFIX = "이미지 OCR:"
COURSE_SOURCE_TYPE = "대학 공식 게시판 직접 크롤링"

# Links and pages
MENU_TITLES = (
    "학사일정", "커뮤니티", "대학소개", "학사안내", "학사행정", "신입학", "편입학",
    "공지사항", "동문소식", "모집안내", "입학안내", "학사자료실", "교직과공지",
    "대학전체", "사회과학대학", "정보기술대학", "사범대학", "more view",
)
LINK_TARGET_WORDS = ("시간제", "등록생", "학점은행", "비학위", "모집요강", "수강")
LINK_NOISE_WORDS = ("로그인", "회원가입", "개인정보", "이메일", "사이트맵", "찾아오시는", "facebook", "instagram")
FILE_SUFFIXES = (".pdf", ".hwp", ".hwpx", ".doc", ".docx", ".xls", ".xlsx", ".zip")
DETAIL_URL_PATTERN = (
    r"(article(no)?=|artclview|/bbs/(?:[^/?]+/)*[0-9]+(?:$|[/?#])|"
    r"bbs[^?#]*(?:view|detail)|board/info|noticedetail|encmenuboardseq|"
    r"mode=(view|download)|act=view|bbsno=|ntt|seq=|wr_id=)"
)
RSS_PATTERN = r"rss(list)?\b|/rss"
FILE_TITLE_PATTERN = r"\.(pdf|hwpx?|docx?|xlsx?|zip)\s*$"
NOTICE_PATTERN = r"(notice|board|bbs|article|view|ntt|seq|mode=view|wr_id|공지|모집|학사|입학)"
IMAGE_LAYOUT_WORDS = ("logo", "icon", "banner", "button", "sprite", "profile")
BODY_SELECTORS = (".view", ".board_view", ".bbs-view", ".article", ".content", "#content", "main")
TITLE_SELECTORS = ("h1", "h2", ".title", ".tit", "title")
DATE_CLASSES = ("regdate", "write-date", "view-date", "board-date")
DATE_METAS = (("property", "article:published_time"), ("name", "date"), ("name", "publish-date"))
PROBE_WORDS = ("대학원", "입학", "모집", "전형", "공지")
DISCOVERY_WORDS = ("입학", "모집", "전형", "공지", "notice", "admission", "board")
# IPv4 ranges that are not globally reachable (first address, last address).
PRIVATE_IPV4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
)
# The same for IPv6, on the address written as 32 hex digits; the second pattern lists exceptions.
RESERVED_IPV6 = (
    r"^(0{31}[01]$|0{20}ffff|0064ff9b0001|0100000000000000|20010[01]|20010db8|2002|3fff0|f[cd]|fe[89ab])"
)
REACHABLE_IPV6 = r"^(200100010{23}[12]$|20010003|200100040112|2001002|2001003)"

# Portals and graduate admission
PORTAL_NEGATIVE_WORDS = (
    "교육대학원", "경영전문", "경영대학원", "특수대학원", "전문대학원", "신학대학원",
    "사회복지대학원", "상담", "외국인", "international", "글로벌", "MBA", "학석사", "계약학과",
)
PORTAL_GENERAL = "일반대학원"
PORTAL_SCHOOL = "대학원"
PORTAL_MARK = "어플라이"
PORTAL_LIST = "유웨이어플라이"
PORTAL_API = "진학사어플라이"
PORTAL_API_BOARD = "진학사어플라이 대학원 원서접수"
PORTAL_API_PAGE = "https://www.jinhakapply.com/SiteList/SiteGraduateList"
PORTAL_LIST_REASON = "유웨이어플라이 '%s' 목록에서 원서접수 확인됨 (상태: %s)."
PORTAL_API_REASON = "진학사어플라이 원서접수 목록에서 확인됨 (접수기간: %s)."
PORTAL_TERMS = ("전기", "후기")
TARGET_YEARS = ("2026", "2027")
YEAR_WORDS = ("2026", "2027", "2026학년도", "2027학년도")
TERM_WORDS = ("전기", "후기", "추가모집", "추가 모집", "1차", "2차", "3차")
SCHOOL_WORDS = ("일반대학원", "대학원")
ADMISSION_WORDS = (
    "모집요강", "신입생 모집", "신입생모집", "입학전형", "전형일정", "원서접수", "특별전형", "추가모집",
)
TITLE_ADMISSION_EXTRA = ("학생모집", "일반전형")
GRADUATE_NEGATIVE_WORDS = ("학부", "편입", "재외국민", "특수대학원", "전문대학원", "교육대학원", "경영전문대학원")
EXCLUDED_TITLE_WORDS = ("합격자", "등록금", "면접", "수험생", "계약학과", "학석사", "외국인")
GRADUATE_REASONS = {
    "excluded": "모집 공고가 아닌 합격·등록·면접·별도 전형 안내로 판단되어 제외했습니다.",
    "title": "제목에 학년도와 모집 신호가 함께 없어 메뉴/상시 안내 페이지로 판단했습니다.",
    "negative": "일반대학원보다 특수/전문대학원 또는 학부 전형일 가능성이 높습니다.",
    "general": "일반대학원 모집 공고로 판단됩니다.",
    "school": "대학원 모집 공고이며 일반대학원 여부 추가 확인이 필요합니다.",
    "none": "일반대학원 모집요강 조건을 충족하지 않습니다.",
}
TITLE_BRACKETS_PATTERN = r"\[[^\]]+\]|\([^)]+\)"
TITLE_TERMS_PATTERN = r"20[0-9]{2}|전기|후기|수시|정시|1차|2차|3차"

# Courses
DEPARTMENTS = ("컴퓨터공학과", "소프트웨어학과", "AI융합학과", "인공지능학과", "정보보안학과", "데이터사이언스학과")

# Limits that are part of the result
TITLE_CHARS = 250
EVIDENCE_CHARS = 350
PREVIEW_CHARS = 240
MAX_IMAGES = 10
LINKS_PER_BOARD = 15
GRADUATE_LINKS_PER_BOARD = 12
DIGEST_SIZE = 25
HISTORY_MIN_SCORE = 40
KEPT_PAGE_STATES = 1000
KEPT_DELIVERED = 2000
CACHED_HTML_CHARS = 500_000
DISCOVERED_LINKS = 20
ATTACHMENT_BYTES = 8_000_000
ARCHIVE_ENTRY_BYTES = 16_000_000
ARCHIVE_TOTAL_BYTES = 64_000_000

# Orders and field lists
GRADE_ORDER = ("A", "B", "C", "D")
REPORT_STATUS_ORDER = ("모집중", "접수예정", "마감임박", "긴급", "날짜확인필요", "마감됨")
CHANGE_TYPES = ("new", "content_changed", "grade_changed", "deadline_changed")
RESULT_FIELDS = (
    "checked_at", "university_name", "region", "city", "title", "url", "source_type", "source_query",
    "notice_date", "application_start_date", "application_end_date", "deadline_status",
    "registration_score", "external_score", "computer_score", "freshness_score", "grade",
    "external_applicant_status", "computer_course_status", "possible_departments",
    "possible_computer_courses", "course_evidence_url", "course_evidence_text", "attachment_urls",
    "image_urls", "ocr_checked", "ocr_text_found", "ocr_evidence", "date_source", "date_conflict",
    "matched_keywords", "reason", "content_fingerprint", "change_type", "previous_grade", "is_new",
)
GRADUATE_FIELDS = (
    "checked_at", "university_name", "region", "city", "board_type", "title", "url", "notice_date",
    "grade", "matched_keywords", "reason", "attachment_urls", "is_new",
)
HISTORY_FIELDS = (
    "university_name", "region", "semester", "notice_date", "application_start_date",
    "application_end_date", "url", "title", "source",
)

# Delivery
DELIVERY_STATUSES = ("sending", "uncertain", "failed", "delivered")
PRE_CONNECT_MARKERS = (
    "failed to establish a new connection", "name resolution", "nodename nor servname", "connection refused",
)
CONTENT_TYPE_SUFFIXES = {
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/x-hwp": ".hwp",
    "application/haansofthwp": ".hwp",
}
# ------------------------------------------------------------ end fixed values
