"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

from pagewatch import fixed_values as fv

_LISTS = {
    "possible_departments", "possible_computer_courses", "attachment_urls", "image_urls", "matched_keywords",
}
_NUMBERS = {"registration_score", "external_score", "computer_score", "freshness_score"}
_FLAGS = {"ocr_checked", "ocr_text_found", "date_conflict", "is_new"}


def _row(names: tuple[str, ...]) -> T.StructType:
    def kind(name: str) -> T.DataType:
        if name in _LISTS:
            return T.ArrayType(T.StringType())
        if name in _NUMBERS:
            return T.IntegerType()
        if name in _FLAGS:
            return T.BooleanType()
        if name == "ocr_evidence":
            return T.MapType(T.StringType(), T.StringType())
        return T.StringType()

    return T.StructType([T.StructField(name, kind(name)) for name in names])


RESULTS = _row(fv.RESULT_FIELDS)
GRADUATE_RESULTS = _row(fv.GRADUATE_FIELDS)
HISTORY = _row(fv.HISTORY_FIELDS)
KEYED_HISTORY = _row((*fv.HISTORY_FIELDS, "key"))
# Built from types rather than DDL text: workers import this module without a session.
_KINDS = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "flag": T.BooleanType(),
    "time": T.TimestampType(), "strings": T.ArrayType(T.StringType()),
}


def _table(**columns: str) -> T.StructType:
    """A schema from ``kind="name name .."`` in the order given."""
    return T.StructType(
        [T.StructField(name, _KINDS[kind.rstrip("_")]) for kind, names in columns.items() for name in names.split()]
    )


UNIVERSITIES = _table(string="name region region_name city", strings="domains", int="priority", string_="notes")
BOARDS = _table(string="university_name board_type url", flag="enabled scan_page", string_="notes")
PAGES = _table(long="page_id", string="url html")
NOTICE_STATE = _table(string="url content_fingerprint grade deadline_status checked_at")
SEEN = _table(string="key")
PAGE_STATE = _table(string="url etag last_modified content_hash checked_at html extracted_text")
PAGE_HEADERS = _table(string="url etag last_modified content_hash checked_at html_key text_key")
PAGE_CONTENTS = _table(string="key value")
DELIVERY_STATE = _table(
    string="delivery_id status", long="attempt_count",
    string_="logical_key message_preview updated_at message_id error_type resolved_at",
)
DELIVERY_EVENTS = _table(
    string="delivery_id event status logical_key message message_id error_type", time="ts", long="event_id"
)
SUMMARY_STATE = _table(string="fingerprint", long="candidate_count active_count disabled_count")
ATTACHMENT_HEADERS = _table(string="url content_disposition content_type")
PORTAL_PAYLOAD = T.StructType(
    [
        T.StructField(
            "Univdata",
            T.ArrayType(_table(string="ShortName ServiceName CategorytypeName Link WriteFromTime WriteToTime")),
        )
    ]
)
