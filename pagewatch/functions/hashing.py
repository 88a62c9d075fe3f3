"""Keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions.text import normalize_space, strip


def content_fingerprint(title: Column, text: Column, attachments: Column, images: Column) -> Column:
    """sha256 over title, text and both sorted url lists, one element per line."""
    parts = F.concat(F.array(title, text), F.sort_array(attachments), F.sort_array(images))
    return F.sha2(F.array_join(parts, "\n"), 256)


def normalized_title(title: Column) -> Column:
    """Lower-cased title without brackets, years and term words."""
    bare = F.regexp_replace(F.lower(title), fv.TITLE_BRACKETS_PATTERN, " ")
    return normalize_space(F.regexp_replace(bare, fv.TITLE_TERMS_PATTERN, " "))


def title_key(university: Column, title: Column) -> Column:
    return F.sha1(F.concat_ws("::", university, title))


def notice_key(url: Column, university: Column, title: Column, attachments: Column) -> Column:
    """Dedupe key: url (or title key when blank) followed by the joined attachments."""
    base = F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(title_key(university, title))
    return F.concat(base, F.array_join(attachments, "|"))


def _clean_list(values: Column) -> Column:
    return F.array_join(F.sort_array(F.filter(F.transform(values, lambda v: strip(v)), lambda v: v != "")), "|")


def graduate_fingerprint(
    university: Column, board_type: Column, title: Column, notice_date: Column,
    matched: Column, attachments: Column,
) -> Column:
    """Identity of a graduate notice; portal rows carry no date of their own."""
    is_portal = F.contains(board_type, F.lit(fv.PORTAL_MARK))
    return F.sha1(
        F.concat_ws(
            "::", university, board_type, normalized_title(title),
            F.when(is_portal, F.lit("")).otherwise(notice_date),
            _clean_list(matched), _clean_list(attachments),
        )
    )


def delivery_id(chat_id: Column, logical_key: Column) -> Column:
    return F.sha2(F.concat_ws("\n", chat_id, logical_key), 256)


def candidate_key(namespace: str, row: dict[str, Column]) -> Column:
    """Logical delivery key of one notice. ``row`` maps field names to columns."""
    def text(name: str) -> Column:
        return F.coalesce(row[name].cast("string"), F.lit("")) if name in row else F.lit("")

    date = F.lit("") if namespace == "graduate-portal" else text("notice_date")
    attachments = (
        F.array_join(F.sort_array(row["attachment_urls"]), "|") if "attachment_urls" in row else F.lit("")
    )
    joined = F.concat_ws(
        "\n", F.lit(namespace), text("url"), text("content_fingerprint"), text("change_type"),
        text("grade"), text("deadline_status"), date, text("title"), attachments,
    )
    return F.concat(F.lit(f"{namespace}-candidate:"), F.sha2(joined, 256))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
