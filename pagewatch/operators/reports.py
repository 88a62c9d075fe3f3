"""Run summary, report views, previews and portal digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions import rules
from pagewatch.functions.dates import is_recent
from pagewatch.functions.hashing import candidate_key
from pagewatch.functions.text import non_empty
from pagewatch.operators.dedupe import item_fingerprint
from pagewatch.operators.ordering import drop_layout, sorted_ranges, with_position

UNKNOWN = "unknown"


def counts_by(items: DataFrame, key: str) -> DataFrame:
    label = F.coalesce(non_empty(F.col(key).cast("string")), F.lit(UNKNOWN))
    return items.groupBy(label.alias(key)).agg(F.count("*").alias("n"))


def _counts_map(column: str, values: tuple[str, ...]) -> Column:
    """Counts of a closed value list in one pass; absent values are left out."""
    value = F.coalesce(F.col(column), F.lit(""))
    pairs: list[Column] = []
    for name in values:
        pairs += [F.lit(name), F.count_if(value == name)]
    pairs += [F.lit(UNKNOWN), F.count_if(~value.isin(*values))]
    return F.map_filter(F.create_map(*pairs), lambda k, n: n > 0)


def _alert_target(as_of: Column, max_age: int) -> Column:
    return rules.is_alert_target(
        F.col("change_type"), F.col("is_new"), F.col("grade"), F.col("deadline_status"), F.col("notice_date"),
        as_of, max_age,
    )


def run_summary(
    items: DataFrame, as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS, **run_facts: Column
) -> DataFrame:
    """One row: item counts and distributions, plus the run facts handed in (check time, crawl counters)."""
    return items.agg(
        F.count("*").alias("deduped_count"),
        F.count_if(F.col("grade") != "D").alias("public_count"),
        F.count_if(_alert_target(as_of, max_age)).alias("candidate_count"),
        _counts_map("grade", fv.GRADE_ORDER).alias("grade_counts"),
        _counts_map("deadline_status", fv.REPORT_STATUS_ORDER).alias("status_counts"),
    ).withColumns(run_facts)


def with_lists(
    summary: DataFrame, items: DataFrame, failures: DataFrame | None, as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS,
    shown: int = 5, seq: str = "seq",
) -> DataFrame:
    """The summary row with ``preview_items``, ``failed_boards`` and ``failed_details``: the first ``shown`` of each."""
    place = F.struct(F.col(seq), "grade", "university_name", "title", "url")
    top = preview(items, as_of, max_age, shown, seq).agg(F.collect_list(place).alias("_shown"))
    ordered = F.sort_array(F.transform("_shown", lambda i: F.struct(rules.grade_rank(i["grade"]).alias("rank"), i[seq].alias("at"), i.alias("item"))))
    out = summary.join(top, F.lit(True)).withColumn("preview_items", F.transform(ordered, lambda i: i["item"].dropFields(seq))).drop("_shown")
    fields = ("university_name", "board_type", "url", "error")
    for kind, name in (("board", "failed_boards"), ("detail", "failed_details")):
        none = F.array().cast(f"array<struct<{', '.join(f'{f}:string' for f in fields)}>>")
        if failures is None:
            out = out.withColumn(name, none)
            continue
        first = failures.where(F.col("kind") == kind).orderBy("_board", "_seq", "url").limit(shown)
        listed = first.agg(F.sort_array(F.collect_list(F.struct("_board", "_seq", *fields))).alias("_listed"))
        out = out.join(listed, F.lit(True)).withColumn(name, F.transform("_listed", lambda i: F.struct(*[i[f].alias(f) for f in fields]))).drop("_listed")
    return out


def report_header(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("grade") == "A").alias("grade_a"),
        F.count_if(F.col("grade") == "B").alias("grade_b"),
        F.count_if(F.col("is_new")).alias("new"),
    )


def board_activity(boards: DataFrame) -> DataFrame:
    enabled = F.coalesce(F.col("enabled"), F.lit(True))
    return boards.agg(F.count_if(enabled).alias("active_count"), F.count_if(~enabled).alias("disabled_count"))


def course_report(items: DataFrame, seq: str = "seq") -> DataFrame:
    """Public rows by grade, then deadline status, then university."""
    return items.where(F.col("grade") != "D").orderBy(
        rules.grade_rank(F.col("grade")), rules.status_rank(F.col("deadline_status")), "university_name", seq
    )


def graduate_report(items: DataFrame, seq: str = "seq") -> DataFrame:
    return items.orderBy(rules.grade_rank(F.col("grade")), "university_name", "title", seq)


def preview(
    items: DataFrame, as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS, limit: int = 5, seq: str = "seq"
) -> DataFrame:
    """The first changed, recent A rows, then B rows, in item order: a top-k report."""
    shown = items.where(
        F.col("grade").isin("A", "B")
        & rules.is_changed(F.col("change_type"), F.col("is_new"))
        & is_recent(F.col("notice_date"), as_of, max_age)
    )
    return shown.orderBy(rules.grade_rank(F.col("grade")), seq).limit(limit)


def delivery_key(items: DataFrame, namespace: str) -> Column:
    return candidate_key(namespace, {c: F.col(c) for c in items.columns})


def portal_digests(items: DataFrame, size: int = fv.DIGEST_SIZE, seq: str = "seq") -> DataFrame:
    """Portal rows cut into messages of ``size`` rows in delivery-key order, with the key of each message."""
    keyed = items.select(seq, "title", "url", delivery_key(items, "graduate-portal").alias("item_key"))
    layout = sorted_ranges(keyed, ["item_key"], [seq])
    placed = drop_layout(with_position(layout))
    batch = F.floor((F.col("position") - 1) / size)
    batches = placed.groupBy(batch.alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct("position", "item_key", "title", "url"))).alias("items")
    )
    joined = F.array_join(F.transform("items", lambda i: i["item_key"]), "\n")
    return batches.select(
        "batch", "items", F.concat(F.lit("graduate-portal:"), F.sha2(joined, 256)).alias("digest_key")
    )


def set_fingerprint(items: DataFrame, active_count: int, disabled_count: int) -> DataFrame:
    """One row telling whether the set of graduate items is the one of an earlier run.

    The item fingerprints are cut in three and each part is summed over all
    items: sums combine in the tasks, don't depend on order, and count repeats.
    The value is only compared with itself.
    """
    prints = items.select(item_fingerprint(items).alias("fp"))

    def part(start: int, length: int) -> Column:
        number = F.conv(F.substring("fp", start, length), 16, 10).cast("decimal(38,0)")
        return F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").cast("string")

    row = prints.agg(F.count("*").alias("candidate_count"), part(1, 13).alias("a"), part(14, 13).alias("b"), part(27, 14).alias("c"))
    head = F.lit(f"{active_count}::{disabled_count}")
    return row.select(
        F.sha1(F.concat_ws("::", head, F.col("candidate_count").cast("string"), "a", "b", "c")).alias("fingerprint"),
        "candidate_count",
        F.lit(active_count).cast("bigint").alias("active_count"),
        F.lit(disabled_count).cast("bigint").alias("disabled_count"),
    )


def sends_empty_summary(current: DataFrame, stored: DataFrame) -> DataFrame:
    """The current fingerprint row with ``send``: false when the stored state already reports this set."""
    known = stored.select("fingerprint", F.lit(True).alias("_known")).distinct()
    return current.join(known, "fingerprint", "left").withColumn("send", F.col("_known").isNull()).drop("_known")
