"""What is new, what changed, and the durable state behind the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions import rules
from pagewatch.operators.dedupe import first_per_key, item_fingerprint, last_per_key
from pagewatch.operators.ordering import drop_layout, sorted_ranges, with_last_before

STATE_FIELDS = ("content_fingerprint", "grade", "deadline_status", "checked_at")


def seen_keys(seen: DataFrame, previous_results: DataFrame | None = None) -> DataFrame:
    """Handled keys; urls of earlier grade C results count as handled too."""
    keys = seen.select("key")
    if previous_results is not None:
        fallback = previous_results.where((F.col("grade") == "C") & (F.col("url") != ""))
        keys = keys.union(fallback.select(F.col("url").alias("key")))
    return keys.distinct()


def _flag_known(items: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    known = keys.select(F.col("key").alias(column), F.lit(True).alias(name)).distinct()
    return items.join(known, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def mark_is_new(items: DataFrame, seen: DataFrame) -> DataFrame:
    return _flag_known(items.drop("is_new"), seen, "url", "_known").withColumn("is_new", ~F.col("_known")).drop("_known")


def change_type(
    has_previous: Column, known: Column, previous: dict[str, Column], current: dict[str, Column]
) -> Column:
    def differs(field: str) -> Column:
        return ~previous[field].eqNullSafe(current[field])

    return (
        F.when(~has_previous & known, "unchanged")
        .when(~has_previous, "new")
        .when(differs("content_fingerprint"), "content_changed")
        .when(differs("grade"), "grade_changed")
        .when(differs("deadline_status"), "deadline_changed")
        .otherwise("unchanged")
    )


def mark_changes(items: DataFrame, state: DataFrame, seen: DataFrame) -> DataFrame:
    """Add ``change_type`` and ``previous_grade`` against the state of earlier runs.

    State and seen hold one row per url, so a hot url is skewed on the item side
    only, which adaptive execution splits.
    """
    return mark_run(items, state, seen, keep_is_new=True)


def mark_run(items: DataFrame, state: DataFrame, seen: DataFrame, keep_is_new: bool = False) -> DataFrame:
    """``is_new``, ``change_type`` and ``previous_grade`` from one look at the seen keys and one at the state."""
    compared = ("content_fingerprint", "grade", "deadline_status")
    previous = state.where(F.col("url") != "").select(
        "url", F.lit(True).alias("_has"), *[F.col(c).alias(f"_p_{c}") for c in compared]
    )
    rows = _flag_known(items.drop("change_type", "previous_grade"), seen, "url", "_known")
    if not keep_is_new:
        rows = rows.withColumn("is_new", ~F.col("_known"))
    rows = rows.join(previous, "url", "left")
    return rows.withColumns(
        {
            "change_type": change_type(
                F.coalesce("_has", F.lit(False)),
                F.col("_known"),
                {c: F.col(f"_p_{c}") for c in compared},
                {c: F.col(c) for c in compared},
            ),
            "previous_grade": F.coalesce("_p_grade", F.lit("")),
        }
    ).drop("_known", "_has", *[f"_p_{c}" for c in compared])


def changes_across_runs(snapshots: DataFrame, run: str = "run") -> DataFrame:
    """Change type of every (url, run) against the run in which the url was seen last.

    The table form of ``mark_changes`` for a history of runs, one row per url and run.
    """
    compared = ("content_fingerprint", "grade", "deadline_status")
    layout = sorted_ranges(snapshots, ["url"], [run])
    before = F.struct(*compared)
    marked = drop_layout(with_last_before(layout, ["url"], {"_before": before}))
    kind = change_type(
        F.col("_before").isNotNull(),
        F.lit(False),
        {c: F.col(f"_before.{c}") for c in compared},
        {c: F.col(c) for c in compared},
    )
    return marked.withColumns(
        {"change_type": kind, "previous_grade": F.coalesce("_before.grade", F.lit(""))}
    ).drop("_before")


def update_notice_state(state: DataFrame, items: DataFrame, seq: str = "seq") -> DataFrame:
    """Upsert by url: rows not observed stay, within a run the last row wins, blank urls are skipped."""
    fields = ["url", *STATE_FIELDS]
    old = state.select(*fields, F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_seq"))
    new = items.where(F.col("url") != "").select(
        *fields, F.lit(1).alias("_side"), F.col(seq).cast("bigint").alias("_seq")
    )
    return last_per_key(old.unionByName(new), F.col("url"), F.struct("_side", "_seq")).select(*fields)


def update_seen(seen: DataFrame, handled: DataFrame, key: str = "url") -> DataFrame:
    return seen.select("key").union(handled.select(F.col(key).alias("key"))).distinct()


def items_to_mark_seen(
    items: DataFrame, sent: DataFrame, as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS, seq: str = "seq"
) -> DataFrame:
    """Sent rows, then new rows that will never alert, first one per url and only urls not sent."""
    quiet = items.where(
        rules.marks_seen(F.col("is_new"), F.col("url"), F.col("grade"), F.col("notice_date"), as_of, max_age)
    )
    quiet = quiet.join(sent.select("url").distinct(), "url", "left_anti").select(*items.columns)
    first = first_per_key(quiet, F.col("url"), seq)
    return sent.select(*items.columns).unionByName(first)


def items_to_update_state(
    items: DataFrame, sent: DataFrame, as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS
) -> DataFrame:
    """All rows except alert targets that were not sent: those stay changed until they are."""
    target = rules.is_alert_target(
        F.col("change_type"), F.col("is_new"), F.col("grade"), F.col("deadline_status"), F.col("notice_date"),
        as_of, max_age,
    )
    delivered = sent.select("url", F.lit(True).alias("_sent")).distinct()
    rows = items.join(delivered, "url", "left")
    return rows.where(~target | F.col("_sent").isNotNull()).select(*items.columns)


def mark_graduate_new(items: DataFrame, seen: DataFrame, previous_results: DataFrame, seq: str = "seq") -> DataFrame:
    """Newness by content: a known fingerprint is old, an unknown url is new, a known url is new when it changed."""
    keyed = items.drop("is_new").withColumn("_fp", item_fingerprint(items))
    before = previous_results.where(F.col("url") != "")
    before = before.select("url", F.col(seq).alias("_seq"), item_fingerprint(before).alias("_previous"))
    latest = before.groupBy("url").agg(F.max_by("_previous", "_seq").alias("_previous"))
    rows = _flag_known(keyed, seen, "_fp", "_known_fp")
    rows = _flag_known(rows, seen, "url", "_known_url").join(latest, "url", "left")
    is_new = (
        F.when(F.col("_known_fp"), False)
        .when((F.col("url") == "") | ~F.col("_known_url"), True)
        .when(F.col("_previous").isNull(), False)
        .otherwise(F.col("_previous") != F.col("_fp"))
    )
    return rows.withColumn("is_new", is_new).drop("_fp", "_known_fp", "_known_url", "_previous")


def coverage_gaps(results: DataFrame, seen: DataFrame, state: DataFrame) -> DataFrame:
    """How many result urls the seen set and the state table miss; both are 0 after a sound bootstrap."""
    known = seen.select(F.col("key").alias("url"), F.lit(True).alias("_seen")).distinct()
    stated = state.select("url", F.lit(True).alias("_stated")).distinct()
    rows = results.select("url").distinct().join(known, "url", "left").join(stated, "url", "left")
    return rows.agg(
        F.count_if(F.col("_seen").isNull()).alias("missing_seen"),
        F.count_if(F.col("_stated").isNull()).alias("missing_state"),
    )
