"""The course watch as one lazy plan over fetched pages and durable state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv, schemas
from pagewatch.durable import stored
from pagewatch.functions import dates, hashing, rules, scoring
from pagewatch.operators import attachments as att
from pagewatch.operators import changes, courses, dedupe, details, health, links, page_parse, reports
from pagewatch.sources.config import mark_skipped
from pagewatch.sources.pages import latest_fetch
from pagewatch.sources.tableset import Keyed, TableSet, Version
from pagewatch.streaming import watch


#: A notice's place is its board and its rank on it; a board has fewer links than this many bits count.
RANK_BITS = 32


@dataclass
class CourseRun:
    """What a run produces; every member is a DataFrame derived from the same stored items."""

    items: DataFrame
    counters: DataFrame
    failures: DataFrame


def classified(
    notices: DataFrame, vocabulary: scoring.Vocabulary, as_of: Column,
    exclusion_terms: tuple[str, ...] = fv.HARD_EXCLUSION_TERMS,
) -> DataFrame:
    """Dates, scores, grade and reason from the ``sources`` array of each notice."""
    dated = dates.with_dates(notices, F.col("sources"), as_of)
    dated = dated.withColumn("combined_text", att.combined_text(F.col("sources")))
    return scoring.with_classification(dated, vocabulary, text="combined_text", exclusion_terms=exclusion_terms)


def demoted(items: DataFrame) -> DataFrame:
    """Weak grade C rows become D with their own reason."""
    weak = rules.is_weak_c(F.col("grade"), F.col("title"))
    return items.withColumns(
        {
            "reason": F.when(weak, fv.REASON_WEAK_C).otherwise(F.col("reason")),
            "grade": F.when(weak, "D").otherwise(F.col("grade")),
        }
    )


def needs_attachments(notices: DataFrame, vocabulary: scoring.Vocabulary, as_of: Column) -> DataFrame:
    """``parses_attachments`` per notice, from a first grade on title and body alone."""
    first = notices.withColumn(
        "sources", att.text_sources(F.col("body_text"), F.array().cast("array<struct<url:string,text:string>>"))
    )
    graded = classified(first, vocabulary, as_of)
    return graded.select(
        "seq", rules.parses_attachments(F.col("title"), F.col("grade")).alias("parses_attachments")
    )


def graded_items(
    notices: DataFrame, universities: DataFrame, vocabulary: scoring.Vocabulary,
    attachment_texts: DataFrame | None, as_of: Column, checked_at: Column, image_texts: DataFrame | None = None,
) -> DataFrame:
    """Result rows (before dedupe and change detection) of trusted notices.

    ``attachment_texts`` and ``image_texts`` are (url, text) tables. Image texts
    count only for notices graded A or B without them.
    """
    none = F.array().cast("array<struct<url:string,text:string>>")
    if attachment_texts is None:
        texted = notices.withColumn("attachment_texts", none)
    else:
        gate = needs_attachments(notices, vocabulary, as_of)
        gated = notices.join(gate, "seq")
        own = gated.where("parses_attachments").select("seq", "attachment_urls")
        found = att.with_attachment_texts(own, attachment_texts).select("seq", "attachment_texts")
        texted = gated.join(found, "seq", "left").withColumn("attachment_texts", F.coalesce("attachment_texts", none))
    sourced = texted.withColumn("sources", att.text_sources(F.col("body_text"), F.col("attachment_texts")))
    graded = classified(sourced, vocabulary, as_of).withColumns(
        {
            "ocr_checked": F.lit(False),
            "ocr_text_found": F.lit(False),
            "ocr_evidence": F.create_map().cast("map<string,string>"),
        }
    )
    if image_texts is not None:
        graded = _regraded_with_images(graded, image_texts, vocabulary, as_of)
    places = universities.select(
        F.col("name").alias("university_name"),
        F.coalesce("region_name", "region", F.lit("")).alias("region"),
        F.coalesce("city", F.lit("")).alias("city"),
    )
    blank, empty = F.lit(""), F.array().cast("array<string>")
    placed = graded.join(places, "university_name", "left").withColumns(
        {
            "region": F.coalesce("region", blank),
            "city": F.coalesce("city", blank),
            "checked_at": checked_at,
            "source_type": F.lit(fv.COURSE_SOURCE_TYPE),
            "source_query": F.col("board_type"),
            "content_fingerprint": hashing.content_fingerprint(
                F.col("title"), F.col("combined_text"), F.col("attachment_urls"), F.col("image_urls")
            ),
            "possible_departments": empty,
            "possible_computer_courses": empty,
            "course_evidence_url": blank,
            "course_evidence_text": blank,
            "change_type": blank,
            "previous_grade": blank,
            "is_new": F.lit(False),
        }
    )
    return demoted(placed).select("seq", *fv.RESULT_FIELDS)


def _regraded_with_images(
    graded: DataFrame, image_texts: DataFrame, vocabulary: scoring.Vocabulary, as_of: Column
) -> DataFrame:
    wants = rules.reads_images(F.col("grade"), F.col("image_urls"))
    chosen = graded.where(wants)
    as_files = chosen.select("seq", F.col("image_urls").alias("attachment_urls"))
    found = att.with_attachment_texts(as_files, image_texts).select("seq", F.col("attachment_texts").alias("_ocr"))
    scored = ["combined_text", "registration_score", "external_score", "computer_score", "freshness_score",
              "grade", "external_applicant_status", "computer_course_status", "matched_keywords", "reason",
              "application_start_date", "application_end_date", "deadline_status", "date_source", "date_conflict"]
    named = F.transform(
        "_ocr", lambda o: F.struct(F.concat(F.lit(fv.SOURCE_OCR_PREFIX), o["url"]).alias("name"), o["text"].alias("text"))
    )
    evidence = F.map_from_entries(F.transform("_ocr", lambda o: F.struct(o["url"], o["text"])))
    again = chosen.join(found, "seq").withColumns(
        {
            "sources": F.concat("sources", named),
            "ocr_checked": F.lit(True),
            "ocr_text_found": F.size("_ocr") > 0,
            "ocr_evidence": evidence,
        }
    )
    again = classified(again.drop(*scored), vocabulary, as_of).drop("_ocr")
    return graded.where(~wants).unionByName(again.select(*graded.columns))


def crawl(
    pages: DataFrame, boards: DataFrame, universities: DataFrame, as_of: Column, *,
    seen: DataFrame | None = None, keyword_hint: str | None = None,
    cap: int | None = None, max_age: int | None = fv.DEFAULT_MAX_AGE_DAYS,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages to notices: ``(notices, board outcomes, failures, parsed pages)``.

    ``pages`` is (page_id, url, html); of several fetches of a url that with the
    greatest page_id, the latest, counts. Without ``cap`` all links of a board are
    followed. The parsed pages are stored once, because
    board links, detail bodies and course evidence all read them.
    """
    parsed = stored(page_parse.parse_pages(latest_fetch(pages)))
    known = mark_skipped(boards, universities)
    active = known.where(~F.col("skipped"))
    fetched = parsed.select("url", "contexts", "links", "parse_error")
    board_pages = active.join(fetched, "url", "left")
    candidates = stored(
        links.candidate_links(board_pages.where(F.col("links").isNotNull()), keyword_hint=keyword_hint)
    )
    fresh = links.not_yet_handled(candidates, seen, as_of, max_age)
    per_board = candidates.select("board_idx", F.lit(1).alias("n")).union(fresh.select("board_idx", F.lit(-1).alias("n")))
    skipped = per_board.groupBy("board_idx").agg(F.sum("n").alias("details_skipped"))
    frontier = links.capped_frontier(fresh, cap=cap)
    labels = active.select("board_idx", "university_name", "board_type")
    # The details feed the counters and the notices, so they are fixed once.
    notices = stored(
        details.crawled_notices(frontier.join(labels, "board_idx"), parsed).withColumn(
            "seq", F.shiftleft(F.col("board_idx").cast("bigint"), RANK_BITS) + F.col("board_rank")
        )
    )
    errors = board_pages.select(
        "board_idx",
        F.when(F.col("links").isNull(), F.coalesce("parse_error", F.lit("no page"))).otherwise("").alias("error"),
    )
    outcomes = health.board_outcomes(
        known.join(errors, "board_idx", "left"), notices.withColumnRenamed("detail_succeeded", "succeeded")
    )
    outcomes = outcomes.join(skipped, "board_idx", "left").withColumn(
        "details_skipped", F.coalesce("details_skipped", F.lit(0).cast("bigint"))
    )
    failed = health.failures(outcomes, notices.withColumnRenamed("detail_succeeded", "succeeded"))
    return notices, outcomes, failed, parsed


def run(
    pages: DataFrame, boards: DataFrame, universities: DataFrame, vocabulary: scoring.Vocabulary,
    words: courses.CourseWords, *, seen: DataFrame, state: DataFrame, as_of: Column, checked_at: Column,
    attachment_texts: DataFrame | None = None, image_texts: DataFrame | None = None,
    keyword_hint: str | None = None, cap: int | None = None,
    max_age: int = fv.DEFAULT_MAX_AGE_DAYS,
) -> CourseRun:
    notices, outcomes, failed, parsed = crawl(
        pages, boards, universities, as_of, keyword_hint=keyword_hint, cap=cap, max_age=max_age
    )
    counters = health.run_counters(outcomes)
    kept = health.trusted(notices, counters)
    items = graded_items(
        kept, universities, vocabulary, attachment_texts, as_of, checked_at, image_texts
    )
    items = stored(items)
    wanted = courses.wanted_pages(items, universities)
    evidence = courses.find_evidence(parsed.join(wanted, "url", "left_semi"), words)
    unique = dedupe.dedupe_notices(stored(courses.enrich(items, universities, evidence, words)))
    marked = changes.mark_run(unique, state, seen)
    # Results, alerts, seen and state updates all start from the same rows.
    return CourseRun(stored(marked), counters, failed)


@dataclass
class RunEnd:
    """What a run leaves behind: DataFrames over the run's stored items."""

    results: DataFrame
    targets: DataFrame
    history: DataFrame
    state: DataFrame
    seen: DataFrame
    summary: DataFrame


def finish(
    items: DataFrame, *, history: DataFrame, state: DataFrame, seen: DataFrame, as_of: Column, checked_at: Column,
    deliver: Callable[[DataFrame], DataFrame], counters: DataFrame | None = None, at_least: str | None = None,
    max_age: int = fv.DEFAULT_MAX_AGE_DAYS, failures: DataFrame | None = None, facts: dict[str, int] | None = None,
) -> RunEnd:
    """The end of a run: results, alert targets handed out, then history, state and seen as they become.

    ``deliver`` gets the targets and returns the rows sent; rows not sent leave
    no trace in the state and are targets again next time. ``at_least`` narrows
    the results and the targets to grades, but not what the state remembers. The
    summary has counts, distributions, the crawl counters, ``facts`` (numbers that
    the caller knows, such as ``university_count`` and ``crawled_count``), a preview
    and the first failed boards and details.
    """
    graded = items if at_least is None else items.where(rules.at_least(F.col("grade"), at_least))
    target = rules.is_alert_target(
        F.col("change_type"), F.col("is_new"), F.col("grade"), F.col("deadline_status"), F.col("notice_date"), as_of, max_age
    )
    targets = graded.where(target)
    sent = stored(deliver(targets))
    settled = changes.items_to_update_state(items, sent, as_of, max_age)
    handled = changes.items_to_mark_seen(items, sent, as_of, max_age)
    # one row of counters and one number
    facts = (facts or {}) | ({} if counters is None else counters.head().asDict()) | {"sent_count": sent.count()}
    summary = reports.run_summary(
        graded, as_of, max_age, checked_at=checked_at, **{name: F.lit(n).cast("bigint") for name, n in facts.items()}
    )
    summary = reports.with_lists(summary, graded, failures, as_of, max_age)
    return RunEnd(
        graded,
        targets,
        dedupe.merge_history(history, dedupe.history_rows(graded)),
        changes.update_notice_state(state, settled),
        changes.update_seen(seen, handled),
        summary,
    )


#: What runs of the course watch keep: notice state, seen urls and history change in one commit.
COURSE_TABLES = {**watch.RUN_TABLES, "history": Keyed(schemas.KEYED_HISTORY, "key")}


def run_and_commit(
    store: TableSet, run_id: int, deliver: Callable[[DataFrame], DataFrame], pages: DataFrame, boards: DataFrame,
    universities: DataFrame, vocabulary: scoring.Vocabulary, words: courses.CourseWords, *, as_of: Column, checked_at: Column,
    recover: Callable[[DataFrame], DataFrame] | None = None, **options,
) -> Version | None:
    """A whole run against the tables of ``store`` (``COURSE_TABLES``), from pages to its commit.

    Targets are handed to ``deliver`` at most once, after an intent is durable, and
    results, history, state and seen become current together: see
    ``watch.run_once``. A run whose items were recorded before it died goes on from
    them and crawls nothing again. None if the run was committed before. Only the
    buckets that the run's rows fall into are rewritten.
    """
    if store.has_batch(run_id):
        return None
    if watch.has_intent(store, run_id):
        items = store.read("state").limit(0)  # not looked at: the recorded rows count
    else:
        version = store.current()
        items = run(
            pages, boards, universities, vocabulary, words, seen=store.read("seen", version), state=store.read("state", version),
            as_of=as_of, checked_at=checked_at, **options,
        ).items
    return watch.run_once(items, run_id, store, deliver, as_of, recover=recover)


def results(store: TableSet, run_id: int) -> DataFrame:
    """The marked rows of a committed run."""
    return store.spark.read.parquet(f"{store.path}/{store.current().tables['results'][str(run_id)]}")
