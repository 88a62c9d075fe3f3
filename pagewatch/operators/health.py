"""Crawl coverage: counters, per-board outcome, the health gate and the failure list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class CrawlHealthError(RuntimeError):
    """Too few boards succeeded to trust the result."""


def board_outcomes(boards: DataFrame, details: DataFrame, board_key: str = "board_idx") -> DataFrame:
    """Outcome per board from ``boards(.., skipped, error)`` and ``details(.., succeeded)``.

    A board fails when its page failed or when it had candidates and none of
    their details succeeded; a board without candidates succeeds.
    """
    counts = details.groupBy(board_key).agg(
        F.count("*").alias("details_total"), F.count_if(~F.col("succeeded")).alias("details_failed")
    )
    zero = F.lit(0).cast("bigint")
    rows = boards.join(counts, board_key, "left").withColumns(
        {
            "details_total": F.coalesce("details_total", zero),
            "details_failed": F.coalesce("details_failed", zero),
        }
    )
    all_failed = (F.col("details_total") > 0) & (F.col("details_failed") == F.col("details_total"))
    fetched = F.coalesce("error", F.lit("")) == ""
    return rows.withColumns(
        {
            "outcome": F.when(F.col("skipped"), "skipped").when(~fetched | all_failed, "failed").otherwise("succeeded"),
            "error": F.when(
                fetched & all_failed, F.format_string("All %d detail pages failed.", "details_total")
            ).otherwise(F.coalesce("error", F.lit(""))),
        }
    )


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Counters of a run; ``details_skipped`` too where the outcomes carry it."""
    skipped = [F.coalesce(F.sum("details_skipped"), F.lit(0)).alias("details_skipped")] if "details_skipped" in outcomes.columns else []
    return outcomes.agg(
        F.count("*").alias("boards_total"),
        F.count_if(F.col("outcome") == "succeeded").alias("boards_succeeded"),
        F.count_if(F.col("outcome") == "failed").alias("boards_failed"),
        F.count_if(F.col("outcome") == "skipped").alias("boards_skipped"),
        F.coalesce(F.sum("details_total"), F.lit(0)).alias("details_total"),
        F.coalesce(F.sum("details_failed"), F.lit(0)).alias("details_failed"),
        *skipped,
    )


def health_verdict(succeeded: Column, failed: Column) -> Column:
    """``ok`` while successes outnumber failures or nothing was attempted."""
    return (
        F.when(succeeded + failed == 0, "ok")
        .when(succeeded == 0, "all boards failed")
        .when(failed >= succeeded, "below safe majority")
        .otherwise("ok")
    )


def require_healthy(counters: DataFrame) -> None:
    row = counters.select(
        health_verdict(F.col("boards_succeeded"), F.col("boards_failed")).alias("verdict"),
        "boards_succeeded", "boards_failed",
    ).head()
    if row.verdict != "ok":
        raise CrawlHealthError(f"{row.verdict}: {row.boards_succeeded} succeeded, {row.boards_failed} failed")


def trusted(notices: DataFrame, counters: DataFrame) -> DataFrame:
    """Notices whose detail succeeded, once the run as a whole passed the gate."""
    require_healthy(counters)
    return notices.where("detail_succeeded")


def failures(outcomes: DataFrame, details: DataFrame, board_key: str = "board_idx") -> DataFrame:
    """Failed boards, then failed details, each in crawl order."""
    fields = ["university_name", "board_type", "url", "error"]
    zero = F.lit(0).cast("bigint")
    boards = outcomes.where(F.col("outcome") == "failed").select(
        F.lit("board").alias("kind"), F.col(board_key).alias("_board"), zero.alias("_seq"), *fields
    )
    rows = details.where(~F.col("succeeded")).select(
        F.lit("detail").alias("kind"), F.col(board_key).alias("_board"), F.col("seq").alias("_seq"), *fields
    )
    return boards.unionByName(rows)


def failure_list(failed: DataFrame, shown: int = 5) -> DataFrame:
    """The first ``shown`` failures as report lines, and one row with the number left out."""
    line = F.regexp_extract("error", r"^([^\r\n]*)", 1)
    line = F.when(F.length(line) > 120, F.concat(F.left(line, F.lit(117)), F.lit("..."))).otherwise(line)
    first = failed.orderBy("kind", "_board", "_seq", "url").limit(shown)
    lines = first.select("kind", "url", F.concat(
        F.col("university_name"), F.lit(" / "), F.col("board_type"), F.lit(": "), line
    ).alias("line"), F.lit(0).cast("bigint").alias("left_out"))
    rest = failed.agg((F.count("*") - shown).alias("left_out")).where("left_out > 0")
    return lines.unionByName(rest, allowMissingColumns=True)
