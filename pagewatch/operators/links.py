"""Links on board pages: candidates, their order, caps and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions import urls
from pagewatch.functions.dates import first_date
from pagewatch.functions.staging import computed_once
from pagewatch.functions.text import any_word, count_words, non_empty, normalize_space
from pagewatch.operators.ordering import drop_layout, sorted_ranges, with_rank


def page_links(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per anchor of a parsed page, with its target and context resolved."""
    rows = parsed.select(*keys, "url", "contexts", F.posexplode("links").alias("pos", "link"))
    return rows.select(
        *keys,
        F.col("url").alias("page_url"),
        "pos",
        "link.*",
        normalize_space(F.get("contexts", F.col("link.context"))).alias("context_text"),
    ).drop("context")


def candidate_links(parsed: DataFrame, board_key: str = "board_idx", keyword_hint: str | None = None) -> DataFrame:
    """Notice links of every board page: title, canonical url and the date shown next to the link.

    A url counts once per board. It is only taken as seen after it passed every
    test, so the tests come before the grouping.
    """
    links = page_links(parsed, [board_key])
    named = F.coalesce(non_empty(F.col("text")), non_empty(F.col("title_attr")), F.col("context_text"))
    target = urls.link_url(F.col("page_url"), F.col("href"), F.col("onclick"), F.col("data_params"))
    resolved = computed_once(links, {"full_url": target, "title": normalize_space(named)})
    titled = resolved.where(
        urls.is_public_http_url(F.col("full_url"))
        & urls.looks_like_notice(F.col("title"), F.col("full_url"), F.col("page_url"), keyword_hint)
    )
    rows = titled.select(
        board_key,
        "pos",
        "title",
        urls.canonical_url(F.col("full_url")).alias("url"),
        first_date(F.col("context_text")).alias("notice_date"),
    )
    return (
        rows.groupBy(board_key, "url")
        .agg(F.min_by(F.struct("pos", "title", "notice_date"), "pos").alias("first"))
        .select(board_key, "first.pos", "first.title", "url", "first.notice_date")
    )


def not_yet_handled(
    candidates: DataFrame, seen: DataFrame | None, as_of: Column | None, max_age: int | None
) -> DataFrame:
    """Drop urls handled before and dated candidates past the age limit; undated ones stay."""
    kept = candidates
    if max_age is not None:
        cutoff = F.date_format(F.date_sub(as_of, max_age), "yyyy-MM-dd")
        kept = kept.where((F.col("notice_date") == "") | (F.col("notice_date") >= cutoff))
    if seen is not None:
        kept = kept.join(seen.select(F.col("key").alias("url")).distinct(), "url", "left_anti")
    return kept


def _newest_first(board_key: str) -> Window:
    return Window.partitionBy(board_key).orderBy(
        (F.col("notice_date") == "").asc(), F.col("notice_date").desc(), F.col("pos").asc()
    )


def capped_frontier(
    candidates: DataFrame, board_key: str = "board_idx", cap: int | None = fv.LINKS_PER_BOARD
) -> DataFrame:
    """The newest ``cap`` candidates of every board, numbered; undated ones come last. Without a cap, all of them.

    The cap is the crawler's own limit. Spark applies it before the shuffle
    (window group limit), so a board with very many links sends ``cap`` rows per task.
    """
    if cap is None:
        return ordered_candidates(candidates, board_key)
    numbered = candidates.withColumn("board_rank", F.row_number().over(_newest_first(board_key)))
    return numbered.where(F.col("board_rank") <= cap)


def ordered_candidates(candidates: DataFrame, board_key: str = "board_idx") -> DataFrame:
    """All candidates of a board numbered newest first, balanced for boards of any size."""
    dated = F.col("notice_date") != ""
    keyed = candidates.withColumns(
        {
            "_undated": ~dated,
            "_newest": F.when(dated, -F.replace("notice_date", F.lit("-"), F.lit("")).cast("bigint")).otherwise(0),
        }
    )
    layout = sorted_ranges(keyed, [board_key], ["_undated", "_newest", "pos"])
    return drop_layout(with_rank(layout, [board_key], "board_rank")).drop("_undated", "_newest")


def round_robin(frontier: DataFrame, board_key: str = "board_idx") -> DataFrame:
    """Interleave boards: every board's first candidate, then every second one, and so on."""
    return frontier.orderBy("board_rank", board_key)


def keyword_probe(pages: DataFrame, words: Sequence[str] = fv.PROBE_WORDS) -> DataFrame:
    """How many of ``words`` each page holds; disabled boards are reported as skipped."""
    enabled = F.coalesce(F.col("enabled"), F.lit(True)) if "enabled" in pages.columns else F.lit(True)
    hits = F.when(enabled, count_words(F.col("html"), words)).otherwise(0)
    return pages.withColumns({"skipped": ~enabled, "keyword_hits": hits}).drop("html")


def discovered_links(
    parsed: DataFrame, board_key: str = "board_idx",
    words: Sequence[str] = fv.DISCOVERY_WORDS, cap: int = fv.DISCOVERED_LINKS, most: int | None = None,
) -> DataFrame:
    """The first ``cap`` anchors per board whose text or url holds one of ``words``; labels whole, or ``most`` characters of them."""
    links = page_links(parsed, [board_key])
    text = normalize_space(F.col("text"))
    target = urls.resolve_reference(F.col("page_url"), F.col("href"))
    rows = computed_once(links, {"text": text, "url": target}).select(board_key, "pos", "text", "url").where(
        any_word(F.lower(F.concat_ws(" ", "text", "url")), [w.lower() for w in words])
    )
    order = Window.partitionBy(board_key).orderBy("pos")
    numbered = rows.withColumn("link_rank", F.row_number().over(order)).where(F.col("link_rank") <= cap)
    return numbered.select(board_key, "link_rank", "text" if most is None else F.left("text", F.lit(most)).alias("text"), "url")
