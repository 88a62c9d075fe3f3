"""Remembered pages: conditional requests and reuse of unchanged content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.durable import for_long_values, stored
from pagewatch.functions.hashing import content_hash
from pagewatch.functions.text import non_empty

REPLACED = ("etag", "last_modified", "content_hash", "checked_at")
KEPT = ("html", "extracted_text")


def page_updates(fetched: DataFrame, seq: str = "seq") -> DataFrame:
    """Fetched pages as state rows, html whole."""
    return fetched.select(
        "url",
        F.coalesce("etag", F.lit("")).alias("etag"),
        F.coalesce("last_modified", F.lit("")).alias("last_modified"),
        content_hash(F.col("content")).alias("content_hash"),
        "checked_at",
        "html",
        "extracted_text",
        seq,
    )


def _sides(state: DataFrame, updates: DataFrame, seq: str, kept: tuple[str, ...]) -> DataFrame:
    """Old and new rows, told apart and put in order by ``_side`` and ``_seq``."""
    fields = ["url", *REPLACED, *kept]
    old = state.select(*fields, F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_seq"))
    return old.unionByName(updates.select(*fields, F.lit(1).alias("_side"), F.col(seq).cast("bigint").alias("_seq")))


def update_headers(state: DataFrame, updates: DataFrame, seq: str, kept: tuple[str, ...]) -> DataFrame:
    """``update_page_state`` of narrow rows: ``kept`` are, of a page store, the keys of its contents."""
    order = F.struct("_side", "_seq")
    return (
        _sides(state, updates, seq, kept)
        .groupBy("url")
        .agg(
            F.max_by(F.struct(*REPLACED), order).alias("_row"),
            *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in kept],
        )
        .select("url", "_row.*", *kept)
    )


def update_page_state(state: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Upsert by url. Header columns are always replaced; html and text survive when not supplied (NULL).

    Headers and the places of the values that survive are found from narrow rows; a
    value goes once from its place to its url, and nothing sorts it: html streams
    past the rows that ask for it. Only urls with several rows of one order go
    through an aggregate of their values. Both inputs are read three times.
    """
    rows, order = _sides(state, updates, seq, KEPT), F.struct("_side", "_seq")
    place = {c: F.struct("_side", "_seq", F.xxhash64(c).alias("_hash")) for c in KEPT}
    narrow = rows.select("url", *REPLACED, "_side", "_seq", *[F.when(F.col(c).isNotNull(), place[c]).alias(f"_{c}") for c in KEPT])
    found = stored(
        narrow.groupBy("url").agg(
            F.max_by(F.struct(*REPLACED), order).alias("_row"),
            *[F.max(f"_{c}").alias(f"_{c}") for c in KEPT],
            (F.count("*") > F.count_distinct(order)).alias("_tied"),
        )
    )
    tied = bool(found.where("_tied").head(1))
    for c in reversed(KEPT):  # html, the widest, comes last and is held by no join
        own = rows.where(F.col(c).isNotNull()).select(F.col("url").alias("_url"), place[c].alias("_own"), c)
        same = F.col("url").eqNullSafe(F.col("_url"))
        for part in ("_side", "_seq", "_hash"):
            same = same & F.col(f"_{c}.{part}").eqNullSafe(F.col(f"_own.{part}"))
        found = found.hint("shuffle_hash").join(own, same, "left").drop("_url", "_own")
    if tied:
        found = found.where("NOT _tied").unionByName(found.where("_tied").dropDuplicates(["url"]))
    return for_long_values(found.select("url", "_row.*", *KEPT))


def most_recent(state: DataFrame, keep: int = fv.KEPT_PAGE_STATES) -> DataFrame:
    """The ``keep`` page states checked last: what a saved cache retains."""
    last = state.select("url", "checked_at").orderBy(F.col("checked_at").desc(), "url").limit(keep)
    return state.join(last, ["url", "checked_at"], "left_semi")


def conditional_headers(state: DataFrame) -> DataFrame:
    return state.select(
        "url",
        non_empty(F.col("etag")).alias("if_none_match"),
        non_empty(F.col("last_modified")).alias("if_modified_since"),
    )


def with_page_reuse(fetched: DataFrame, state: DataFrame, value: str = "html") -> DataFrame:
    """Add ``unchanged`` (same content hash as remembered) and ``cached``, the remembered value.

    Hashes are compared first. Then the fetched rows are held and the remembered
    values stream past them, so ``fetched`` should have no column that is not asked for.
    """
    before = state.select(F.col("url").alias("_url"), F.col("content_hash").alias("_hash")).hint("shuffle_hash")
    rows = fetched.withColumn("content_hash", content_hash(F.col("content"))).join(before, F.col("url") == F.col("_url"), "left")
    rows = rows.withColumn("unchanged", F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))).drop("_url", "_hash")
    values = state.select(F.col("url").alias("_url"), F.col(value).alias("_value"))
    found = rows.hint("shuffle_hash").join(values, F.col("unchanged") & (F.col("url") == F.col("_url")), "left")
    return for_long_values(found.withColumn("cached", F.when(F.col("unchanged"), F.coalesce("_value", F.lit("")))).drop("_url", "_value"))
