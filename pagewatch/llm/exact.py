"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Null texts count as empty, and texts are equal when they are after each run of
white space has become one space. The row with the smallest id stays (a null id
is the largest); of repeated rows with that id one stays. An empty table gives
an empty result. Only the id and the text are read, so other columns may have
any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pagewatch.durable import stored
from pagewatch.llm.common import SPACES, fresh, text_of

PREFIX_CHARS = 128


def normal_text(column: str):
    return F.regexp_replace(text_of(column), SPACES, " ")


def _keys(docs: DataFrame, doc_id: str, text: str, prefix_chars: int, digest: bool) -> DataFrame:
    normal = docs.select(F.col(doc_id).alias("id"), normal_text(text).alias("normal"))
    columns = ["id", F.length("normal").alias("length"), F.xxhash64(F.substring("normal", 1, prefix_chars)).alias("prefix")]
    return normal.select(*columns, *([F.sha2("normal", 256).alias("digest")] if digest else []))


def _shared_prefixes(keys: DataFrame) -> DataFrame:
    """The (length, prefix hash) of groups of several rows."""
    return keys.groupBy("length", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("length", "prefix")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False
) -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, kept.

    Rows whose length no other row has end their search; of the others, rows whose
    prefix hash no other row of that length has; the rest are compared by their full
    hash. One aggregate over (length, prefix hash) takes both first steps, since a
    pair that occurs twice is of a length that does, and a common length does not
    come to one task. Without ``digest_all`` the full hash is taken in a second scan,
    of surviving groups alone, and is null elsewhere. With it, the caller wants every
    row's hash: the first scan, which has the text at hand, takes it, and the
    refinement runs on the stored keys.

    Every group is counted where its rows are before anything is shuffled. The
    joins carry keys, never texts (but for the second scan), and a hot key on
    their row side is one that Spark can split.
    """
    keys = stored(_keys(docs, doc_id, text, prefix_chars, digest_all).withColumn("row", F.monotonically_increasing_id()))
    prefixes = _shared_prefixes(keys)
    if digest_all:
        rows = keys
        survivors = keys.join(prefixes, ["length", "prefix"], "left_semi")
    else:
        prefixes = stored(prefixes)
        full = _keys(docs, doc_id, text, prefix_chars, True).join(prefixes, ["length", "prefix"], "left_semi")
        survivors = stored(full.withColumn("row", F.monotonically_increasing_id()))
        single = keys.join(prefixes, ["length", "prefix"], "left_anti").withColumn("digest", F.lit(None).cast("string"))
        rows = survivors.unionByName(single)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = (
        survivors.groupBy("length", "prefix", "digest")
        .agg(F.count("*").alias("size"), first.alias("first"))
        .filter("size > 1")
    )
    found = rows.join(groups, ["length", "prefix", "digest"], "left")
    alone = F.col("size").isNull()
    return found.select(
        "id",
        "digest",
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows outside surviving groups of (length, prefix hash) stay as they are: their
    texts are neither hashed in full nor moved by a group. A surviving group's rows
    are found by id, length and prefix hash, hashed in full, and cut to one per
    hash, in every task before any shuffle and once more after it: the smallest id
    (null last), of repeated rows with that id any one.
    """
    length, prefix, digest, number = fresh(docs, "length", "prefix", "digest", "number")
    its_id, its_length, its_prefix = fresh(docs, "its_id", "its_length", "its_prefix")
    keys = stored(_keys(docs, doc_id, text, prefix_chars, False))
    suspects = keys.join(_shared_prefixes(keys), ["length", "prefix"], "left_semi")
    suspects = stored(suspects.select(F.col("id").alias(its_id), F.col("length").alias(its_length), F.col("prefix").alias(its_prefix)))
    rows = docs.withColumns(
        {length: F.length(normal_text(text)), prefix: F.xxhash64(F.substring(normal_text(text), 1, prefix_chars))}
    )
    same = (
        F.col(doc_id).eqNullSafe(F.col(its_id)) & (F.col(length) == F.col(its_length)) & (F.col(prefix) == F.col(its_prefix))
    )
    first = Window.partitionBy(digest).orderBy(F.col(doc_id).asc_nulls_last())
    one_each = (
        rows.join(suspects, same, "left_semi")
        .withColumn(digest, F.sha2(normal_text(text), 256))
        .withColumn(number, F.row_number().over(first))
        .filter(F.col(number) == 1)
    )
    return rows.join(suspects, same, "left_anti").select(docs.columns).unionByName(one_each.select(docs.columns))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, digest_all=True).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
