"""Corpus scans: fetched pages, portal payloads and attachment files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagewatch import schemas
from pagewatch.durable import stored


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def latest_fetch(pages: DataFrame) -> DataFrame:
    """One row per url: the fetch with the greatest page_id (null is the least), of several such the greatest html hash.

    The latest is found from url, page_id and hash alone, and its row by a semi-join
    on the three: nothing sorts html, and where the found keys are few Spark sends
    them to the rows. Only fetches that the corpus holds several times as they are
    go through a window, one per url and task.
    """
    html_hash = F.xxhash64("html").alias("_hash")
    keys = pages.select("url", F.struct("page_id", html_hash).alias("_fetch")).groupBy("url", "_fetch").count()
    last = keys.groupBy("url").agg(F.max("_fetch").alias("_fetch"), F.max_by("count", "_fetch").alias("_copies"))
    last = stored(last.select(F.col("url").alias("_url"), F.col("_fetch.page_id").alias("_page_id"), "_fetch._hash", "_copies"))
    same = (
        F.col("url").eqNullSafe(F.col("_url")) & F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.xxhash64("html") == F.col("_hash"))
    )
    once = pages.join(last.where("_copies = 1").hint("shuffle_hash"), same, "left_semi")
    several = last.where("_copies > 1")
    if not several.head(1):
        return once
    first = Window.partitionBy("url").orderBy("page_id")
    copies = pages.join(several.hint("shuffle_hash"), same, "left_semi").withColumn("_copy", F.row_number().over(first))
    return once.unionByName(copies.where("_copy = 1").drop("_copy"))


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Pages as they arrive; the file cap bounds what one micro-batch holds."""
    reader = spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Portal responses, one per file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")


def read_attachments(spark: SparkSession, path: str, base_url: str, max_bytes: int | None = None) -> DataFrame:
    """Attachment files with the url they were fetched from (``base_url`` + path below ``path``).

    Files of more than ``max_bytes`` stay as rows with ``refused`` and null content: their length
    comes from the listing, and they are never opened. Spark lists no files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.regexp_replace("path", "^.*?" + re.escape(path.strip("/")) + "/", "")
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), below).alias("url")
    if max_bytes is None:
        return files.select(url, "length", "content")
    # both filters reach the listing, and the second scan asks for no content
    none = F.lit(None)
    read = files.where(F.col("length") <= max_bytes).select(url, "length", "content", none.cast("string").alias("refused"))
    reason = F.format_string("%d bytes, over %d", "length", F.lit(max_bytes))
    refused = files.where(F.col("length") > max_bytes).select(url, "length", none.cast("binary").alias("content"), reason.alias("refused"))
    return read.unionByName(refused)
