"""Remembered pages with content apart from headers: a narrow table by url, and every content once by its hash.

An upsert moves headers and hashes only. Contents are hashed where they are read,
and those that the store lacks are written from there into a folder of their run;
a content that is stored is not written again, whatever urls it belongs to. Runs
add folders and rewrite none; pruning drops the contents no header names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch import fixed_values as fv, schemas
from pagewatch.durable import LONG_VALUES, for_long_values, stored
from pagewatch.functions.hashing import content_hash
from pagewatch.operators import page_state
from pagewatch.operators.outbox import DurableStateError
from pagewatch.sources.tableset import BUCKETS, Keyed, TableSet, Version

KEYS = {"html": "html_key", "extracted_text": "text_key"}
TABLES = {"headers": Keyed(schemas.PAGE_HEADERS, "url"), "contents": Keyed(schemas.PAGE_CONTENTS, "key")}
#: A run's folder of contents is written anew when more than this share of it is named by no header.
DEAD_SHARE = 0.5


class PageStore:
    """Page states under one path. A number of contents' folder takes the place of a bucket's."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.tables = TableSet(spark, path, TABLES, buckets)

    def headers(self, version: Version | None = None) -> DataFrame:
        return self.tables.read("headers", version)

    def contents(self, version: Version | None = None) -> DataFrame:
        return self.tables.read("contents", version)

    def states(self) -> DataFrame:
        """Whole page states, in the layout of ``schemas.PAGE_STATE``."""
        version = self.tables.current()
        found = self.headers(version)
        for value, key in reversed(KEYS.items()):  # rows are held, contents stream past them; html, the widest, comes last
            content = self.contents(version).select(F.col("key").alias(key), F.col("value").alias(value))
            found = found.hint("shuffle_hash").join(content, key, "left")
        return for_long_values(found.select(*schemas.PAGE_STATE.names))

    def update(self, fetched: DataFrame, batch_id: int, seq: str = "seq") -> Version | None:
        """Upsert fetched pages (see ``page_state.page_updates``) as one version; None if the batch was committed before.

        ``fetched`` is read twice, and (url, seq) names one of its rows.
        """
        if self.tables.has_batch(batch_id):
            return None
        version = self.tables.current()
        updates = page_state.page_updates(fetched, seq).withColumns({key: F.sha2(value, 256) for value, key in KEYS.items()})
        narrow = stored(updates.drop(*KEYS))
        if narrow.groupBy("url", seq).count().where("count > 1").head(1):
            raise DurableStateError(f"several pages of one url and {seq}: {self.tables.path}")
        headers = self.tables.changed(
            "headers", narrow, lambda old, new: page_state.update_headers(old, new, seq, tuple(KEYS.values())), version
        )
        # of the rows with a new content the first by url names it; only names and hashes are grouped
        named = [
            narrow.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "url", F.col(seq).alias("seq"), F.lit(value).alias("part"))
            for value, key in KEYS.items()
        ]
        place = F.min(F.struct("url", "seq", "part")).alias("place")
        first = named[0].unionAll(named[1]).groupBy("key").agg(place)
        new = stored(first.join(self.contents(version).select("key"), "key", "left_anti").select("key", "place.*"))
        parts = F.array(*[F.struct(F.lit(v).alias("part"), F.col(k).alias("key"), F.col(v).alias("value")) for v, k in KEYS.items()])
        rows = updates.select("url", F.col(seq).alias("seq"), F.inline(parts)).where("key IS NOT NULL")
        written = rows.join(new.hint("shuffle_hash"), ["url", "seq", "part", "key"], "left_semi").select("key", "value")
        folders = {**version.tables.get("contents", {}), **self._written(written, version)}
        return self.tables.commit(version, batch_id, headers=headers, contents=folders)

    def _written(self, contents: DataFrame, version: Version) -> dict[str, str]:
        number, folder = str(version.number + 1), f"tables/contents/{uuid.uuid4().hex}"
        contents.write.options(**LONG_VALUES).parquet(f"{self.tables.path}/{folder}/{self.tables.part(number)}")
        return {number: folder}

    def prune(self, batch_id: int, keep: int = fv.KEPT_PAGE_STATES, dead_share: float = DEAD_SHARE) -> Version | None:
        """Keep the page states checked last, drop folders of contents that none of them names.

        A folder of which at most ``dead_share`` is without a name stays as it is.
        """
        if self.tables.has_batch(batch_id):
            return None
        version = self.tables.current()
        kept = stored(page_state.most_recent(self.headers(version), keep))
        gone = stored(self.headers(version).join(kept, "url", "left_anti"))
        headers = self.tables.changed("headers", gone, lambda old, out: old.join(out, "url", "left_anti"), version)
        live = stored(kept.select(F.explode(F.array(*KEYS.values())).alias("key")).where("key IS NOT NULL").distinct())
        folders, again = dict(version.tables.get("contents", {})), []
        for number in list(folders):
            rows = self.tables.read("contents", version, [int(number)])
            alive = F.count(F.when(F.col("alive"), True))
            # one row a folder, of its keys alone
            share = rows.select("key").join(live.withColumn("alive", F.lit(True)), "key", "left").agg(F.count("*"), alive).head()
            if share[0] - share[1] > dead_share * share[0]:
                del folders[number]
                if share[1]:
                    again.append(rows.join(live.hint("shuffle_hash"), "key", "left_semi"))
        if again:
            whole = again[0]
            for rows in again[1:]:
                whole = whole.unionAll(rows)
            folders |= self._written(whole, version)
        return self.tables.commit(version, batch_id, headers=headers, contents=folders)


def with_page_reuse(fetched: DataFrame, store: PageStore) -> DataFrame:
    """``page_state.with_page_reuse`` from a store: hashes are compared first, html is met by the unchanged rows alone."""
    version = store.tables.current()
    before = store.headers(version).select("url", F.col("content_hash").alias("_hash"), F.col("html_key").alias("_key"))
    rows = fetched.withColumn("content_hash", content_hash(F.col("content"))).join(before.hint("shuffle_hash"), "url", "left")
    unchanged = F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))
    rows = rows.withColumn("unchanged", unchanged).withColumn("_key", F.when(F.col("unchanged"), F.col("_key")))
    html = store.contents(version).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    found = rows.hint("shuffle_hash").join(html, "_key", "left")
    cached = F.when(F.col("unchanged"), F.coalesce("_value", F.lit("")))
    return for_long_values(found.withColumn("cached", cached).drop("_hash", "_key", "_value"))
