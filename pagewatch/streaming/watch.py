"""Streams: change rows from keyed state, runs as micro-batches, dedupe, lateness and run counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewatch import fixed_values as fv, schemas
from pagewatch.durable import stored
from pagewatch.functions import rules
from pagewatch.functions.dates import is_stale, should_run
from pagewatch.functions.hashing import notice_key
from pagewatch.operators import changes, dedupe
from pagewatch.operators.outbox import DurableStateError
from pagewatch.sources.tableset import Files, Keyed, TableSet, Version

COMPARED = ("content_fingerprint", "grade", "deadline_status")
CHANGE_DDL = "url STRING, seq BIGINT, change_type STRING, previous_grade STRING, grade STRING"


class ChangeProcessor(StatefulProcessor):
    """Keeps the last fingerprint, grade and status of a url and labels every later snapshot."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", ", ".join(f"{c} STRING" for c in COMPARED), self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch is bounded by the source's file cap, and so is a key's share of it.
        batch = pd.concat(list(rows)).sort_values("seq").reset_index(drop=True)
        before = self._last.get() if self._last.exists() else None
        shifted = batch[list(COMPARED)].shift(1)
        if before is not None:
            shifted.loc[0] = list(before)
        kinds = pd.Series("unchanged", index=batch.index)
        for column, label in reversed(list(zip(COMPARED, fv.CHANGE_TYPES[1:]))):
            kinds[batch[column] != shifted[column]] = label
        if before is None:
            kinds[0] = "new"
        self._last.update(tuple(batch[list(COMPARED)].iloc[-1]))
        yield pd.DataFrame(
            {
                "url": key[0], "seq": batch["seq"], "change_type": kinds,
                "previous_grade": shifted["grade"].fillna(""), "grade": batch["grade"],
            }
        )

    def close(self) -> None:
        pass


def change_rows(snapshots: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Label a stream of snapshots (url, seq, fingerprint, grade, status); blank urls carry no state.

    Needs the RocksDB state store provider. With ``ttl_ms`` a url not seen for that
    long is forgotten, which bounds the state.
    """
    keyed = snapshots.where(F.col("url") != "").select("url", "seq", *COMPARED)
    return keyed.groupBy("url").transformWithStateInPandas(
        statefulProcessor=ChangeProcessor(ttl_ms), outputStructType=CHANGE_DDL, outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


RUN_TABLES = {"state": Keyed(schemas.NOTICE_STATE, "url"), "seen": Keyed(schemas.SEEN, "key")}


def has_intent(store: TableSet, batch_id: int) -> bool:
    """Whether the marked rows of a run are recorded."""
    return store.files.exists(f"runs/{batch_id}/intent.json")


def run_once(
    batch: DataFrame, batch_id: int, store: TableSet, deliver: Callable[[DataFrame], DataFrame], as_of: Column, *,
    recover: Callable[[DataFrame], DataFrame] | None = None, seq: str = "seq", max_age: int = fv.DEFAULT_MAX_AGE_DAYS,
) -> Version | None:
    """One run: mark changes, deliver at most once, then make state, seen and results current in one commit.

    What is durable, in order: the marked rows and, before anything is sent, an
    intent that names them and the version they were compared with; the rows sent;
    the commit. A run that died is taken up where it stopped, from the recorded
    rows, so it ends in the same tables. One that died between intent and sent rows
    may have delivered: nothing is delivered again, ``recover`` is asked which of
    the targets arrived (without it none count as sent; they stay targets).
    A store that has a ``history`` table gets the run's history rows in the same
    commit; their columns must then be among those of ``batch``. Returns the version of this batch, or None if it was committed before.
    """
    if store.has_batch(batch_id):
        return None
    spark, run = store.spark, f"runs/{batch_id}"
    intent = store.files.read(f"{run}/intent.json")
    fresh = intent is None
    if fresh:
        version = store.current()
        marked = changes.mark_run(batch, store.read("state", version), store.read("seen", version))
        folder = f"{run}/marked-{uuid.uuid4().hex}"
        marked.write.parquet(f"{store.path}/{folder}")
        intent = {"marked": folder, "version": version.number}
        if not store.files.create(f"{run}/intent.json", intent):
            raise DurableStateError(f"another writer runs batch {batch_id}: {store.path}")
    version = store.current()
    if version.number != intent["version"]:
        raise DurableStateError(f"batch {batch_id} was compared with version {intent['version']}, now it is {version.number}")
    marked = spark.read.parquet(f"{store.path}/{intent['marked']}")
    target = rules.is_alert_target(
        F.col("change_type"), F.col("is_new"), F.col("grade"), F.col("deadline_status"), F.col("notice_date"), as_of, max_age,
    )
    outcome = store.files.read(f"{run}/sent.json")
    if outcome is None:
        ask = deliver if fresh else recover or (lambda targets: targets.limit(0))
        folder = f"{run}/sent-{uuid.uuid4().hex}"
        ask(marked.where(target)).write.parquet(f"{store.path}/{folder}")
        outcome = {"sent": folder}
        store.files.create(f"{run}/sent.json", outcome)
    sent = spark.read.schema(marked.schema).parquet(f"{store.path}/{outcome['sent']}")
    settled = stored(changes.items_to_update_state(marked, sent, as_of, max_age))
    handled = stored(changes.items_to_mark_seen(marked, sent, as_of, max_age, seq).select(F.col("url").alias("key")).distinct())
    merged = {}
    if "history" in store.tables:
        rows = stored(dedupe.keyed_history(dedupe.history_rows(marked)))
        merge = lambda old, new: dedupe.keyed_history(dedupe.merge_history(old, new))
        merged["history"] = store.changed("history", rows, merge, version)
    return store.commit(
        version,
        batch_id,
        **merged,
        state=store.changed("state", settled.where("url != ''"), lambda old, new: changes.update_notice_state(old, new, seq), version),
        seen=store.changed("seen", handled, lambda old, new: old.union(new).distinct(), version),
        results={**version.tables.get("results", {}), str(batch_id): intent["marked"]},
    )


def watch_runs(
    items: DataFrame, store: TableSet, deliver: Callable[[DataFrame], DataFrame], as_of: Column, checkpoint: str, *,
    recover: Callable[[DataFrame], DataFrame] | None = None, seq: str = "seq", max_age: int = fv.DEFAULT_MAX_AGE_DAYS,
):
    """Treat every micro-batch as a run (see ``run_once``) over a store with ``RUN_TABLES``.

    ``deliver`` gets the alert targets and returns the rows that were sent; rows
    not sent leave no trace in the state and are targets again next time. A
    replayed batch finds its own records and changes nothing twice.
    """

    def one_run(batch: DataFrame, batch_id: int) -> None:
        run_once(batch, batch_id, store, deliver, as_of, recover=recover, seq=seq, max_age=max_age)

    writer = items.writeStream.foreachBatch(one_run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def first_copies(notices: DataFrame, ts: str | None = None, lateness: str = "7 days") -> DataFrame:
    """Drop notices whose dedupe key was seen before in the stream.

    With an event time ``ts`` keys are remembered for ``lateness`` behind the
    watermark only, which bounds the state.
    """
    key = notice_key(F.col("url"), F.col("university_name"), F.col("title"), F.col("attachment_urls"))
    keyed = notices.withColumn("_key", key)
    if ts is not None:
        return keyed.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return keyed.dropDuplicates(["_key"]).drop("_key")


def split_stale(notices: DataFrame, as_of: Column, max_age: int = fv.DEFAULT_MAX_AGE_DAYS) -> tuple[DataFrame, DataFrame]:
    """``(timely, stale)``: rows past the age limit go to the stale output before any stateful step."""
    stale = is_stale(F.col("notice_date"), as_of, max_age)
    return notices.where(~stale), notices.where(stale)


def split_late(
    rows: DataFrame, ts: str, delay_seconds: int, folder: str, checkpoint: str
) -> tuple[str, str]:
    """One stream, two outputs: ``(timely, late)`` folders; no row is lost and none is in both.

    The watermark is that of an event-time step: the latest ``ts`` of all earlier
    micro-batches less the delay. A row behind it goes to the late output instead
    of being dropped; rows without ``ts`` are timely. Each batch writes its own
    folder of each output and records the latest time it has seen, so a replayed
    batch compares with the same watermark and writes the same rows again.
    """
    spark = rows.sparkSession
    files, at = Files(spark, folder), F.unix_micros(F.col(ts).cast("timestamp"))

    def one_batch(batch: DataFrame, number: int) -> None:
        before = files.read(f"latest/{number - 1}.json") if number else None
        latest = before["latest"] if before else None
        held = stored(batch)
        behind = F.lit(False) if latest is None else F.coalesce(at < latest - delay_seconds * 1_000_000, F.lit(False))
        held.where(~behind).write.mode("overwrite").parquet(f"{folder}/timely/batch={number}")
        held.where(behind).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        own = held.agg(F.max(at)).head()[0]
        files.create(f"latest/{number}.json", {"latest": max((v for v in (latest, own) if v is not None), default=None)})

    writer = rows.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/timely", f"{folder}/late"


def run_counts(events: DataFrame, key: str, ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Events per half-day window and key on business days in Seoul."""
    rows = events.where(should_run(F.lit("schedule"), F.col(ts)))
    if events.isStreaming:
        rows = rows.withWatermark(ts, lateness)
    label = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown")).alias(key)
    return rows.groupBy(F.window(ts, "12 hours").alias("period"), label).agg(F.count("*").alias("n"))
