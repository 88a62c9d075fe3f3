"""The outbox as a stream: delivery events folded into keyed state in the order of their time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewatch.functions.text import message_preview
from pagewatch.operators.outbox import iso_time

#: Events of one id that wait for the watermark are held in buckets of so many seconds.
BUCKET_SECONDS = 86_400
#: Ids are dealt into so many keys of state; the number belongs to a checkpoint and must stay as it was.
SHARDS = 1024
#: So many events of a shard are held before they are added to their buckets.
HELD_EVENTS = 65_536
ENTRY = ("status", "attempt_count", "logical_key", "message_preview", "updated", "message_id", "error_type", "resolved")
_ENTRY_DDL = (
    "status STRING, attempt_count BIGINT, logical_key STRING, message_preview STRING, updated BIGINT, "
    "message_id STRING, error_type STRING, resolved BIGINT"
)
_EVENT = ("at", "event_id", "event", "status", "logical_key", "preview", "message_id", "error_type")
NOTHING = (None, 0, "", "", None, None, None, None)


def step(entry: tuple, event: list) -> tuple:
    """The entry of a delivery id after one more event. ``status`` is None while there is no entry."""
    at, _, kind, status, logical_key, preview, message_id, error_type = event
    before, attempts, key, text, _, sent, error, resolved = entry
    if kind == "begin":
        if before in ("delivered", "sending", "uncertain"):
            return entry  # skipped or blocked
        return ("sending", attempts + 1, logical_key or "", preview or "", at, None, None, None)
    if kind == "resolve" and before is None:
        return entry  # nothing to resolve
    if kind == "confirm":
        sent = message_id
    elif kind == "failure":
        error = error_type
    elif kind == "resolve":
        resolved = at
    return (status, attempts, key, text, at, sent, error, resolved)


class DeliveryProcessor(StatefulProcessor):
    """Folds the events of a shard's ids, each id's in order of (time, event id).

    Ids are dealt into shards, so that state is asked for once a shard and bucket
    and frames hold many ids. An id's settled entry is a value of its own; events
    that may still be preceded by others wait in buckets of time, which the shard
    lists. A bucket is folded into the entries when the watermark has passed its
    end, and is then forgotten. After each micro-batch the entry of every id that
    had events, as it is with all that wait, goes out under a new revision. A
    bucket's events are added in parts and none is written again. One frame and
    ``HELD_EVENTS`` of input, one bucket and the entries of the ids met are held
    at a time, however many events an id has.
    """

    def __init__(self, bucket_seconds: int = BUCKET_SECONDS) -> None:
        self._width = bucket_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._buckets = handle.getValueState("buckets", "buckets STRING")
        self._settled = handle.getMapState("settled", "delivery_id STRING", f"{_ENTRY_DDL}, revision BIGINT")
        self._waiting = handle.getMapState("waiting", "bucket BIGINT, part BIGINT", "events STRING")

    def _listed(self) -> dict[int, int]:
        """The buckets that wait, in order, and in how many parts."""
        held = self._buckets.get()
        return {} if held is None else dict(json.loads(held[0]))

    def _list(self, buckets: dict[int, int]) -> None:
        self._buckets.update((json.dumps(sorted(buckets.items())),))

    def _read(self, name: str | None) -> tuple[tuple, int]:
        """The settled entry of an id and the revision last sent."""
        held = self._settled.getValue(_state_key(name))
        return (NOTHING, 0) if held is None else (tuple(held[: len(ENTRY)]), held[len(ENTRY)])

    def _in_order(self, bucket: int, parts: int) -> list[list]:
        events = [e for part in range(parts) for e in json.loads(self._waiting.getValue((bucket, part))[0])]
        events.sort(key=itemgetter(0, 1))
        return events

    def _add(self, new: dict[int, list[list]], buckets: dict[int, int]) -> None:
        """Events of some buckets as one more part of each."""
        for bucket, events in new.items():
            if bucket not in buckets:
                self._handle.registerTimer((bucket + 1) * self._width // 1000)
            part = buckets.get(bucket, 0)
            self._waiting.updateValue((bucket, part), (json.dumps(events),))
            buckets[bucket] = part + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buckets, entries = self._listed(), {}
        new: dict[int, list[list]] = {}
        held = 0
        for frame in rows:
            for name, at, number, *rest in _plain(frame):
                entries[name] = None
                new.setdefault(int(at) // self._width, []).append([int(at), int(number), *rest, name])
            held += len(frame)
            if held >= HELD_EVENTS:
                self._add(new, buckets)
                new, held = {}, 0
        self._add(new, buckets)
        self._list(buckets)
        revisions = {}
        for name in entries:
            entry, revision = self._read(name)
            self._settled.updateValue(_state_key(name), (*entry, revision + 1))
            entries[name], revisions[name] = entry, revision + 1
        for bucket, parts in sorted(buckets.items()):
            for event in self._in_order(bucket, parts):
                if event[-1] in entries:
                    entries[event[-1]] = step(entries[event[-1]], event[:-1])
        yield pd.DataFrame(
            [(name, *entry, revisions[name]) for name, entry in entries.items()], columns=["delivery_id", *ENTRY, "revision"]
        ).astype({"updated": "Int64", "resolved": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        buckets, entries, revisions = self._listed(), {}, {}
        for bucket in [b for b in buckets if (b + 1) * self._width <= passed]:
            for event in self._in_order(bucket, buckets[bucket]):
                name = event[-1]
                if name not in entries:
                    entries[name], revisions[name] = self._read(name)
                entries[name] = step(entries[name], event[:-1])
            for part in range(buckets.pop(bucket)):
                self._waiting.removeKey((bucket, part))
        for name, entry in entries.items():
            self._settled.updateValue(_state_key(name), (*entry, revisions[name]))
        self._list(buckets)
        return iter(())

    def close(self) -> None:
        pass


def _state_key(name: str | None) -> tuple[str]:
    """A null id has a key of its own."""
    return ("null" if name is None else f"={name}",)


def _plain(frame: pd.DataFrame) -> Iterator[tuple]:
    columns = [frame[name].astype(object) for name in ("delivery_id", *_EVENT)]
    return zip(*[c.where(c.notna(), None).tolist() for c in columns], strict=True)


def delivery_updates(
    events: DataFrame, lateness: str = "7 days", bucket_seconds: int = BUCKET_SECONDS, shards: int = SHARDS
) -> DataFrame:
    """A stream of entries, one per id and micro-batch, with a ``revision`` that grows per id.

    ``events`` as for ``outbox.delivery_state``, in any order; one that comes later
    than ``lateness`` behind the latest is dropped. Needs the RocksDB state store.
    """
    rows = events.withWatermark("ts", lateness).select(
        F.pmod(F.xxhash64("delivery_id"), F.lit(shards)).alias("shard"), "delivery_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "event", "status", "logical_key",
        message_preview(F.col("message")).alias("preview"), "message_id", "error_type",
    )
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=DeliveryProcessor(bucket_seconds),
        outputStructType=f"delivery_id STRING, {_ENTRY_DDL}, revision BIGINT",
        outputMode="Update",
        timeMode="EventTime",
    )


def latest_entries(updates: DataFrame) -> DataFrame:
    """The delivery state from a table of updates: the last revision of every id, in the layout of the batch fold."""
    last = updates.groupBy("delivery_id").agg(F.max_by(F.struct(*ENTRY), "revision").alias("e")).where("e.status IS NOT NULL")
    at = lambda name: iso_time(F.timestamp_micros(F.col(f"e.{name}")))
    return last.select(
        "delivery_id", "e.status", "e.attempt_count", "e.logical_key", "e.message_preview", at("updated").alias("updated_at"),
        "e.message_id", "e.error_type", at("resolved").alias("resolved_at"),
    )
