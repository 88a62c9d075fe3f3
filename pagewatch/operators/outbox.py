"""At-most-once delivery: an event log folded into the state of every delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.durable import durable
from pagewatch.functions.text import any_word, message_preview
from pagewatch.operators.ordering import drop_layout, sorted_ranges, with_last_before

ORDER = ("ts", "event_id")


class DurableStateError(RuntimeError):
    """Persisted state that cannot be trusted."""


def failure_status(error_type: Column, http_status: Column, message: Column) -> Column:
    """``failed`` (safe to retry) when the message surely never arrived, else ``uncertain``."""
    before_connect = error_type.isin("ConnectionError", "ProxyError", "SSLError") & any_word(
        F.lower(message), fv.PRE_CONNECT_MARKERS
    )
    safe = (
        (error_type == "ConnectTimeout")
        | ((error_type == "HTTPError") & http_status.between(400, 499))
        | before_connect
    )
    return F.when(F.coalesce(safe, F.lit(False)), "failed").otherwise("uncertain")


def delivery_outcomes(events: DataFrame) -> DataFrame:
    """Add ``status_before`` and ``outcome`` to every event of the log.

    ``begin`` is accepted, skipped (already delivered) or blocked (may have been
    delivered); ``resolve`` of an id nobody delivered is unknown; all else applies.
    Every event but ``begin`` sets the status outright, so the state before an
    event is given by the last such event and by whether a ``begin`` followed it.
    """
    keys = ["delivery_id"]
    kind = F.col("event")
    at = F.struct(*ORDER)
    # A resolve counts once something else happened to the id.
    entries = events.where(kind != "resolve").groupBy(*keys).agg(F.min(at).alias("_entry"))
    void = (kind == "resolve") & ~F.coalesce(at > F.col("_entry"), F.lit(False))
    known = events.join(entries, keys, "left").withColumn("_void", void).drop("_entry")
    traced = with_last_before(
        sorted_ranges(known, keys, list(ORDER)),
        keys,
        {
            "_set": F.when((kind != "begin") & ~F.col("_void"), F.col("status")),
            "_kind": F.when(~F.col("_void"), kind),
        },
    )
    restarted = (F.col("_kind") == "begin") & F.coalesce("_set", F.lit("failed")).eqNullSafe("failed")
    before = F.when(restarted, "sending").otherwise(F.coalesce("_set", F.lit("")))
    outcome = (
        F.when(F.col("_void"), "unknown")
        .when(kind != "begin", "applied")
        .when(F.col("status_before") == "delivered", "skipped")
        .when(F.col("status_before").isin("sending", "uncertain"), "blocked")
        .otherwise("accepted")
    )
    marked = traced.withColumn("status_before", before).withColumn("outcome", outcome)
    return drop_layout(marked).drop("_void", "_set", "_kind")


def delivery_state(events: DataFrame) -> DataFrame:
    """Current entry of every delivery id.

    Plain aggregates over the marked events, so tasks combine before the shuffle
    and an id with very many events is no problem. An accepted ``begin`` starts a
    new entry, which clears what earlier attempts had left in it.
    """
    marked = delivery_outcomes(events)
    at = F.struct(*ORDER)
    accepted = F.col("outcome") == "accepted"
    effective = F.col("outcome").isin("accepted", "applied")
    status_after = F.when(accepted, "sending").otherwise(F.col("status"))

    def latest(value: Column, condition: Column) -> Column:
        return F.max_by(F.struct(at.alias("at"), value.alias("value")), F.when(condition, at))

    applied = F.col("outcome") == "applied"
    grouped = marked.groupBy("delivery_id").agg(
        F.max_by(status_after, F.when(effective, at)).alias("status"),
        F.count_if(accepted).alias("attempt_count"),
        F.max(F.when(accepted, at)).alias("_begun"),
        F.max_by("logical_key", F.when(accepted, at)).alias("_logical_key"),
        F.max_by(message_preview(F.col("message")), F.when(accepted, at)).alias("_preview"),
        F.max(F.when(effective, F.col("ts"))).alias("_updated"),
        latest(F.col("message_id"), applied & (F.col("event") == "confirm")).alias("_confirm"),
        latest(F.col("error_type"), applied & (F.col("event") == "failure")).alias("_failure"),
        latest(F.col("ts"), applied & (F.col("event") == "resolve")).alias("_resolve"),
    )

    def of_this_attempt(name: str) -> Column:
        current = F.col("_begun").isNull() | (F.col(f"{name}.at") > F.col("_begun"))
        return F.when(current, F.col(f"{name}.value"))

    return grouped.where(F.col("status").isNotNull()).select(
        "delivery_id",
        "status",
        "attempt_count",
        F.coalesce("_logical_key", F.lit("")).alias("logical_key"),
        F.coalesce("_preview", F.lit("")).alias("message_preview"),
        iso_time(F.col("_updated")).alias("updated_at"),
        of_this_attempt("_confirm").alias("message_id"),
        of_this_attempt("_failure").alias("error_type"),
        iso_time(of_this_attempt("_resolve")).alias("resolved_at"),
    )


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def prune_delivered(state: DataFrame, keep: int = fv.KEPT_DELIVERED) -> DataFrame:
    """Keep the newest ``keep`` delivered entries and every entry that is not delivered."""
    delivered = state.where(F.col("status") == "delivered")
    newest = delivered.orderBy(F.col("updated_at").desc(), F.col("delivery_id").desc()).limit(keep)
    return state.where(F.col("status") != "delivered").unionByName(newest)


def unresolved(state: DataFrame) -> DataFrame:
    return (
        state.where(F.col("status").isin("sending", "uncertain"))
        .select("delivery_id", "status", "logical_key", "message_preview", "updated_at")
        .orderBy("delivery_id")
    )


def violations(state: DataFrame) -> DataFrame:
    """Entries that break the rules of the state table, with the rule they break."""
    rule = (
        F.when(~F.coalesce(F.col("delivery_id").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid id")
        .when(~F.coalesce(F.col("status").isin(*fv.DELIVERY_STATUSES), F.lit(False)), "invalid status")
        .when(F.coalesce("attempt_count", F.lit(0)) < 1, "invalid attempt count")
        .when(F.coalesce("updated_at", F.lit("")) == "", "invalid timestamp")
        .when(F.col("logical_key").isNull() | F.col("message_preview").isNull(), "invalid metadata")
    )
    return state.withColumn("violation", rule).where(F.col("violation").isNotNull())


def require_valid(state: DataFrame) -> DataFrame:
    """The state itself, or an error when one entry breaks a rule."""
    state = durable(state)
    broken = violations(state).select("delivery_id", "violation").head()
    if broken is not None:
        raise DurableStateError(f"delivery state has an entry with {broken.violation}: {broken.delivery_id}")
    return state
