"""Ordered operators that stay balanced when one key holds much of the data.

A window over a hot key puts all its rows into one task. Here rows are laid out
in ranges of (keys, order) instead, so a hot key spreads over many tasks, and
only one summary row per range is carried from each range to the next.
``order`` must make rows unique within a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.durable import stored

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def sorted_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], cheap: bool = False) -> DataFrame:
    """Rows in global (keys, order) order with ``_at`` increasing along it and ``_range`` numbering the ranges.

    Ranges are found from a sample, so the input is read twice; it is stored
    first, unless the caller says that it is ``cheap`` to read. The layout is
    stored too: every reader sees the same places and reads the columns it needs.
    """
    columns = [*keys, *order]
    source = df if cheap else stored(df)
    ranged = (
        source.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return stored(ranged).withColumn("_range", F.shiftright("_at", _ROW_BITS))


def _ranges_in_order() -> Window:
    # One row per range: its size is the partition count, not the data.
    return Window.orderBy("_range")


def with_position(layout: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a layout from 1 in global order."""
    sizes = layout.groupBy("_range").agg(F.count("*").alias("_size"))
    before = _ranges_in_order().rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    in_range = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        layout.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_offset") + in_range + 1)
        .drop("_offset")
    )


def with_rank(layout: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """Number the rows of every key from 1."""
    placed = with_position(layout, "_position")
    segment = Window.partitionBy("_range", *keys)
    placed = placed.withColumn("_start", F.min("_position").over(segment))
    key = F.struct(*keys)
    tails = placed.groupBy("_range").agg(
        F.min("_position").alias("_first"), F.max_by(F.struct(key.alias("key"), "_start"), "_at").alias("_tail")
    )
    by_range = _ranges_in_order()
    tails = tails.withColumn("_key_before", F.lag("_tail.key").over(by_range))
    continued = (F.col("_tail._start") == F.col("_first")) & F.col("_tail.key").eqNullSafe(F.col("_key_before"))
    tails = tails.withColumn("_own_start", F.when(~continued, F.col("_tail._start")))
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    carries = tails.select(
        "_range", "_first", "_key_before", F.last("_own_start", ignorenulls=True).over(earlier).alias("_carried")
    )
    joined = placed.join(F.broadcast(carries), "_range")
    carried = (F.col("_start") == F.col("_first")) & key.eqNullSafe(F.col("_key_before"))
    start = F.when(carried, F.col("_carried")).otherwise(F.col("_start"))
    return joined.withColumn(name, F.col("_position") - start + 1).drop(
        "_position", "_start", "_first", "_key_before", "_carried"
    )


def with_last_before(layout: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add, per name, the latest non-null value among the earlier rows of the same key."""
    names = list(values)
    valued = layout.withColumns({f"_v_{n}": values[n] for n in names})
    earlier = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*keys)
    # Greatest key of the range, and within it the latest row that has a value.
    tails = valued.groupBy("_range").agg(
        F.max(key).alias("_key"),
        *[
            F.max_by(F.col(f"_v_{n}"), F.struct(key, F.col(f"_v_{n}").isNotNull(), F.col("_at"))).alias(f"_t_{n}")
            for n in names
        ],
    )
    same_key = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumns({f"_t_{n}": F.last(f"_t_{n}", ignorenulls=True).over(same_key) for n in names})
    by_range = _ranges_in_order()
    carries = tails.select(
        "_range",
        F.lag("_key").over(by_range).alias("_key_before"),
        *[F.lag(f"_t_{n}").over(by_range).alias(f"_c_{n}") for n in names],
    )
    out = valued.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(earlier) for n in names})
    out = out.join(F.broadcast(carries), "_range")
    return out.withColumns(
        {
            n: F.coalesce(F.col(n), F.when(key.eqNullSafe(F.col("_key_before")), F.col(f"_c_{n}")))
            for n in names
        }
    ).drop("_key_before", *[f"{p}{n}" for n in names for p in ("_v_", "_c_")])


def drop_layout(df: DataFrame) -> DataFrame:
    return df.drop("_at", "_range")
