"""Mixing sources to target weights by systematic sampling.

A source's target shares the budget by weight, but is at most ``LIMIT`` times
the source's size; what a limit cuts off is shared again by weight until no
target is above its limit. Within a source every document expects target/size
copies. Documents stand in order of (size, id), expected copies are summed along
that order from a random start in [0, 1), and a document is emitted once for
each whole number its stretch crosses. The order by size spreads the copies over
short and long documents alike, so the words taken are near the target.

Null texts have size 0 and an empty source the target 0. A null source is a
source of its own, the last in order. Repeated rows are rows of their own. The
random start depends on the seed and the source's name alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.durable import stored
from pagewatch.llm.common import WORD, fresh, text_of
from pagewatch.operators.ordering import sorted_ranges, with_position, with_rank

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"


def sizes_of(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _start(source: str) -> Column:
    """One random number in [0, 1) per source, from a hash of the seed and the name."""
    named = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Per source of ``sizes`` (source, size): source, source_size, target.

    The driver sees four sums a round, whatever the number of sources. A round
    settles every source whose share is above its limit, and the last one none.
    """
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    listed = totals.withColumn("none", F.col("source").isNull())
    placed = with_position(sorted_ranges(listed, ["none"], ["source"], cheap=True), "place")
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = stored(placed.select("source", "source_size", F.element_at(turn, ((F.col("place") - 1) % len(weights) + 1).cast("int")).alias("weight")))
    budget = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, settled = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(share) > limit * F.col("source_size")
        count, fixed, open_weight = weighed.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, limit * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if count == settled or not open_weight:
            break
        settled, share = count, (budget - fixed) / open_weight
    target = F.least(F.col("weight") * F.lit(share), (limit * F.col("source_size")).cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: id, mark (a hash of its text), source, size, source_size, target, copies."""
    rows = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("mark"), F.col(source).alias("source"), sizes_of(text).alias("size")
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    goals = targets(rows)
    ranked = with_rank(sorted_ranges(rows, ["source"], ["size", "id", "mark", "row"], cheap=True), ["source"], "rank")
    goals = goals.withColumnRenamed("source", "its_source")
    met = ranked.join(goals, F.col("source").eqNullSafe(F.col("its_source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(_start("source") + each * F.col("rank")) - F.floor(_start("source") + each * (F.col("rank") - 1))
    return met.select("id", "mark", "source", "size", "source_size", "target", F.least(crossed, F.ceil(each)).alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    Copies are found by id, text and source; of rows that share all three the
    first carries the copies of all.
    """
    mark, number, copies, *its = fresh(docs, "mark", "number", "copies", "its_id", "its_mark", "its_source", "its_taken")
    plan = mix(docs, doc_id, text, source).groupBy("id", "mark", "source").agg(F.sum("copies").alias("taken"))
    plan = plan.filter("taken > 0").select(*[F.col(c).alias(own) for c, own in zip(("id", "mark", "source", "taken"), its, strict=True)])
    rows = docs.withColumn(mark, F.xxhash64(text_of(text)))
    met = rows.join(
        plan,
        F.col(doc_id).eqNullSafe(F.col(its[0])) & (F.col(mark) == F.col(its[1])) & F.col(source).eqNullSafe(F.col(its[2])),
    )
    order = Window.partitionBy(doc_id, mark, source).orderBy(mark)
    first = met.withColumn(number, F.row_number().over(order)).filter(F.col(number) == 1)
    return first.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(its[3])))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT source, source_size::BIGINT AS source_size, [5, 2, 1][(place - 1) % 3 + 1] AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS turn FROM w
), c AS (
  SELECT *, coalesce(sum(source_size) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
    sum(source_size) OVER () AS budget
  FROM o WINDOW before AS (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (
  SELECT min_by((budget - 3 * capped)::BIGINT / open_weight::BIGINT, turn) AS share
  FROM c WHERE weight * ((budget - 3 * capped)::BIGINT / open_weight::BIGINT) <= 3 * source_size
), t AS (
  SELECT source, source_size, least(weight * share, (3 * source_size)::DOUBLE) AS target,
    ('0x' || substr(md5('{SEED}:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS start
  FROM w, m
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, least(floor(start + each * rank) - floor(start + each * (rank - 1)), ceil(each))::BIGINT AS copies FROM r
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM k
"""
