"""Connected components by alternating large-star and small-star rounds.

All edges of a node meet only as a minimum, which is taken where they are before
the shuffle. Each round is written to the shared folder, so lineage stays short. A
round never has more edges than the one before, so it is written in as many files
as those need, however many partitions the shuffles have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewatch.durable import stored

#: Edges of a file, where there are more than the cluster's cores share.
FILE_EDGES = 65_536


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # the edge to the least neighbour stays, the end of any other is moved to it
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum: two numbers, whatever the number of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has an edge in ``edges`` (columns u, v; u != v): root is its component's least node."""
    now = stored(edges.select("u", "v"))
    before, mark = None, _mark(now)
    while mark[0] and mark != before:
        files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-mark[0] // FILE_EDGES))
        now = stored(_small_star(_large_star(now)).coalesce(files))
        before, mark = mark, _mark(now)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.union(roots)
