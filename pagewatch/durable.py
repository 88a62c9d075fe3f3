"""Reliable checkpoints: cut lineage into the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Parquet's writer looks at the size of a page after 100 to 10 000 rows, which of html may be gigabytes;
#: so many bytes are also laid out at once when a dictionary grows too large.
PAGE_CHECKS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "64"}
#: Spark's reader holds up to 4 096 rows of a row group at a time, their values uncompressed.
LONG_VALUES = PAGE_CHECKS | {"parquet.block.row.count.limit": "64"}
#: Generated code of a join that holds the outer side makes all rows of a streamed row, such as html that
#: very many urls share, before the first is taken; without it they are made one by one.
LONG_VALUES_SESSION = PAGE_CHECKS | {"spark.sql.codegen.join.buildSideOuterShuffledHashJoin.enabled": "false"}


def shared_folder(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; a scratch one only on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` so that several readers see the very same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, long_values: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: columnar, pruned, no lineage.

    ``long_values`` for columns such as html: pages and row groups of few rows.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.options(**(LONG_VALUES if long_values else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def for_long_values(df: DataFrame) -> DataFrame:
    """``df``, which whoever asked for it joins and writes: from now on this session holds few of its long values at a time."""
    for name, value in LONG_VALUES_SESSION.items():
        df.sparkSession.conf.set(name, value)
    return df
