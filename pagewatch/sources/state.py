"""Durable state tables: versioned writes, fail-closed reads, and the older seen-file layout."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagewatch.operators.outbox import DurableStateError
from pagewatch.sources.config import empty, path_missing

COMMITS = T.StructType(
    [T.StructField("version", T.LongType()), T.StructField("batch_id", T.LongType()), T.StructField("folder", T.StringType())]
)


class StateTable:
    """A table replaced as a whole: each write makes a new version, a commit row makes it current.

    Every write goes to a folder of its own, which its commit row names, so
    writers never touch each other's rows and a write that dies leaves a folder
    no commit names. A version committed twice, by two writers at once, is an
    error for every later reader, not a silent choice.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).option("mode", "FAILFAST").json(f"{self.path}/commits")
        except AnalysisException as error:
            if path_missing(error):
                return empty(self.spark, COMMITS)
            raise

    def _last(self) -> tuple[int, str | None]:
        row = self._commits().agg(
            F.max("version").alias("version"), F.max_by("folder", "version").alias("folder"),
            (F.count("*") - F.count_distinct("version")).alias("twice"),
        ).head()
        if row.twice:
            raise DurableStateError(f"two writers committed one version: {self.path}")
        return row.version or 0, row.folder

    def version(self) -> int:
        return self._last()[0]

    def has_batch(self, batch_id: int) -> bool:
        return not self._commits().where(F.col("batch_id") == batch_id).isEmpty()

    def read(self) -> DataFrame:
        version, folder = self._last()
        if version == 0:
            return empty(self.spark, self.schema)
        found = self.spark.read.parquet(f"{self.path}/{folder or f'v={version}'}")
        kinds = {f.name: f.dataType for f in found.schema}
        if any(kinds.get(f.name) != f.dataType for f in self.schema):
            raise DurableStateError(f"state table has an unexpected layout: {self.path}")
        return found.select(*self.schema.names)

    def write(self, rows: DataFrame, batch_id: int = -1) -> int:
        """Write a new version and commit it. A streaming batch already committed is not written again."""
        if batch_id >= 0 and self.has_batch(batch_id):
            return self.version()
        version = self.version() + 1
        folder = f"v={version}-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        if self.version() >= version:
            raise DurableStateError(f"another writer has committed version {version}: {self.path}")
        commit = self.spark.createDataFrame([(version, batch_id, folder)], COMMITS)
        commit.coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return version

    def ensure(self) -> None:
        if self.version() == 0:
            self.write(empty(self.spark, self.schema))


def read_durable_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON state that must be sound: a missing file is empty state, a broken one is an error."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if path_missing(error):
            return empty(spark, schema)
        raise


def read_seen_file(spark: SparkSession, path: str) -> DataFrame:
    """Seen keys from a JSON list, or from the older object whose keys and list values all count."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if path_missing(error):
            return spark.createDataFrame([], "key STRING")
        raise
    broken = F.raise_error(F.lit("seen state is malformed: " + path))
    value = F.coalesce(F.try_parse_json("value"), broken)
    rows = text.select(value.alias("v")).withColumn("kind", F.schema_of_variant("v"))
    strings = F.col("kind").isin("ARRAY<STRING>", "ARRAY<VOID>")
    listed = F.when(
        strings, F.coalesce(F.variant_get("v", "$", "array<string>"), F.array().cast("array<string>"))
    ).otherwise(broken)
    entries = F.variant_get("v", "$", "map<string,variant>")
    nested = F.flatten(
        F.transform(
            F.map_entries(entries),
            lambda e: F.when(
                F.schema_of_variant(e["value"]).isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>"),
                F.concat(
                    F.array(e["key"]),
                    F.coalesce(F.variant_get(e["value"], "$", "array<string>"), F.array().cast("array<string>")),
                ),
            ).otherwise(broken),
        )
    )
    keys = F.when(F.col("kind").startswith("OBJECT"), nested).otherwise(listed)
    return rows.select(F.explode(keys).alias("key")).distinct()
