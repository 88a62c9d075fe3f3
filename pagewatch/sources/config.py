"""Configuration tables: universities, boards and the weighted vocabulary."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagewatch import fixed_values as fv, schemas
from pagewatch.functions.scoring import Vocabulary, Word


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_tolerant_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON where invalid records and a missing file count as nothing."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if path_missing(error):
            return empty(spark, schema)
        raise


def read_universities(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    rows = read_tolerant_json(spark, path, schemas.UNIVERSITIES)
    return in_region(rows, region)


def in_region(universities: DataFrame, region: str | None) -> DataFrame:
    return universities if region is None else universities.where(F.col("region") == region)


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """Boards in file order (``board_idx``); one file, so the order is that of its array."""
    rows = read_tolerant_json(spark, path, schemas.BOARDS)
    return rows.withColumn("board_idx", F.monotonically_increasing_id())


def active_boards(boards: DataFrame, universities: DataFrame) -> DataFrame:
    """Enabled boards of known universities."""
    enabled = boards.where(F.coalesce("enabled", F.lit(True)))
    names = universities.select(F.col("name").alias("university_name"))
    return enabled.join(names, "university_name", "left_semi")


def mark_skipped(boards: DataFrame, universities: DataFrame) -> DataFrame:
    """All boards with ``skipped``: disabled, or of a university that is not configured."""
    known = universities.select(F.col("name").alias("university_name"), F.lit(True).alias("_known")).distinct()
    rows = boards.join(known, "university_name", "left")
    usable = F.coalesce("enabled", F.lit(True)) & F.col("_known").isNotNull()
    return rows.withColumn("skipped", ~usable).drop("_known")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary file as rows ``(family, polarity, word, points, ord)`` in file order."""
    groups = [(f, p) for f in fv.FAMILIES for p in ("positive", "negative")]
    schema = T.StructType(
        [T.StructField(f"{f}_{p}", T.MapType(T.StringType(), T.IntegerType())) for f, p in groups]
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)

    def entries(family: str, polarity: str):
        words = F.coalesce(F.col(f"{family}_{polarity}"), F.create_map().cast("map<string,int>"))
        return F.transform(
            F.map_entries(words),
            lambda e: F.struct(
                F.lit(family).alias("family"), F.lit(polarity).alias("polarity"),
                e["key"].alias("word"), e["value"].alias("points"),
            ),
        )

    parts = [entries(f, p) for f, p in groups]
    return raw.select(F.posexplode(F.concat(*parts)).alias("ord", "w")).select("w.*", "ord")


def vocabulary(rows: DataFrame) -> Vocabulary:
    """The vocabulary, which is configuration, as plan literals."""
    found = rows.orderBy("ord").collect()
    return Vocabulary(tuple(Word(r.family, r.polarity, r.word, r.points) for r in found))
