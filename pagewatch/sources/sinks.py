"""Result tables for people: JSON lines and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from pagewatch import fixed_values as fv
from pagewatch.functions.text import csv_safe, join_list, join_map


def flatten_rows(items: DataFrame, fields: Sequence[str] = fv.RESULT_FIELDS) -> DataFrame:
    """The given fields in order: lists and maps as text, absent fields blank."""
    kinds = {f.name: f.dataType for f in items.schema}

    def cell(name: str):
        kind = kinds.get(name)
        if kind is None:
            return F.lit("").alias(name)
        if isinstance(kind, T.ArrayType):
            return join_list(F.col(name)).alias(name)
        if isinstance(kind, T.MapType):
            return join_map(F.col(name)).alias(name)
        return F.col(name)

    return items.select(*[cell(name) for name in fields])


def guarded_rows(rows: DataFrame) -> DataFrame:
    """String cells made safe for spreadsheets; other types untouched."""
    return rows.select(
        *[
            csv_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in rows.schema
        ]
    )


def write_results(
    items: DataFrame, folder: str, fields: Sequence[str] = fv.RESULT_FIELDS, debug: bool = False
) -> None:
    """Public rows as ``results_json`` and ``results_csv``; with ``debug`` all rows as ``debug_json`` too."""
    public = flatten_rows(items.where(F.col("grade") != "D"), fields)
    public.write.mode("overwrite").json(f"{folder}/results_json")
    write_csv(public, f"{folder}/results_csv")
    if debug:
        flatten_rows(items, fields).write.mode("overwrite").json(f"{folder}/debug_json")


def write_csv(rows: DataFrame, path: str) -> None:
    guarded_rows(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
