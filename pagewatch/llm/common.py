"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: White space between words, and a word, as every operator here understands them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def text_of(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` made different from every column of ``df``, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def each_row(
    df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, fields: list[tuple[str, pa.DataType]]
) -> DataFrame:
    """Apply a row function in Arrow batches: ``make()`` builds it once per task from what it closes over.

    The function gets one row's columns and returns one tuple for ``fields``.
    Rows are independent, so a lost task is simply run again.
    """
    layout = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [work(*row) for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, layout, strict=True)], schema=layout
                )

    return df.mapInArrow(run, schema)
