"""Texts and tables with every awkward case, for all operators."""

from pyspark.sql import types as T

NASTY = [
    None,
    "",
    " ",
    "\n\n\t \x0b\x0c\r",
    "a",
    "It's they'll we've I'd 'tis ''s '",
    "one two three",
    "one two three",
    "one  two\nthree",
    "x" * 5000,
    "word " * 3000,
    "<|endoftext|> in the <|endoftext|><|endoftext|>middle <|endoft",
    "Über straße ñandú 中文 \U0001f600 é ​﻿",
    "tab\tsep\rret\x1cfs\x85nel\xa0nbsp em",
    "1234567890 ½ ² Ⅷ ٣",
    "a \n b  \n  c   ",
]

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark, texts=NASTY, extra=True):
    """Awkward texts under two sources and none, a null id, a repeated row, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s0", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, None), rows[-1], rows[-1]] if rows else []
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("size", "kept", "digest", "mark", "number", "row", "id", "fp", "copies", "kept_id", "its_id", "_id", "_text", "first"):
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df
