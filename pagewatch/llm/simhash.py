"""SimHash near duplicates, linked through a byte-position inverted index.

A fingerprint has eight positional bytes. Two fingerprints that differ in at
most two bits share at least six of them, so also two of the four byte pairs:
the index lists fingerprints under each two byte pairs. Fingerprints that meet
in a list have their shared positional bytes counted, those with six or more
are verified bit by bit. A list longer than ``LIST`` is never paired off; it is
split by two more positional bytes, and one still longer by all remaining bits
but two, where every member is a neighbour of every other and a star of links
does. So no link is lost and no list makes pairs with the square of its size.

Null text counts as empty. A text without words has fingerprint zero, which is
linked like any other; one with fewer words than a shingle is one shingle.
Equal fingerprints form one class before anything is linked, so copies cost
nothing. A null id never names a component unless there is no other id.
Repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import itertools
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.durable import stored
from pagewatch.llm.common import each_row, fresh, text_of
from pagewatch.llm.graph import components

SEED = 42
SHINGLE_WORDS = 3
MOST_BITS = 2
SHARED_BYTES = 8 - MOST_BITS
LIST = 128


def fingerprint_of(shingle_words: int = SHINGLE_WORDS, seed: int = SEED):
    """The row function: text to a signed 64-bit fingerprint."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest

    def of(text: str | None) -> int:
        # bytes.lower and bytes.split know ASCII letters and white space alone
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return 0
        line = b" ".join(words)
        n = max(1, len(words) - shingle_words + 1)
        if n == 1:
            hashes = np.array([digest(line, seed)], np.uint64)
        else:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[:n].tolist()
            hashes = np.fromiter(
                (digest(line[a:b], seed) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)), np.uint64, n
            )
        votes = np.zeros(64, np.int64)
        for at in range(0, n, 8192):
            block = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
        return int(np.packbits(votes * 2 > n).view(">i8")[0])

    return of


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, mark, fp`` for every row; mark is a hash of the text that tells rows of one id apart."""
    from pyspark.sql.pandas.types import to_arrow_type

    def make():
        of = fingerprint_of()
        return lambda key, mark, words: (key, mark, of(words))

    kind = docs.schema[doc_id].dataType
    return each_row(
        docs.select(F.col(doc_id), F.xxhash64(text_of(text)), F.col(text)),
        make,
        f"id {kind.simpleString()}, mark bigint, fp bigint",
        [("id", to_arrow_type(kind)), ("mark", pa.int64()), ("fp", pa.int64())],
    )


def _pair_at(place: int) -> Column:
    """Byte pair 0 to 3 of ``fp``, as a number below 65536."""
    return F.shiftrightunsigned("fp", 16 * place).bitwiseAND(F.lit(0xFFFF))


def _byte_at(place: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * place).bitwiseAND(F.lit(0xFF))


def _coarse(fps: DataFrame) -> DataFrame:
    """Index entries under each two byte pairs: (fp, places, part)."""
    chosen = [
        F.struct(F.lit(f"{a}{b}").alias("places"), F.shiftleft(_pair_at(a), 16).bitwiseOR(_pair_at(b)).alias("part"))
        for a, b in itertools.combinations(range(4), 2)
    ]
    return fps.select("fp", F.inline(F.array(*chosen)))


def _finer(entries: DataFrame) -> DataFrame:
    """The same entries under two more positional bytes, which linked fingerprints share; y and z are the bytes left."""
    out = []
    for a, b in itertools.combinations(range(4), 2):
        rest = [x for p in range(4) if p not in (a, b) for x in (2 * p, 2 * p + 1)]
        chosen = []
        for w, x in itertools.combinations(rest, 2):
            y, z = (k for k in rest if k not in (w, x))
            chosen.append(
                F.struct(
                    F.lit(f"{a}{b}+{w}{x}").alias("places"),
                    F.shiftleft("part", 16).bitwiseOR(F.shiftleft(_byte_at(w), 8)).bitwiseOR(_byte_at(x)).alias("part"),
                    F.lit(y).alias("y"),
                    F.lit(z).alias("z"),
                )
            )
        out.append(F.when(F.col("places") == f"{a}{b}", F.array(*chosen)))
    return entries.select("fp", F.inline(F.coalesce(*out)))


def _finest(entries: DataFrame) -> DataFrame:
    """The same entries with two of the sixteen free bits cleared: who meets here is linked."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in itertools.combinations(range(16), 2)])
    free = entries.select("fp", "places", "y", "z", F.inline(pairs))

    def bit(k: str) -> str:
        return f"shiftleft(1L, IF({k} < 8, 8 * y + {k}, 8 * z + {k} - 8))"

    return free.select(
        "fp", F.concat_ws("/", "places", "i", "j").alias("places"), F.expr(f"fp & ~({bit('i')} | {bit('j')})").alias("part")
    )


def _split(entries: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Entries of lists of 2 to ``most`` fingerprints, and those of longer lists."""
    sizes = entries.groupBy("places", "part").agg(F.count("*").alias("n")).filter("n > 1")
    sized = stored(entries.join(sizes, ["places", "part"]))
    return sized.filter(F.col("n") <= most).drop("n"), sized.filter(F.col("n") > most).drop("n")


def _pairs(entries: DataFrame) -> DataFrame:
    """Count filter and verification of the fingerprints that meet in a short list."""
    left = entries.withColumnRenamed("fp", "u")
    right = entries.withColumnRenamed("fp", "v")
    apart = F.col("u").bitwiseXOR(F.col("v"))
    shared = reduce(
        lambda x, y: x + y, [(F.shiftrightunsigned(apart, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(8)]
    )
    met = left.join(
        right.withColumnRenamed("places", "places2").withColumnRenamed("part", "part2"),
        (F.col("places") == F.col("places2"))
        & (F.col("part") == F.col("part2"))
        & (F.col("u") < F.col("v"))
        & (shared >= SHARED_BYTES)
        & (F.bit_count(apart) <= MOST_BITS),
    )
    return met.select("u", "v")


def links(fps: DataFrame, most: int = LIST) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints (column fp) at ``MOST_BITS`` bits or fewer.

    From lists split to the end come the links to the list's least member only:
    the components are those of all links.
    """
    short, long_ = _split(_coarse(fps), most)
    found = _pairs(short)
    short, long_ = _split(_finer(long_), most)
    found = found.union(_pairs(short))
    met = _finest(long_)
    least = met.groupBy("places", "part").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = met.join(least, ["places", "part"]).filter("fp != v").select(F.col("fp").alias("u"), "v")
    return found.union(stars).distinct()


def _first() -> Column:
    """Least id, a null one last, and with it the text's mark."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark"))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and for each class of equal fingerprints its component and that one's first row."""
    rows = stored(fingerprints(docs, doc_id, text))
    classes = stored(rows.groupBy("fp").agg(_first().alias("first")))
    roots = components(links(classes.select("fp")))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first").alias("chosen"))
    return rows, placed.join(named, "root").select("fp", "root", "chosen")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fp, component`` for every row: the smallest id reachable over links."""
    rows, classes = _grouped(docs, doc_id, text)
    return rows.join(classes, "fp").select("id", "fp", F.col("chosen.id").alias("component"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``mark, class``: the component of every text, by the hash of the text."""
    rows, classes = _grouped(docs, doc_id, text)
    return rows.select("fp", "mark").distinct().join(classes, "fp").select("mark", F.col("root").alias("class"))


def rows_kept(docs: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows whose id and mark are in ``kept``, with all their columns.

    Of rows that share both one stays, cut to one before any shuffle.
    """
    name, mark, kept_id, kept_mark = fresh(docs, "number", "mark", "kept_id", "kept_mark")
    kept = kept.select(F.col("id").alias(kept_id), F.col("mark").alias(kept_mark))
    found = docs.withColumn(mark, F.xxhash64(text_of(text))).join(
        kept, F.col(doc_id).eqNullSafe(F.col(kept_id)) & (F.col(mark) == F.col(kept_mark)), "left_semi"
    )
    order = Window.partitionBy(doc_id, mark).orderBy(mark)
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) == 1).drop(name, mark)


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays, that with its smallest id, with all its columns."""
    return rows_kept(docs, _grouped(docs, doc_id, text)[1].select("chosen.*").distinct(), doc_id, text)


def op7_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
