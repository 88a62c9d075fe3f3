"""Quality rules: two plain rules, then gradient-boosted trees over document statistics.

The trees are grown in numpy on labelled documents and flattened into node
arrays, so a block of documents is scored by a few array lookups per level.
Chosen statistics may only lower a score (``NEVER_BETTER``). A document is kept
if the plain rules pass and its score reaches a threshold set on labelled
documents the trees did not see, so that nearly all good ones stay.

Null text counts as empty: no words, so the plain rules reject it. Labels that
are null, and rows whose id is null, teach nothing; an id labelled twice counts
as good only if all its labels say so. Without labels of both kinds the plain
rules decide alone. Repeated rows get equal verdicts; an empty table gives none.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import BLANKS, each_row

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of words
SYMBOLS = "#*$%&|<>"
MARKS = "!\"'(),-./:;?[]_{}~"
#: Most labelled documents the trees are grown on; the choice is by a hash of the id.
TRAIN_ROWS = 4000
KEEP_GOOD = 0.998
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share",
    "mark_share", "digit_share", "top_word_share",
)
NEVER_BETTER = ("symbol_share", "dup_line_share", "repeat_share")


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    first = ids[:-2] * size + ids[1:-1]
    if size > 2_000_000:  # else the product below stays within 63 bits
        first = np.unique(first, return_inverse=True)[1]
    _, place, count = np.unique(first * size + ids[2:], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The five counts of a text, and its features for the trees."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on ASCII white space alone

    def of_kind(kind: bytes) -> int:
        return len(raw) - len(raw.translate(None, kind))

    n, chars = len(words), len(text) - of_kind(BLANKS.encode())
    symbols = of_kind(SYMBOLS.encode())
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    copies = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    counts = Counter(words)
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    capitals, marks, digits = (of_kind(kind.encode()) for kind in (string.ascii_uppercase, MARKS, string.digits))
    features = [
        math.log1p(n), chars * per_word, symbols * per_word, copies / max(len(lines), 1), repeats * per_word,
        capitals * per_char, len(counts) * per_word, marks * per_char, digits * per_char,
        max(counts.values(), default=0) * per_word,
    ]
    return (n, chars, symbols, copies, repeats), features


def base_failed(words: int, repeats: int) -> bool:
    return words < MIN_WORDS or 100 * repeats > MOST_REPEATED * words


class Trees:
    """Boosted trees in flat arrays: node k of tree t tests ``feature[t, k] <= cut[t, k]``, children are 2k+1 and 2k+2."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, start: float, threshold: float):
        self.feature, self.cut, self.value, self.start, self.threshold = feature, cut, value, start, threshold

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of being good, for a block of feature rows."""
        depth = int(math.log2(self.feature.shape[1] + 1))
        total = np.full(len(rows), self.start)
        at_row = np.arange(len(rows))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (rows[at_row, feature[at]] > cut[at])
            total += value[at - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def grow(
    rows: np.ndarray, good: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48,
    ridge: float = 1.0, least: float = 2.0,
) -> Trees:
    """Grow trees on feature rows. ``signs``: -1 where a feature may only lower the score, +1 only raise, 0 free.

    A split that breaks a sign is passed over, and what lies below a split keeps
    to its side of the midpoint of the two children.
    """
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in rows.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, rows.T, strict=True)], 1)
    rate_good = float(np.clip(good.mean(), 1e-3, 1 - 1e-3))
    start = math.log(rate_good / (1 - rate_good))
    total = np.full(len(rows), start)
    inner, leaves = 2**depth - 1, 2**depth
    features, cut_at, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        slope, bend = good - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(rows), np.int64)
        feature, cut, bounds = np.zeros(inner, np.int64), np.full(inner, np.inf), {0: (-np.inf, np.inf)}
        for k in range(inner):
            here = np.flatnonzero(node == k)
            low, high = bounds[k]
            best = (1e-9, None, None, None, None)
            g, h = slope[here].sum(), bend[here].sum()
            own = np.clip(g / (h + ridge), low, high)
            for f, c in enumerate(cuts):
                if not len(c) or not len(here):
                    continue
                left_g = np.cumsum(np.bincount(binned[here, f], slope[here], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[here, f], bend[here], len(c) + 1))[:-1]
                left = np.clip(left_g / (left_h + ridge), low, high)
                right = np.clip((g - left_g) / (h - left_h + ridge), low, high)
                gain = _worth(left_g, left_h, left, ridge) + _worth(g - left_g, h - left_h, right, ridge) - _worth(g, h, own, ridge)
                allowed = (left_h >= least) & (h - left_h >= least) & (signs[f] * (right - left) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                if gain.max() > best[0]:
                    j = int(gain.argmax())
                    best = (gain[j], f, c[j], left[j], right[j])
            left_bound = right_bound = (low, high)
            if best[1] is not None:
                feature[k], cut[k] = best[1], best[2]
                middle = (best[3] + best[4]) / 2
                if signs[best[1]] < 0:
                    left_bound, right_bound = (middle, high), (low, middle)
                elif signs[best[1]] > 0:
                    left_bound, right_bound = (low, middle), (middle, high)
            bounds[2 * k + 1], bounds[2 * k + 2] = left_bound, right_bound
            node[here] = 2 * k + 1 + (rows[here, feature[k]] > cut[k])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, bend, leaves)
        low, high = np.array([bounds[inner + i] for i in range(leaves)]).T
        value = rate * np.clip(g / (h + ridge), low, high)
        total += value[leaf]
        features.append(feature)
        cut_at.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(cut_at), np.array(values), start, 0.5)


def _worth(g, h, value, ridge):
    return g * value - 0.5 * (h + ridge) * value**2


def signs_of(features: tuple[str, ...] = FEATURES) -> np.ndarray:
    return np.array([-1 if f in NEVER_BETTER else 0 for f in features])


def fit(rows: np.ndarray, good: np.ndarray, held: np.ndarray, keep_good: float = KEEP_GOOD) -> Trees | None:
    """Trees grown on the rows not ``held``; the threshold keeps ``keep_good`` of the good rows that are held."""
    if not len(rows) or len(set(good[~held].tolist())) < 2:
        return None
    trees = grow(rows[~held], good[~held], signs_of())
    seen = trees.score(rows[held & (good == 1)])
    if len(seen):
        trees.threshold = float(min(0.5, np.quantile(seen, 1 - keep_good)))
    return trees


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from at most ``rows`` labelled documents, chosen by a hash of their ids."""
    named = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    chosen = named.agg(F.min("quality").alias("_good")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most `rows` ids and flags
    met = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    held = F.pmod(F.xxhash64("_id", F.lit("held")), F.lit(4)) == 0

    def make():
        return lambda words, mark, good, apart: (mark, statistics(words)[1], int(good), bool(apart))

    found = each_row(
        met.select("_text", F.xxhash64("_id"), "_good", held),
        make,
        "mark long, features array<double>, good int, held boolean",
        [("mark", pa.int64()), ("features", pa.list_(pa.float64())), ("good", pa.int32()), ("held", pa.bool_())],
    )
    # where ids repeat more rows may match than the bound: put in order, then cut
    taught = found.orderBy("mark", "features", "good").limit(rows).collect()
    taught.sort(key=lambda r: (r["features"], r["good"], r["held"]))
    return fit(
        np.array([r["features"] for r in taught], np.float64).reshape(-1, len(FEATURES)),
        np.array([float(r["good"] > 0) for r in taught]),
        np.array([r["held"] for r in taught], bool),
    )


def judged(texts: list[str | None], trees: Trees | None) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base verdicts, scores and final verdicts of a block of texts; the trees score the block at once."""
    found = [statistics(t) for t in texts]
    counts = [c for c, _ in found]
    failed = np.array([base_failed(c[0], c[4]) for c in counts], bool)
    if trees is None or not found:
        score, good = np.ones(len(found)), np.ones(len(found), bool)
    else:
        score = trees.score(np.array([f for _, f in found]))
        good = score >= trees.threshold
    return counts, failed, score, good & ~failed


def graded(docs: DataFrame, trees: Trees | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    arrow = pa.schema(
        [("id", to_arrow_type(kind)), *[(n, pa.int64()) for n in names], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())]
    )
    schema = f"id {kind.simpleString()}, {', '.join(f'{n} bigint' for n in names)}, base_failed boolean, kept boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, failed, score, kept = judged(part.column(1).to_pylist(), trees)
                columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                arrays = [part.column(0), *columns, pa.array(failed), pa.array(kept), pa.array(score)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def keep_good(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; only the text goes to Python."""
    @F.pandas_udf("boolean")
    def passes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for block in texts:
            words = [None if t is None else str(t) for t in block]
            kept = [k for at in range(0, len(words), 512) for k in judged(words[at : at + 512], trees)[3].tolist()]
            yield pd.Series(kept, dtype=bool)

    return docs.filter(passes(F.col(text)))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return graded(docs, trees).withColumnRenamed("id", "doc_id")
