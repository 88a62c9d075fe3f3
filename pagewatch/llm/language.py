"""Language identification in two steps: the family first, then the languages within it.

A text becomes a vector of hashed letter n-grams (one to four letters, word by
word), square-rooted and scaled to length one. One linear classifier picks the
family; within it a linear support vector machine stands for each pair of
languages, and the language that wins most duels, by margin if tied, is the
prediction. The score is the family's probability times the mean probability
that the language wins its duels. All models are trained in numpy on a sample
of at most ``TRAIN_ROWS`` labelled documents, spread evenly over the languages
and chosen by a hash.

Texts that are null or without a letter are ``und`` with score 0, and so is every
text if nothing was labelled. Labels unknown to ``FAMILIES`` form a family of
their own. Long texts are counted in blocks, whose size changes no count. Repeated
rows give equal results; an empty table gives none.

The sample travels to the driver as the bins that are not zero and their values.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewatch.durable import stored
from pagewatch.llm.common import each_row

# Language families by code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "celtic": ("ga", "cy", "gd", "br"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne", "si"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh",),
    "austronesian": ("id", "ms", "tl", "jv"),
}
OTHER = "other"
UNKNOWN = "und"
BIN_BITS = 13
BINS = 1 << BIN_BITS
ORDERS = 4
BLOCK = 1 << 16
TRAIN_ROWS = 2_400
HELD_REMAINDER, PARTS = 2, 4


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), OTHER)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def counts_of(text: str) -> np.ndarray:
    """Counts of hashed n-grams of letters; other characters end a word, and a word's ends count as one blank."""
    total = np.zeros(BINS)
    text = text.lower()
    carry = np.zeros(0, np.uint64)
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ascii_letter = (points >= 97) & (points <= 122)
        points = np.where(ascii_letter | (points >= 192), points, 32)
        before = carry[-1:] if at else np.array([0], np.uint64)
        points = points if at else np.concatenate([np.array([32], np.uint64), points])
        # runs of blanks become one
        points = points[(points != 32) | (np.concatenate([before, points[:-1]]) != 32)]
        kept = np.concatenate([carry, points])
        gram = kept
        for order in range(1, ORDERS + 1):
            if order > 1:
                gram = gram[:-1] * np.uint64(1_000_003) + kept[order - 1 :]
            # those that end before this block are counted
            own = gram[max(0, len(carry) - order + 1) :]
            mixed = (own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order * 0x5851F42D)) >> np.uint64(64 - BIN_BITS)
            total += np.bincount(mixed.astype(np.int64), minlength=BINS)
        carry = kept[-(ORDERS - 1) :]
    return total


def features(text: str) -> np.ndarray:
    root = np.sqrt(counts_of(text))
    return (root / max(np.linalg.norm(root), 1e-12)).astype(np.float32)


def packed(row: np.ndarray) -> bytes:
    """The bins that are not zero and their values."""
    bins = np.flatnonzero(row)
    return bins.astype("<u2").tobytes() + row[bins].astype("<f4").tobytes()


def unpacked(found: list[bytes]) -> np.ndarray:
    """A matrix of packed rows, with a last column of ones for the bias."""
    x = np.zeros((len(found), BINS + 1), np.float32)
    x[:, BINS] = 1
    for row, packed_row in zip(x, found, strict=True):
        n = len(packed_row) // 6
        row[np.frombuffer(packed_row, "<u2", n)] = np.frombuffer(packed_row, "<f4", n, 2 * n)
    return x


def svm(rows: np.ndarray, sign: np.ndarray, strength: float = 10.0, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Weights of a linear support vector machine, by dual coordinate descent; the last column of ``rows`` is one, for the bias."""
    size, alpha, w = np.einsum("ij,ij->i", rows, rows), np.zeros(len(rows)), np.zeros(rows.shape[1])
    cap = strength * np.where(sign > 0, 1 / max((sign > 0).mean(), 1e-6), 1 / max((sign < 0).mean(), 1e-6)) / 2
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (w @ rows[i]) - 1
            fresh = min(max(alpha[i] - slope / size[i], 0.0), cap[i])
            if fresh != alpha[i]:
                w += (fresh - alpha[i]) * sign[i] * rows[i]
                alpha[i] = fresh
    return w


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]  # languages by family
    family_weights: np.ndarray  # a row per family
    duels: list[list[tuple[int, int]]]  # pairs of a family's languages
    duel_weights: list[np.ndarray]  # a row per duel; positive is the first language

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.families:
            return UNKNOWN, 0.0
        x = np.append(features(text), 1.0)
        z = 4.0 * (self.family_weights @ x)
        odds = np.exp(z - z.max())
        odds /= odds.sum()
        k = int(odds.argmax())
        langs = self.members[k]
        if len(langs) == 1:
            return langs[0], float(odds[k])
        wins, margin, chance = np.zeros(len(langs)), np.zeros(len(langs)), np.zeros(len(langs))
        for (a, b), d in zip(self.duels[k], self.duel_weights[k] @ x, strict=True):
            wins[a if d >= 0 else b] += 1
            margin[a] += d
            margin[b] -= d
            p = 1 / (1 + np.exp(-4.0 * d))
            chance[a] += p
            chance[b] += 1 - p
        best = max(range(len(langs)), key=lambda i: (wins[i], margin[i], -i))
        return langs[best], float(odds[k] * chance[best] / (len(langs) - 1))


def fit(rows: np.ndarray, langs: list[str]) -> Model:
    """Family machines, one against the rest, then a machine per pair of languages within each family."""
    of = np.array(langs)
    families = sorted({family_of(x) for x in langs})
    members = [sorted({x for x in langs if family_of(x) == f}) for f in families]
    home = np.array([families.index(family_of(x)) for x in langs], int)
    wide = rows.shape[1]
    if len(families) > 1:
        weights = np.stack([svm(rows, np.where(home == k, 1.0, -1.0)) for k in range(len(families))])
    else:
        weights = np.zeros((len(families), wide))
    duels, machines = [], []
    for group in members:
        pairs = list(itertools.combinations(range(len(group)), 2))
        duels.append(pairs)
        trained = []
        for a, b in pairs:
            own = (of == group[a]) | (of == group[b])
            trained.append(svm(rows[own], np.where(of[own] == group[a], 1.0, -1.0)))
        machines.append(np.stack(trained) if trained else np.zeros((0, wide)))
    return Model(families, members, weights, duels, machines)


def _remainder(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(PARTS))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Train on labelled documents outside the held part.

    The counts of labelled rows per language say how large a part of each
    language's hashes to take, so only about ``rows`` texts are looked at.
    """
    may = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (_remainder(doc_id) != HELD_REMAINDER))
    # one row per language
    sizes = may.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"))
    share = (F.lit(rows) / F.count("*").over(Window.partitionBy()) / F.col("_n")).alias("_share")
    sizes = stored(sizes.select("_lang", share))
    place = F.pmod(F.xxhash64(F.col(doc_id), F.lit("learn")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    met = may.select(F.col(lang).alias("_of"), F.col(text).alias("_text"), place.alias("_place"))
    chosen = met.join(sizes, F.col("_of") == F.col("_lang")).filter("_place < _share").select("_text", "_of", "_place")

    def make():
        return lambda words, of, place: (packed(features(words)) if has_letter(words) else None, of, place)

    found = each_row(chosen, make, "row binary, of string, place double", [("row", pa.binary()), ("of", pa.string()), ("place", pa.float64())])
    taken = found.filter("row is not null").orderBy("place", "of", "row").limit(rows).collect()
    return fit(unpacked([r["row"] for r in taken]), [r["of"] for r in taken])


def identified(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, held_out, lang_pred, score."""
    kind = docs.schema[doc_id].dataType
    held = F.coalesce(_remainder(doc_id) == HELD_REMAINDER, F.lit(False))

    def make():
        return lambda key, held, words: (key, held, *model.predict(words))

    return each_row(
        docs.select(F.col(doc_id), held.alias("held"), F.col(text)),
        make,
        f"id {kind.simpleString()}, held_out boolean, lang_pred string, score double",
        [("id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())],
    )


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, learn(docs)).withColumnRenamed("id", "doc_id")
