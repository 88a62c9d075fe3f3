"""Weighted keyword scoring and the A-D grade."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions.automaton import word_places
from pagewatch.functions.staging import computed_once
from pagewatch.functions.text import FLAT_WORDS, any_of, contains_any, literal, total_of, word_flags

@dataclass(frozen=True)
class Word:
    family: str
    polarity: str  # "positive" | "negative"
    word: str
    points: int


@dataclass(frozen=True)
class Vocabulary:
    """Weighted words in configuration order. Configuration, so it travels as literals."""

    words: tuple[Word, ...]

    @classmethod
    def from_maps(cls, maps: dict[str, dict[str, int]]) -> "Vocabulary":
        """From ``{"registration_positive": {word: points}, ...}``."""
        words = [
            Word(family, polarity, word, points)
            for family in fv.FAMILIES
            for polarity in ("positive", "negative")
            for word, points in maps.get(f"{family}_{polarity}", {}).items()
        ]
        return cls(tuple(words))

    def indexes(self, family: str, polarity: str) -> list[int]:
        return [i for i, w in enumerate(self.words) if (w.family, w.polarity) == (family, polarity)]


def keyword_flags(lowered: Column, vocabulary: Vocabulary) -> Column:
    """What the lower-cased text holds of the vocabulary.

    Up to ``FLAT_WORDS`` words this is one boolean per entry: is its word a substring? Beyond, it is
    the positions of the entries found, in one pass over the text. Needs neither a join nor a
    shuffle; scores and words are then read off it.
    """
    words = [w.word.lower() for w in vocabulary.words]
    return word_flags(lowered, words) if _flat(vocabulary) else word_places(lowered, words)


def _flat(vocabulary: Vocabulary) -> bool:
    return len(vocabulary.words) <= FLAT_WORDS


def _points(flags: Column, vocabulary: Vocabulary, entries: list[int]) -> Column:
    if _flat(vocabulary):
        return total_of([F.when(flags[i], vocabulary.words[i].points).otherwise(0) for i in entries])
    own = set(entries)
    points = literal([w.points if i in own else 0 for i, w in enumerate(vocabulary.words)], "int")
    return F.aggregate(flags, F.lit(0), lambda total, i: total + F.get(points, i))


def _any_flag(flags: Column, vocabulary: Vocabulary, entries: list[int]) -> Column:
    if _flat(vocabulary):
        return any_of([flags[i] for i in entries])
    own = set(entries)
    return F.exists(flags, lambda i: F.get(literal([k in own for k in range(len(vocabulary.words))], "boolean"), i))


def family_score(flags: Column, vocabulary: Vocabulary, family: str, positive_wins: bool = False) -> Column:
    positive, negative = vocabulary.indexes(family, "positive"), vocabulary.indexes(family, "negative")
    penalty = _points(flags, vocabulary, negative)
    if positive_wins:
        penalty = F.when(_any_flag(flags, vocabulary, positive), 0).otherwise(penalty)
    return _points(flags, vocabulary, positive) + penalty


def matched_words(flags: Column, vocabulary: Vocabulary, winners: Sequence[str] = ("computer",)) -> Column:
    """Distinct words found, family by family; negatives a positive hit overrules are left out."""
    groups, overruled = [], {}
    for family in fv.FAMILIES:
        positive, negative = vocabulary.indexes(family, "positive"), vocabulary.indexes(family, "negative")
        groups += [(positive, ""), (negative, family if family in winners else "")]
        overruled[family] = _any_flag(flags, vocabulary, positive) if family in winners else F.lit(False)
    if not any(entries for entries, _ in groups):
        return F.array().cast("array<string>")
    if _flat(vocabulary):
        found = [
            F.when(flags[i] & ~overruled[family] if family else flags[i], vocabulary.words[i].word)
            for entries, family in groups
            for i in entries
        ]
        return F.array_distinct(F.array_compact(F.array(*found)))
    words = literal([w.word for w in vocabulary.words], "string")
    of = {i: number for number, (entries, _) in enumerate(groups) for i in entries}
    group = literal([of.get(i, -1) for i in range(len(vocabulary.words))], "int")

    def of_group(number: int, family: str) -> Column:
        own = F.filter(flags, lambda i: F.get(group, i) == number)
        return F.when(overruled[family], F.array().cast("array<int>")).otherwise(own) if family else own

    listed = F.concat(*[of_group(number, family) for number, (_, family) in enumerate(groups)])
    return F.array_distinct(F.transform(listed, lambda i: F.get(words, i)))


def keyword_hits_long(df: DataFrame, vocabulary: Vocabulary, key: str, text: Column) -> DataFrame:
    """One row per (notice, vocabulary entry) hit."""
    names = literal(
        [{"family": w.family, "polarity": w.polarity, "word": w.word, "points": w.points} for w in vocabulary.words],
        "struct<family:string,polarity:string,word:string,points:int>",
    )
    lowered = computed_once(df.select(key, text.alias("_lower")), {"_lower": F.lower("_lower")})
    flagged = lowered.select(key, keyword_flags(F.col("_lower"), vocabulary).alias("_flags"))
    if _flat(vocabulary):
        exploded = flagged.select(key, F.posexplode("_flags").alias("ord", "hit")).where("hit")
    else:
        exploded = flagged.select(key, F.explode("_flags").alias("ord"))
    return exploded.select(key, "ord", F.get(names, F.col("ord")).alias("w")).select(
        key, "ord", "w.family", "w.polarity", "w.word", "w.points"
    )


def freshness(deadline_status: Column) -> Column:
    score = F.lit(fv.FRESHNESS_DEFAULT)
    for status, points in fv.FRESHNESS.items():
        score = F.when(deadline_status == status, points).otherwise(score)
    return score


def external_status(score: Column) -> Column:
    return (
        F.when(score >= 30, fv.STATUS_LIKELY).when(score <= -20, fv.STATUS_UNLIKELY).otherwise(fv.STATUS_CHECK)
    )


def computer_status(score: Column) -> Column:
    return F.when(score >= 30, fv.STATUS_LIKELY).when(score <= 0, fv.STATUS_UNRELATED).otherwise(fv.STATUS_CHECK)


def grade(registration: Column, external: Column, computer: Column, fresh: Column, status: Column) -> Column:
    total = registration + F.greatest(external, F.lit(0)) + F.greatest(computer, F.lit(0)) + fresh
    return (
        F.when(status == fv.STATUS_CLOSED, "D")
        .when((registration >= 70) & (external >= 25) & (computer >= 25) & (fresh > 0), "A")
        .when((registration >= 45) & (external >= 20) & (total >= 100), "B")
        .when((registration >= 20) | (computer >= 30), "C")
        .otherwise("D")
    )


def reason(grade_col: Column, registration: Column, ext_status: Column, comp_status: Column, status: Column) -> Column:
    return (
        F.when(grade_col == "A", F.format_string(fv.REASON_A, status))
        .when(grade_col == "B", F.format_string(fv.REASON_B, status))
        .when(grade_col == "C", F.format_string(fv.REASON_C, registration, ext_status, comp_status))
        .otherwise(fv.REASON_D)
    )


def with_classification(
    df: DataFrame,
    vocabulary: Vocabulary,
    *,
    title: str = "title",
    text: str = "text",
    status: str = "deadline_status",
    exclusion_terms: Sequence[str] = fv.HARD_EXCLUSION_TERMS,
) -> DataFrame:
    """Add scores, statuses, grade, matched words and reason; one narrow stage."""
    texts = df.withColumn("_haystack", F.concat(F.col(title), F.lit("\n"), F.col(text)))
    texts = computed_once(texts, {"_lower": F.lower("_haystack"), "_haystack": F.col("_haystack")})
    flagged = computed_once(
        texts,
        {
            "_flags": keyword_flags(F.col("_lower"), vocabulary),
            "_excluded": contains_any(F.col("_haystack"), exclusion_terms),
        },
    ).drop("_haystack", "_lower")
    flags = F.col("_flags")
    scored = computed_once(
        flagged,
        {
            "registration_score": family_score(flags, vocabulary, "registration"),
            "external_score": family_score(flags, vocabulary, "external"),
            "computer_score": family_score(flags, vocabulary, "computer", positive_wins=True),
            "freshness_score": freshness(F.col(status)),
            "matched_keywords": matched_words(flags, vocabulary),
        },
    ).drop("_flags")
    reg, ext, comp = F.col("registration_score"), F.col("external_score"), F.col("computer_score")
    scored = scored.withColumns(
        {
            "grade": F.when(F.col("_excluded"), "D").otherwise(
                grade(reg, ext, comp, F.col("freshness_score"), F.col(status))
            ),
            "external_applicant_status": external_status(ext),
            "computer_course_status": computer_status(comp),
        }
    ).drop("_excluded")
    return scored.withColumn(
        "reason",
        reason(
            F.col("grade"), reg, F.col("external_applicant_status"), F.col("computer_course_status"), F.col(status)
        ),
    )
