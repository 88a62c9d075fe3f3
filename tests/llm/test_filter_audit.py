"""Filter audit: measures and interactions against plain loops over words and orders."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pyarrow as pa
import pytest

from pagewatch.llm import filter_audit as audit
from tests.llm.data import NASTY, documents

SPACES = r"[^\x20\x09-\x0D]+"

ODD = [
    "A B C D " * 100,
    "same same other " * 90,
    " ".join(f"word{i}" for i in range(250)),
    " ".join(f"word{i}" for i in range(250)) + " #",
    "x" * 70 + " " + "x" * 70 + " " + "x" * 69 + "y " + "x" * 71,
    "äÄ中\U0001f600 " * 60,
    "ab\x00cd ab\x00cd ab",
    "tab\x0bvert\x0cfeed\rback\x1cno\x85no",
]


def brute_measures(text):
    words = re.findall(SPACES, text or "")
    capitals, symbols = len(re.findall("[A-Z]", text or "")), len(re.findall(r"[#$%&*|]", text or ""))
    return len(words), len(set(words)), capitals, len(text or ""), symbols


def brute_rows(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    good, bad = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    larger = lambda d: (d is None, d or 0)
    fails = []
    for doc_id, text, part in docs:
        words, distinct, capitals, points, symbols = brute_measures(text)
        copy = any((t or "") == (text or "") and larger(d) < larger(doc_id) for d, t, _ in docs)
        own = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 3 * points, "D": symbols > 0, "E": copy}
        fails.append((doc_id, part or "", {k for k, v in own.items() if v}))
    out = {}
    for part in {p for _, p, _ in fails}:
        removed_by = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[1] == part]
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[2]]
                left = [f for f in left if letter not in f[2]]
                failing = [f for f in fails if f[1] == part and letter in f[2]]
                only = sum(f[2] == {letter} for f in failing)
                removed_by[letter] += len(gone)
                lost = [sum(f[0] in marked for f in gone if f[0] is not None) for marked in (good, bad)]
                rows[part, order, step] = (len(left), len(gone), len(failing) - len(gone), only, *lost)
        out |= {key: (*row, removed_by[key[1][key[2] - 1]]) for key, row in rows.items()}
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 21])
def test_transducer_equals_plain_counts(block):
    rng = random.Random(block)
    texts = [t or "" for t in (*NASTY, *ODD)]
    texts += ["".join(rng.choice("aB \n#é中\U0001f600\x0b") for _ in range(rng.randrange(120))) for _ in range(300)]
    want = [brute_measures(t) for t in texts]
    assert [tuple(r) for r in audit.measured_texts(pa.array(texts), block)] == want
    both = pa.array(["left out", *texts])[1:]  # a slice of a longer array
    assert [tuple(r) for r in audit.measured_texts(both, block)] == want


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(audit.Words, "hashes", lambda self: (self.lengths * 0).astype("uint64"))
    texts = ["a b c a b", "a", " ".join("x" * n for n in range(60, 80)) + " " + "x" * 79]
    assert [r[1] for r in audit.measured_texts(pa.array(texts))] == [3, 1, 20]


def test_interactions_equal_brute_force(spark):
    docs = documents(spark, [*NASTY, *ODD, *ODD]).repartition(3).cache()
    labels = spark.createDataFrame(
        [(i, i % 2, int(i % 3 == 0)) for i in range(0, 30)] + [(1, 0, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )
    rows = audit.interactions(audit.failure_counts(audit.failures(docs), labels)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    want = brute_rows(
        [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [tuple(r) for r in labels.filter("doc_id is not null").collect()]
    )
    assert len(rows) == len(found) == 3 * 120 * 5 and found == want


def test_every_document_of_a_part_is_kept_or_removed_once(spark):
    rows = audit.op13_filter_audit(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").groupBy("lang").count().collect()
    sizes = {r["lang"]: r["count"] for r in docs}
    orders = {}
    for r in rows:
        orders.setdefault((r["part"], r["filter_order"]), []).append(r)
    assert len(orders) == 120 * len(sizes)
    for (part, _), steps in orders.items():
        assert sum(r["removed"] for r in steps) + min(r["kept"] for r in steps) == sizes[part]
        assert sum(r["shapley"] for r in steps) == 120 * sum(r["removed"] for r in steps)


def test_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.failure_counts(audit.failures(documents(spark, [])), labels)).count() == 0
