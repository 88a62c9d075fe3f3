"""The pipeline's near dedup against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from pagewatch.llm import graph, near
from tests.llm.data import NASTY, documents


def brute_kept(rows):
    """Ids that stay: the least of each component over 5-word Jaccard >= 0.8; and how many components there are."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and len(a & b) * 5 >= len(a | b) * 4:
                parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {min(g, key=lambda d: (d is None, d or 0)) for g in groups.values()}, len(groups)


def crowd():
    """Chains of near copies of a few texts, texts at 0.5 to 0.9 of them, and texts of the same one line."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for _ in range(3):
        words = [word() for _ in range(150)]
        for _ in range(70):
            other = list(words)
            for _ in range(rng.randrange(6)):
                other[rng.randrange(150)] = word()
            out.append(" ".join(other))
            if rng.random() < 0.3:
                words = other
    line = " ".join(word() for _ in range(12))
    return out + [f"{line} {' '.join(word() for _ in range(rng.randrange(30)))}" for _ in range(60)]


@pytest.mark.parametrize("each, rounds", [(10**9, 0), (0, 1), (0, 3), (1, 4)])
def test_near_copies_equal_brute_force(spark, each, rounds):
    docs = documents(spark, [*NASTY, *crowd()]).cache()
    kept, groups = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = near.without_near_copies(docs, each=each, rounds=rounds)
    assert out.columns == docs.columns and out.count() == groups < docs.count() - 50
    assert {r["doc_id"] for r in out.collect()} == kept


def test_stage_drops_near_copies_of_given_documents(spark):
    """5-word Jaccard 0.83 and up, but over two bits apart: the stage kept both of each."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id in (1, 177, 6, 145)")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 6]


def test_no_documents(spark):
    none = documents(spark, [])
    assert near.without_near_copies(none).count() == 0


def test_sketches_never_differ_in_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(1)
    for size in (0, 1, 40, 900, 20_000):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        b = np.unique(np.append(a[: size // 2], rng.integers(0, 1 << 62, size // 3).astype(np.uint64)))
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(near.sketch_of(a), near.sketch_of(b), strict=True))
        assert bits <= len(np.setxor1d(a, b))


def test_no_more_pairs_are_found_than_a_few_for_each_entry(spark):
    """Texts of one template, 0.5 to 0.75 like each other, meet in the same lists and are no links."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(9):
            words[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = documents(spark, texts, extra=False)
    kept, groups = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = near.without_near_copies(docs)
    assert out.count() == groups and {r["doc_id"] for r in out.collect()} == kept


def test_the_stage_links_what_simhash_links_too(spark):
    """Three shingles many times over outvote forty rare ones in a fingerprint, but not in a set of shingles."""
    line = "alpha beta gamma " * 300
    texts = [line, line + " ".join(f"rare{i}" for i in range(40)), "something else " + " ".join(f"w{i}" for i in range(60)), None]
    docs = documents(spark, texts)  # and one without an id
    assert near.without_near_copies(docs).count() == 5
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns and left.count() == 4
    assert {(r["text"] or "")[:9] for r in left.collect()} == {"alpha bet", "something", "no id her", ""}
    assert line in {r["text"] for r in left.collect()}


def test_turns_that_link_nothing_work_out_no_components_again(spark, monkeypatch):
    """Texts of one template that are no links: components were worked out anew each turn, over all links found."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(9):
            words[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"{n}-{i}" for i in range(60 + k)) for n in range(20) for k in range(3)]
    docs = documents(spark, texts, extra=False)
    kept, groups = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    called, linking = [], near.components
    monkeypatch.setattr(near, "components", lambda edges: called.append(edges.count()) or linking(edges))
    out = near.without_near_copies(docs, each=0)
    assert out.count() == groups and {r["doc_id"] for r in out.collect()} == kept
    assert called[0] and len(called) < near.ROUNDS + 1


def test_a_component_is_written_in_few_files(spark, monkeypatch):
    """Each table had a file for every partition of the shuffles."""
    written, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: written.append(out := stored(df)) or out)
    edges = spark.createDataFrame([(i + 1, i) for i in range(600)] + [(5000 + i, 4000) for i in range(300)], "u long, v long")
    wanted = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
    assert roots == {i: 0 for i in range(601)} | {i: 4000 for i in (4000, *range(5000, 5300))}
    assert len(written) > 2 and all(len(t.inputFiles()) <= spark.sparkContext.defaultParallelism for t in written[1:])
