"""Tokenizer alignment against a plain double loop over the libraries' own tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pagewatch.llm import alignment
from tests.llm.data import NASTY, documents

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "a▁b and more words",
    "▁",
    "<s> </s> <unk> <0x0A> <|endoftext|> \x00 nul",
    "  two  spaces   and\n\nlines \n 1234 5.6e7 end  ",
    "日本語テキスト 中文 한국어 ไทย \U0001f469‍\U0001f680 é ﬁ ① Ⅷ",
    "the cat the cat the dog",
]


def brute(rows):
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    a_model = Tokenizer.from_file(PATH_A)
    a_model.encode_special_tokens = True
    a_model.no_truncation(), a_model.no_padding()
    b_model = SentencePieceProcessor(model_file=PATH_B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    grouped = []
    for _, text in rows:
        raw = f" {text}".encode()
        a = a_model.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        parts_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        parts_b = [b_bytes(i) for i in b]
        if not text or b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            grouped.append(([], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
        both, groups = set(ends_a) & set(ends_b), defaultdict(lambda: ([], []))
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, end in zip(ids, ends):
                groups[min(e for e in both if e >= end) if len(raw) < 2000 else next(e for e in range(end, len(raw) + 1) if e in both)][side].append(i)
        grouped.append((a, b, [groups[e] for e in sorted(groups)]))
    links = [Counter((x, y) for xs, ys in groups for x in xs for y in ys) for _, _, groups in grouped]
    held = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), (a, b, groups), own in zip(rows, grouped, links):
        best = sum(k for p, k in own.items() if held[p] == most[p[0]])
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        out.append((doc_id, len(a), len(b), len(groups), sum(own.values()), best, sum(k * held[p] for p, k in own.items()), text))
    return out


def found(docs, **more):
    rows = alignment.aligned(docs, PATH_A, PATH_B, **more).collect()
    return [(r["id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"] or "") for r in rows]


@pytest.mark.parametrize("chunk_links", [1, 1 << 18])
def test_awkward_documents_equal_brute_force(spark, chunk_links):
    docs = documents(spark, [*NASTY, *ODD, *ODD[-1:]]).repartition(3).cache()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter(found(docs, chunk_links=chunk_links)) == Counter(want)


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    query = {r["id"]: r for r in alignment.aligned(docs, PATH_A, PATH_B, value=lambda g: hashlib.sha256(g).hexdigest()).collect()}
    assert Counter(found(docs)) == Counter(want)
    assert {d: r["groups"] for d, r in query.items()} == {w[0]: hashlib.sha256(w[-1].encode()).hexdigest() for w in want}


def test_windows_of_a_long_document_change_nothing():
    rng = random.Random(5)
    words = ["the", "Straße", "tokenizer", "1234", "中文", "aaaaaaaaaaaaaaa", "\n", "  ", "naïve"]
    text = " ".join(rng.choice(words) for _ in range(60_000))
    aligner = alignment.Aligner(alignment.ByteTokens(PATH_A), alignment.PieceTokens(PATH_B))
    whole = aligner.align(list(aligner.stretches(text, 1 << 30)))
    parts = list(aligner.stretches(text, 5000))
    assert len(parts) > 3
    cut = aligner.align(parts)
    assert whole[0].sum(0).tolist() == cut[0].sum(0).tolist() and b";".join(cut[1]) == whole[1][0]
    assert Counter(zip(cut[3].tolist(), cut[4].tolist())) == Counter(zip(whole[3].tolist(), whole[4].tolist()))


def test_a_late_odd_character_leaves_no_tokens(spark):
    docs = spark.createDataFrame([(1, "plain words " * 40_000 + "▁"), (2, "plain words")], "doc_id int, text string")
    rows = sorted(found(docs, chunk_links=1))
    assert rows[0] == (1, 0, 0, 0, 0, 0, 0, "") and rows[1][1:3] == (2, 2) and rows[1][6] == 2


def test_wide_groups_count_every_link():
    a, b = np.array([5, 5, 7] * 40), np.array([9, 8] * 60)
    one = np.array([0])
    got = alignment.Aligner.pairs(a, b, one, one, np.array([len(a)]), np.array([len(b)]), one)
    want = Counter((x << 32) | y for x in a.tolist() for y in b.tolist())
    assert len(a) * len(b) > alignment.WIDE and dict(zip(got[1].tolist(), got[2].tolist())) == want


def test_gallop_equals_binary_search():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (1, 0), (7, 3), (1000, 50_000), (50_000, 60_000)):
        short, long = np.unique(rng.integers(0, 10**6, n)), np.unique(rng.integers(0, 10**6, m))
        for lanes in (1, 3, 2048) if n < 2000 else (2048,):
            assert alignment.gallop(short, long, lanes).tolist() == np.searchsorted(long, short).tolist()


def test_segments_equal_the_library_on_whole_texts():
    pieces, library = alignment.PieceTokens(PATH_B), SentencePieceProcessor(model_file=PATH_B)
    rng = random.Random(11)
    chars = "ab  \n\t1é中　.,'\"<>0x▁Ünder-scored_THE"
    texts = [t for t in (*NASTY, *ODD) if t] + ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    for text in texts:
        ids = np.frombuffer(b"".join(pieces.blocks(f" {text}")), "<u4")
        assert ids[ids != alignment.DIFFERS].tolist() == library.encode(text), repr(text)


def test_no_documents(spark):
    assert alignment.aligned(documents(spark, []), PATH_A, PATH_B).count() == 0
