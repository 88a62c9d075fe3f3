"""The streaming transducer against the tokenizers library."""

import random

import numpy as np
import pytest

from pagewatch.llm import bpe
from tests.llm.data import NASTY


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def same(encoder, library, text):
    ids = np.frombuffer(b"".join(encoder.blocks(text)), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    decoder = bpe.Decoder(encoder.vocabulary)
    back = "".join(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + decoder.end()
    assert back == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", NASTY)
def test_texts(encoder, library, text):
    same(encoder, library, text or "")


def test_random_mixtures(encoder, library):
    rng = random.Random(1)
    alphabet = "ab eE'stremvlld  \n\t 019²½#&é中́​힣\U0001f600Ᲊ\x1c\xa0　"
    for _ in range(400):
        same(encoder, library, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))))


def test_streams_of_small_blocks(encoder, library, monkeypatch):
    """Blocks of a few characters cut words, blanks and contractions everywhere."""
    rng = random.Random(2)
    for block in (4, 7, 16):
        monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
        for _ in range(150):
            same(encoder, library, "".join(rng.choice("ab'sre 1#\n  é") for _ in range(rng.randint(1, 120))))


def test_long_words_with_bounded_lookahead(encoder, library):
    rng = random.Random(3)
    longs = ["a" * 9000, "=" * 7001, " " * 5000 + "x", "ab" * 4000, "\n" * 3000]
    longs += ["".join(rng.choice("etaoinshr") for _ in range(6000)) for _ in range(4)]
    longs += ["".join(rng.choice("guaranteeing") for _ in range(6000)), "é" * 4000, "中文" * 3000]
    for text in longs:
        same(encoder, library, text)
    assert 0 < encoder.vocabulary.lookahead < bpe.WHOLE_BYTES


def test_null_and_empty(encoder):
    assert bpe.round_trip(encoder, None) == bpe.round_trip(encoder, "")
    assert bpe.round_trip(encoder, None)[0] == 0


def test_words_merged_by_rank_equal_the_library():
    import public_tokenizers

    from pagewatch.llm.id_files import LibraryEncoder
    from pagewatch.llm.words import WordEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, library = WordEncoder(path), LibraryEncoder(path)
    assert fast.merge is not None
    rng = random.Random(12)
    tokens = [b.decode() for b in fast.bytes_of if b.isascii()]
    for _ in range(20_000):
        word = "".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.5:
            word = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(1, 20)))
        assert fast._ids(word) == library._ids(word), repr(word)
    assert fast._ids("ab" * 60_000) == library._ids("ab" * 60_000)
