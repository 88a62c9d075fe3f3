"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Lookahead. Compare two continuations of the same bytes and let the front be the
last place up to which both have equal tokens. A merge can move the front back
by its left part only if its right part begins where the front is, so the
right part has the left part of the merge that moved the front before on its
left edge; and that merge ranks earlier. The largest sum of left parts over
such chains is how far from the end of the bytes seen any token can still
change. ``lookahead`` computes it in one pass over the merge list. Tokens that
end before it are emitted; what is held is the lookahead and one block, however
long the text or a single word of it is.

The text is cut into words first, also as a stream: a word is passed on once
the next characters can't change it, and a word longer than a block goes on in
fragments.

Null text counts as empty and gives no ids. Words are encoded once per task and
remembered (``REMEMBERED`` at most, then afresh). Repeated rows give equal
results; an empty table gives none.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import each_row, text_of

BLOCK_CHARS = 1 << 16
REMEMBERED = 400_000
#: Words up to this many bytes are merged whole; longer ones go through the window.
WHOLE_BYTES = 1024

# White space, and the letters and numbers of Unicode 16 that older character tables lack.
WHITE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 "
    "113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


@lru_cache(maxsize=2)
def patterns(code_points: int = sys.maxunicode + 1) -> dict[str, re.Pattern]:
    """The word pattern, and per kind of word the pattern its continuation follows, for texts below a code point."""

    def chars(kind: str, more: str) -> str:
        codes = {c for c in range(code_points) if unicodedata.category(chr(c))[0] == kind}
        for span in more.split() if code_points > 256 else ():
            low, _, high = span.partition("-")
            codes |= set(range(int(low, 16), int(high or low, 16) + 1))
        spans: list[list[int]] = []
        for c in sorted(codes):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)

    letter, number = chars("L", NEW_LETTERS), chars("N", NEW_NUMBERS)
    other = f"[^{WHITE}{letter}{number}]"
    # words of letters, the most frequent, are tried first: no other kind begins as they do
    word = f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?{other}+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    kinds = {"letter": f"[{letter}]", "number": f"[{number}]", "other": other, "white": f"[{WHITE}]"}
    return {"word": re.compile(word)} | {k: re.compile(f"{v}*") for k, v in kinds.items()}


def patterns_for(text: str) -> dict[str, re.Pattern]:
    """Small character tables where the text lets them do: the same words, found faster."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return patterns()
    return patterns(256)


def words_of(chunks: Iterable[str]) -> Iterator[tuple[list[str], bool]]:
    """Cut a stream of text into words: lists of whole words, or one fragment of a longer word.

    The flag says that the last of the list goes on in the next list.
    """
    rest, kind, chunks = "", None, iter(chunks)
    while True:
        chunk = next(chunks, None)
        last = chunk is None
        rest += chunk or ""
        found = patterns_for(rest)
        if kind:
            end = found[kind].match(rest).end()
            if end == len(rest) and not last:
                hold = 1 if kind == "white" else 0  # the last blank may belong to the next word
                yield [rest[: end - hold]], True
                rest = rest[end - hold :]
                continue
            if kind == "white" and end < len(rest):
                end -= 1
            yield [rest[:end]], False
            rest, kind = rest[end:], None
        words, tail = found["word"].findall(rest), 0
        if not last:
            # what ends within the last three characters may still change
            while words and tail < 3:
                tail += len(words.pop())
            rest = rest[len(rest) - tail :]
        if words:
            yield words, False
        if last:
            return
        if len(rest) >= BLOCK_CHARS:
            probe = rest[-1]
            kind = next(k for k in ("letter", "number", "white", "other") if found[k].fullmatch(probe))
            if found["word"].match(rest).end() != len(rest):
                kind = None  # two long words meet here: look again with more text
                continue
            hold = 1 if kind == "white" else 0
            yield [rest[: len(rest) - hold]], True
            rest = rest[len(rest) - hold :]


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and byte strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, letters = data["model"], byte_letters()
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        # a pair as one number; its rank and its result as another
        self.ranks = {(a << 32) | b: (rank << 32) | made for rank, (a, b, made) in enumerate(self.merges)}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        left_part: dict[int, int] = {}
        reach: dict[int, int] = {}  # by left part: the longest chain that ends with such a merge
        most = 0
        for a, b, made in self.merges:
            edge, before = b, reach.get(b, 0)
            while edge in left_part:
                edge = left_part[edge]
                before = max(before, reach.get(edge, 0))
            chain = len(self.bytes_of[a]) + before
            reach[a] = max(reach.get(a, 0), chain)
            left_part[made] = a
            most = max(most, chain)
        return most


def merge(ids: list[int], ranks: dict[int, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until no pair has a rank."""
    none = 1 << 62
    if len(ids) < 40:
        found = [ranks.get((a << 32) | b, none) for a, b in zip(ids, ids[1:])]
        while found and (low := min(found)) < none:
            k = found.index(low)
            ids[k : k + 2] = [low & 0xFFFFFFFF]
            del found[k]
            if k < len(found):
                found[k] = ranks.get((ids[k] << 32) | ids[k + 1], none)
            if k:
                found[k - 1] = ranks.get((ids[k - 1] << 32) | ids[k], none)
        return ids
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((ids[i] << 32) | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or ranks.get((ids[i] << 32) | ids[j]) != r:
            continue
        ids[i], ids[j] = r & 0xFFFFFFFF, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((ids[i] << 32) | ids[k])) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((ids[h] << 32) | ids[i])) is not None:
            heapq.heappush(heap, (r, h))
    return [i for i in ids if i >= 0]


class Encoder(dict):
    """Text to ids. As a mapping it gives a whole word's ids, packed as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.added = vocabulary, vocabulary.added

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        if len(raw) > WHOLE_BYTES:
            return b"".join(self.long_word([raw]))
        own = self.vocabulary
        ids = merge([own.byte_ids[b] for b in raw], own.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        self._remember(word, packed)
        return packed

    def _remember(self, word: str, packed: bytes) -> None:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = packed

    def long_word(self, parts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of one word that comes in parts: what lies before the lookahead is emitted as it becomes stable."""
        own, held = self.vocabulary, b""
        window = max(4 * own.lookahead, WHOLE_BYTES)
        for part in parts:
            for at in range(0, len(part), window):
                held += part[at : at + window]
                if len(held) < window:
                    continue
                ids, stable, count = merge([own.byte_ids[b] for b in held], own.ranks), 0, 0
                for i in ids:
                    size = len(own.bytes_of[i])
                    if stable + size > len(held) - own.lookahead:
                        break
                    stable, count = stable + size, count + 1
                yield np.array(ids[:count], "<u4").tobytes()
                held = held[stable:]
        yield np.array(merge([own.byte_ids[b] for b in held], own.ranks), "<u4").tobytes()

    def _stretch(self, text: str) -> Iterator[bytes]:
        """Ids of a stretch without added tokens."""
        lists = words_of(text[at : at + BLOCK_CHARS] for at in range(0, len(text), BLOCK_CHARS))
        for words, goes_on in lists:
            if not goes_on:
                yield b"".join(map(self.__getitem__, words))
                continue

            def parts(words=words):
                yield words[0].encode("utf-8", "replace")
                for more, on in lists:
                    yield more[0].encode("utf-8", "replace")
                    if not on:
                        return

            yield from self.long_word(parts())

    def blocks(self, text: str) -> Iterator[bytes]:
        """Packed ids of a whole text, block by block. Added tokens stand for themselves wherever they occur."""
        stretches = [(text, None)]
        for token, i in self.added.items():
            if token in text:
                parts = text.split(token)
                stretches = [(p, i) for p in parts[:-1]] + [(parts[-1], None)]
        for stretch, i in stretches:
            yield from self._stretch(stretch)
            if i is not None:
                yield np.array([i], "<u4").tobytes()


class Decoder:
    """Ids to text, any number at a time: bytes that do not yet make a character are held back."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", final=True)


def round_trip(encoder: Encoder, text: str | None) -> tuple[int, str, str]:
    """Number of ids, and hashes of the ids and of the text decoded from them, without holding either."""
    ids, decoded, count = hashlib.sha256(), hashlib.sha256(), 0
    decoder = Decoder(encoder.vocabulary)
    for block in encoder.blocks(text or ""):
        ids.update(block)
        numbers = np.frombuffer(block, "<u4")
        count += len(numbers)
        decoded.update(decoder.feed(numbers.tolist()).encode())
    decoded.update(decoder.end().encode())
    return count, ids.hexdigest(), decoded.hexdigest()


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256."""
    from pyspark.sql.pandas.types import to_arrow_type

    def make():
        encoder = Encoder(Vocabulary(path))
        return lambda key, words: (key, *round_trip(encoder, words))

    kind = docs.schema[doc_id].dataType
    return each_row(
        docs.select(F.col(doc_id), text_of(text)),
        make,
        f"id {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        [("id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())],
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")
