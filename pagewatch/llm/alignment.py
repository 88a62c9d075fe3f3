"""Alignment of two tokenizers over the same bytes, and which of their ids go together corpus-wide.

Both tokenizers cut the same bytes: a space and the text. Offsets where tokens of
both end cut them into groups, and every token of A is linked with every token of
B in its group. Common offsets are found by galloping: the shorter list of ends
drives, and each of its ends is looked up in the longer list from where the last
one was found, by steps that double and a binary search in the last step. The
longer list is walked in many lanes at once, each with a finger of its own.
Common ends slice the groups, and differences of their ranks are the groups' sizes.

How many documents hold an id pair is counted over all documents. Documents are
taken in chunks; a chunk lists its different pairs once, with the number of its
documents that hold each, and only those lists are shuffled: pairs are counted by
(pair), the counts go back to the chunks that have the pair, and each chunk works
out its documents' sums from them. A pair that nearly all documents hold is one
row per chunk. A chunk is bounded by its links (``CHUNK_LINKS``) or is one document.

Null and empty texts, and those whose joined token bytes of A or of B are not the
space and the text (A's are; B's are not where the text has U+2581), have no
tokens: all counts are 0 and the groups are empty. A row is a document: rows of
one id, equal rows and null ids count as documents of their own. Long documents
are aligned window by window, each ending at a common offset; no text is cut
short. No documents, no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewatch.durable import stored
from pagewatch.llm.bpe import BLOCK_CHARS, REMEMBERED, tokenizer_path
from pagewatch.llm.common import text_of
from pagewatch.llm.words import WordEncoder

#: A chunk ends with the document that brings it to so many links.
CHUNK_LINKS = 1 << 18
#: Tokens aligned in one go; a longer document goes in windows of about so many.
WINDOW = 1 << 17
LANES = 2048
#: Groups with more links than this are counted by their different ids.
WIDE = 1 << 12
#: In packed ids: the word behind it does not join to its own bytes.
DIFFERS = 0xFFFFFFFF


class ByteTokens(WordEncoder):
    """Tokenizer A. Strings of special tokens are plain text; ``lengths`` are the tokens' bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.added = {}
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)


class PieceTokens(dict):
    """Tokenizer B, a sentencepiece model. As a mapping it gives a segment's packed ids.

    A character that no piece of several characters has is a token by itself, and
    no piece has a space mark behind another character, nor a letter beside a
    character that is neither. So the model's result is the same for segments cut
    at those places, and a segment is encoded once. A model whose pieces are not
    like that takes larger segments, or texts whole.
    """

    MARK = "▁"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(self.MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        normal = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        merged = {c for p in normal if len(p) > 1 for c in p} - {self.MARK}
        self.alone = next(c for c in "\n\t\x0b\x0c\r\x01\x02" if c not in merged)
        self.before = len(self.model.encode(self.alone))
        self.cut = None
        if not any(re.search(f"[^{self.MARK}]{self.MARK}", p) for p in normal):
            apart = not any(x.isalpha() != y.isalpha() and self.MARK not in (x, y) for p in normal for x, y in zip(p, p[1:]))
            kinds = [{c for c in merged if c.isalpha()}, {c for c in merged if not c.isalpha()}] if apart else [merged]
            joins = ["".join(map(re.escape, sorted(kind))) for kind in kinds if kind]
            marks = f" {self.MARK}"
            runs = "".join(f"[{marks}]*[{j}]+|" for j in joins)
            self.cut = re.compile(f"{runs}[{marks}]+|[^{''.join(joins)}{marks}]")

    def learn(self, segments: list[str]) -> None:
        """Encode segments in one call, each after a character that stands alone, so that no space is put before it."""
        for segment, ids in zip(segments, self.model.encode([self.alone + s for s in segments], num_threads=1), strict=True):
            ids = ids[self.before :]
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if b"".join(map(self.bytes_of.__getitem__, ids)) != segment.encode():
                packed = struct.pack("<I", DIFFERS) + packed
            self[segment] = packed

    def blocks(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text that begins with a space."""
        if self.cut is None:
            ids = self.model.encode(text[1:])
            joined = b"".join(map(self.bytes_of.__getitem__, ids))
            yield struct.pack("<I", DIFFERS) * (joined != text.encode()) + struct.pack(f"<{len(ids)}I", *ids)
            return
        at, size = 0, BLOCK_CHARS
        while at < len(text):
            segments = self.cut.findall(text[at : at + size])
            if at + size < len(text):  # the last segment may go on
                if len(segments) == 1:
                    size *= 2
                    continue
                segments.pop()
            if len(self) >= REMEMBERED:
                self.clear()
            if new := [s for s in set(segments) if s not in self]:
                self.learn(new)
            yield b"".join(map(self.__getitem__, segments))
            at, size = at + sum(map(len, segments)), BLOCK_CHARS


def gallop(short: np.ndarray, long: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Per element of ``short`` the place of the first in ``long`` that is not smaller; both ascend.

    Lanes are stretches of ``short`` that are walked side by side, from finger to finger.
    """
    n = len(short)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.append(long, np.iinfo(np.int64).max)
    deep = -(-n // lanes)
    targets = np.append(short, np.full(-n % deep, short[-1], short.dtype)).reshape(-1, deep).T
    out = np.empty(targets.shape, np.int64)
    low = np.zeros(targets.shape[1], np.int64)
    for k, target in enumerate(targets):
        high, width = low.copy(), 1
        behind = np.flatnonzero(ends[high] < target)
        while len(behind):
            low[behind] = high[behind] + 1
            high[behind] = np.minimum(high[behind] + width, len(long))
            width *= 2
            behind = behind[ends[high[behind]] < target[behind]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = ends[middle] < target[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        out[k] = low
    return out.T.reshape(-1)[:n]


def common(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both lists of the ends that both have. The shorter list drives."""
    if len(a_ends) > len(b_ends):
        b, a = common(b_ends, a_ends)
        return a, b
    places = gallop(a_ends, b_ends)
    met = np.append(b_ends, -1)[places] == a_ends
    return np.flatnonzero(met), places[met]


class Aligner:
    """Aligns stretches of documents; collects per document counts, groups and links."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        count_a, count_b = len(a.lengths), len(b.lengths)
        texts = [f"{i}{end}" for end in ",|" for i in range(count_a)] + [f"{i}{end}" for end in ",;" for i in range(count_b)]
        self.cell_sizes = np.array([len(t) for t in texts], np.int64)
        self.cells = np.array(texts, "S").view(np.uint8).reshape(len(texts), -1)

    def ids_of(self, encoder, text: str) -> tuple[Iterator[np.ndarray], list[bool]]:
        """A text's ids in blocks, and whether some word was seen not to join to its own bytes."""
        differs = [False]

        def blocks():
            for block in encoder.blocks(text):
                ids = np.frombuffer(block, "<u4")
                odd = ids == DIFFERS
                if odd.any():
                    differs[0] = True
                    ids = ids[~odd]
                yield ids.astype(np.int64)

        return blocks(), differs

    def stretches(self, text: str, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers for stretches of one document that end at common offsets; None if bytes differ."""
        text = f" {text}"
        (more_a, odd_a), (more_b, odd_b) = self.ids_of(self.a, text), self.ids_of(self.b, text)
        held_a = held_b = np.zeros(0, np.int64)
        size_a = size_b = 0
        least = window
        while True:
            block = next(more_a, None) if size_a <= size_b else next(more_b, None)
            if block is None:
                break
            if size_a <= size_b:
                held_a, size_a = np.append(held_a, block), size_a + int(self.a.lengths[block].sum())
            else:
                held_b, size_b = np.append(held_b, block), size_b + int(self.b.lengths[block].sum())
            if min(len(held_a), len(held_b)) >= least and not odd_a[0] and not odd_b[0]:
                at_a, at_b = common(np.cumsum(self.a.lengths[held_a]), np.cumsum(self.b.lengths[held_b]))
                if not len(at_a):
                    least *= 2
                    continue
                cut_a, cut_b = int(at_a[-1]) + 1, int(at_b[-1]) + 1
                cut = int(self.a.lengths[held_a[:cut_a]].sum())
                yield held_a[:cut_a], held_b[:cut_b]
                held_a, held_b, size_a, size_b, least = held_a[cut_a:], held_b[cut_b:], size_a - cut, size_b - cut, window
        held_a, held_b = np.concatenate([held_a, *more_a]), np.concatenate([held_b, *more_b])
        if odd_a[0] or odd_b[0]:
            raw = text.encode()
            for encoder in (self.a, self.b):
                ids = np.concatenate(list(self.ids_of(encoder, text)[0]))
                if b"".join(map(encoder.bytes_of.__getitem__, ids.tolist())) != raw:
                    yield None
                    return
        if len(held_a):
            yield held_a, held_b

    def align(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Per stretch n_a, n_b, n_groups, n_links and the groups' text; of all links the stretch, the pair and how often."""
        n_a, n_b = (np.array([len(p[k]) for p in parts]) for k in (0, 1))
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        # the shorter list of each stretch drives
        drives = n_a <= n_b
        in_a, in_b = np.repeat(drives, n_a), np.repeat(drives, n_b)
        at_a, at_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pick_a, pick_b in ((in_a, in_b), (~in_a, ~in_b)):
            own_a, own_b = np.flatnonzero(pick_a), np.flatnonzero(pick_b)
            got_a, got_b = common(a_ends[own_a], b_ends[own_b])
            at_a, at_b = np.append(at_a, own_a[got_a]), np.append(at_b, own_b[got_b])
        order = np.argsort(at_a, kind="stable")
        at_a, at_b = at_a[order], at_b[order]
        first_a, first_b = np.append(0, at_a[:-1] + 1), np.append(0, at_b[:-1] + 1)
        size_a, size_b = at_a + 1 - first_a, at_b + 1 - first_b
        stretch = np.searchsorted(np.cumsum(n_a), at_a, "right")
        groups = np.bincount(stretch, minlength=len(parts))
        links = np.bincount(stretch, weights=size_a * size_b, minlength=len(parts)).astype(np.int64)
        counts = np.stack([n_a, n_b, groups, links], 1)
        texts = self.texts(a, b, at_a, at_b, size_a, size_b, n_a + n_b)
        return counts, texts, *self.pairs(a, b, first_a, first_b, size_a, size_b, stretch)

    def texts(self, a, b, at_a, at_b, size_a, size_b, tokens) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every stretch."""
        count_a, count_b = len(self.a.lengths), len(self.b.lengths)
        code_a, code_b = a.copy(), b + 2 * count_a
        code_a[at_a] += count_a
        code_b[at_b] += count_b
        # a group's tokens of A stand behind the tokens of B before the group, those of B behind its own of A
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(at_b + 1 - size_b, size_a)] = code_a
        codes[np.arange(len(b)) + np.repeat(at_a + 1, size_b)] = code_b
        sizes = self.cell_sizes[codes]
        cells = self.cells[codes]
        raw = cells[np.arange(cells.shape[1]) < sizes[:, None]].tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(tokens))].tolist()
        return [raw[x : y - 1] for x, y in zip(ends, ends[1:])]

    @staticmethod
    def pairs(a, b, first_a, first_b, size_a, size_b, stretch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        product = size_a * size_b
        wide = product > WIDE
        few = np.flatnonzero(~wide)
        total = product[few]
        within = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        across = np.repeat(size_b[few], total)
        left = a[np.repeat(first_a[few], total) + within // across]
        right = b[np.repeat(first_b[few], total) + within % across]
        owners, pairs, times = [np.repeat(stretch[few], total)], [left << 32 | right], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            ids_a, much_a = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            ids_b, much_b = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            pairs.append((ids_a[:, None] << 32 | ids_b).reshape(-1))
            times.append((much_a[:, None] * much_b).reshape(-1))
            owners.append(np.full(len(pairs[-1]), stretch[g]))
        return np.concatenate(owners), np.concatenate(pairs), np.concatenate(times)


class Chunk:
    """Documents until they have ``CHUNK_LINKS`` links: counts, groups, and links as (document, pair, times)."""

    def __init__(self, aligner: Aligner, value: Callable[[bytes], object]):
        self.aligner, self.value = aligner, value
        self.ids: list = []
        self.totals: list[np.ndarray] = []
        self.texts: list[list[bytes]] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.links = 0
        self.waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc_id, text: str) -> None:
        number = len(self.ids)
        self.ids.append(doc_id)
        self.totals.append(np.zeros(4, np.int64))
        self.texts.append([])
        for part in self.aligner.stretches(text) if text else ():
            if part is None:
                self.align()
                self.totals[number], self.texts[number] = np.zeros(4, np.int64), []
                self.held = [tuple(x[own != number] for x in (own, *rest)) for own, *rest in self.held]
                break
            self.waiting.append((number, *part))
            self.tokens += len(part[0])
            if self.tokens >= WINDOW:
                self.align()

    def align(self) -> None:
        if not self.waiting:
            return
        numbers = np.array([w[0] for w in self.waiting])
        counts, texts, owners, pairs, times = self.aligner.align([w[1:] for w in self.waiting])
        for number, count, text in zip(numbers.tolist(), counts, texts, strict=True):
            self.totals[number] += count
            self.texts[number].append(text)
        self.links += int(counts[:, 3].sum())
        self.held.append((numbers[owners], pairs, times))
        if len(self.held) > 16:
            self.held = [self.merged()]
        self.waiting, self.tokens = [], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links summed by document and pair, in that order."""
        if not self.held:
            return (np.zeros(0, np.int64),) * 3
        owners, pairs, times = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((pairs, owners))
        owners, pairs, times = owners[order], pairs[order], times[order]
        new = np.flatnonzero(np.append(True, (owners[1:] != owners[:-1]) | (pairs[1:] != pairs[:-1]))) if len(owners) else np.zeros(0, np.int64)
        return owners[new], pairs[new], np.add.reduceat(times, new) if len(new) else times

    def row(self, number: int, id_type: pa.DataType, value_type: pa.DataType) -> tuple[int, list, list, bytes]:
        """The chunk's number, its different pairs, how many of its documents hold each, and the documents as an Arrow stream."""
        self.align()
        owners, pairs, times = self.merged()
        different, codes = np.unique(pairs, return_inverse=True)
        starts = np.searchsorted(owners, np.arange(len(self.ids) + 1)).astype(np.int32)
        totals = np.array(self.totals).reshape(-1, 4)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(starts), pa.array(x))
        table = pa.table(
            {
                "id": pa.array(self.ids, id_type),
                **{n: pa.array(totals[:, k]) for k, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                "groups": pa.array([self.value(b";".join(t)) if t else None for t in self.texts], value_type),
                "codes": lists(codes.astype(np.int32)),
                "times": lists(times),
            }
        )
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        return number, different, np.bincount(codes, minlength=len(different)), sink.getvalue()


def chunks(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    value: Callable[[bytes], object],
    value_type: str,
    chunk_links: int,
    doc_id: str,
    text: str,
) -> DataFrame:
    """One row per chunk: chunk, pairs, holds, body."""
    kind, made = to_arrow_type(docs.schema[doc_id].dataType), {"binary": pa.binary(), "string": pa.string()}[value_type]
    layout = pa.schema([("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("holds", pa.list_(pa.int64())), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, aligner, chunk = TaskContext.get().partitionId() << 33, None, None

        def out() -> pa.RecordBatch:
            cells = chunk.row(number, kind, made)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(cells, layout, strict=True)], schema=layout)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for key, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    aligner = aligner or Aligner(ByteTokens(path_a), PieceTokens(path_b))
                    chunk = chunk or Chunk(aligner, value)
                    chunk.add(key, words)
                    if chunk.links + chunk.tokens >= chunk_links:
                        yield out()
                        number, chunk = number + 1, None
        if chunk:
            yield out()

    rows = docs.select(F.col(doc_id), text_of(text))
    return rows.mapInArrow(run, "chunk bigint, pairs array<bigint>, holds array<bigint>, body binary")


def pair_counts(parts: DataFrame) -> DataFrame:
    """``pair, n, best``: how many documents hold a pair, and whether no pair of its A id is held by more."""
    each = parts.select(F.explode(F.arrays_zip("pairs", "holds")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holds").alias("n"))
    counts = stored(each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32).cast("int")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    value: Callable[[bytes], object] = bytes.decode,
    value_type: str = "string",
    chunk_links: int = CHUNK_LINKS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``value`` of the groups' text, by default the text)."""
    id_field = docs.schema[doc_id].dataType
    parts = stored(chunks(docs, path_a, path_b, value, value_type, chunk_links, doc_id, text))
    asked = parts.select(F.col("chunk").alias("asked_by"), F.posexplode("pairs").alias("code", "pair"))
    told = asked.join(pair_counts(parts), "pair").select("asked_by", "code", "n", "best")
    counted = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    layout = pa.schema(
        [("id", to_arrow_type(id_field)), *[(c, pa.int64()) for c in counted], ("groups", {"binary": pa.binary(), "string": pa.string()}[value_type])]
    )

    def sums(own: pa.Table, told_: pa.Table) -> pa.Table:
        docs_ = pa.ipc.open_stream(own["body"][0].as_buffer()).read_all().combine_chunks()
        held = np.zeros((told_.num_rows, 2), np.int64)
        held[told_["code"].to_numpy()] = np.stack([told_["n"].to_numpy(), told_["best"].to_numpy().astype(np.int64)], 1)
        codes, times = docs_["codes"].combine_chunks(), docs_["times"].combine_chunks()
        weighed = held[codes.values.to_numpy()] * times.values.to_numpy()[:, None]
        until = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(weighed, 0)])
        starts = codes.offsets.to_numpy()
        totals = until[starts[1:]] - until[starts[:-1]]
        columns = [docs_[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        columns += [pa.array(totals[:, 1]), pa.array(totals[:, 0]), docs_["groups"]]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, layout, strict=True)], schema=layout)

    fields = ", ".join(f"{c} bigint" for c in counted)
    return (
        parts.select("chunk", "body")
        .groupBy("chunk")
        .cogroup(told.groupBy("asked_by"))
        .applyInArrow(sums, f"id {id_field.simpleString()}, {fields}, groups {value_type}")
    )


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = aligned(
        docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), value=lambda groups: hashlib.sha256(groups).hexdigest()
    )
    counted = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return found.select(F.col("id").alias("doc_id"), *counted, F.coalesce("groups", F.lit("")).alias("groups_sha256"))
