"""Token ids in binary files: byte planes of fixed-size blocks, each plane compressed, with a chunk index.

Documents are laid out in ranges of their id, one file per range. A file is

    magic, then per block of ``BLOCK`` ids four byte planes (first all lowest
    bytes, then the next, and so on), each compressed with zstandard; then the
    chunk index and the table of documents, compressed; then their sizes, magic.

The chunk index has each block's place and the size of each plane, so that a
reader can begin at any block. Writer and reader hold one block and the table of
the file's documents.

Files go to the shared folder under names no other attempt has; the manifest,
which Spark commits, lists those of the attempts that succeeded, so a lost task
is simply run again. Null text counts as empty: such a document has the end id
alone. A null id stands first. Rows of one id stand in the order of their texts,
so equal rows get places beside each other. No documents, no files.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewatch.durable import shared_folder, stored
from pagewatch.llm.bpe import Encoder, byte_letters, tokenizer_path
from pagewatch.llm.common import text_of

BLOCK = 1 << 16
END_ID = 2
MAGIC = b"IDPLANE1"
LEVEL = 1


class LibraryEncoder(Encoder):
    """Whole words are encoded by the tokenizers library's model, once each; their bytes are spelt as it spells them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        dict.__init__(self)
        library = Tokenizer.from_file(path)
        self.model = library.model
        self.added = {token.content: i for i, token in library.get_added_tokens_decoder().items()}
        self.letters = {byte: letter for letter, byte in byte_letters().items()}

    def _ids(self, word: str) -> bytes:
        spelt = word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        packed = self._ids(word)
        if len(word) < 256:
            self._remember(word, packed)
        return packed

    def long_word(self, parts) -> Iterator[bytes]:
        yield self._ids(b"".join(parts).decode())


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    """One for all tasks that a Python process works off: the file is read once, and words stay remembered."""
    return LibraryEncoder(path)


def planes(ids: np.ndarray) -> list[bytes]:
    """The byte planes of a block of ids."""
    return [np.ascontiguousarray(p).tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def from_planes(parts: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in parts], 1).reshape(-1).view("<u4")


class IdWriter:
    """Writes one file: ``add`` per document, then ``close``."""

    def __init__(self, out, id_type: pa.DataType):
        import zstandard

        self.out, self.id_type = out, id_type
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.held = bytearray()
        self.index: list[tuple[int, ...]] = []
        self.ids: list = []
        self.counts: list[int] = []
        self.place = self.out.write(MAGIC)

    def _block(self, raw: bytes) -> None:
        parts = [self.pack(p) for p in planes(np.frombuffer(raw, "<u4"))]
        self.index.append((self.place, *map(len, parts)))
        for part in parts:
            self.place += self.out.write(part)

    def add(self, doc_id, blocks: Iterator[bytes]) -> None:
        count = 0
        for block in blocks:
            count += len(block) // 4
            self.held += block
            while len(self.held) >= 4 * BLOCK:
                self._block(bytes(self.held[: 4 * BLOCK]))
                del self.held[: 4 * BLOCK]
        self.ids.append(doc_id)
        self.counts.append(count)

    def close(self) -> tuple[int, int]:
        """Numbers of documents and of ids."""
        if self.held:
            self._block(bytes(self.held))
        index = self.pack(np.array(self.index, "<i8").reshape(-1, 5).tobytes())
        sink = io.BytesIO()
        table = pa.table({"id": pa.array(self.ids, self.id_type), "n": pa.array(self.counts, pa.int64())})
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        rows = self.pack(sink.getvalue())
        self.out.write(index)
        self.out.write(rows)
        self.out.write(struct.pack("<qqq", len(index), len(rows), len(self.index)) + MAGIC)
        self.out.close()
        return len(self.ids), sum(self.counts)


class IdReader:
    """Reads one file's documents in order, block by block."""

    def __init__(self, file, size: int):
        import zstandard

        self.file = file
        self.unpack = zstandard.ZstdDecompressor().decompress
        tail = struct.calcsize("<qqq") + len(MAGIC)
        file.seek(size - tail)
        foot = file.read(tail)
        if foot[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a file of ids")
        index, rows, blocks = struct.unpack("<qqq", foot[: -len(MAGIC)])
        file.seek(size - tail - rows - index)
        self.index = np.frombuffer(self.unpack(file.read(index)), "<i8").reshape(blocks, 5)
        self.table = pa.ipc.open_stream(self.unpack(file.read(rows))).read_all()

    def block(self, number: int) -> bytes:
        """The ids of one block, found through the chunk index, as little-endian bytes."""
        place, *sizes = self.index[number].tolist()
        self.file.seek(place)
        return from_planes([self.unpack(self.file.read(n)) for n in sizes]).tobytes()

    def documents(self) -> Iterator[tuple[object, int, Iterator[bytes]]]:
        """Id, number of ids, and the ids in pieces; each document's pieces are to be taken before the next is asked for."""
        number, held, at = 0, b"", 0
        for doc_id, count in zip(self.table["id"].to_pylist(), self.table["n"].to_pylist(), strict=True):
            left = 4 * count

            def take() -> Iterator[bytes]:
                nonlocal number, held, at, left
                while left:
                    if at == len(held):
                        held, at, number = self.block(number), 0, number + 1
                    part = held[at : at + left]
                    at, left = at + len(part), left - len(part)
                    yield part

            pieces = take()
            yield doc_id, count, pieces
            deque(pieces, maxlen=0)  # what the caller has not taken


def file_system(uri: str):
    """The store of a folder that all executors share, and the path in it: any store that pyarrow's file systems open."""
    import pyarrow.fs

    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write every document in ascending order of id; the manifest: shard, path, docs, ids."""
    kind = to_arrow_type(docs.schema[doc_id].dataType)
    layout = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, encoder, name = TaskContext.get().partitionId(), None, None, ""
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for key, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if writer is None:
                        store, root = file_system(folder)
                        store.create_dir(root, recursive=True)
                        name = f"{root}/{shard:08d}-{uuid.uuid4().hex}.ids"
                        writer = IdWriter(store.open_output_stream(name), kind)
                        encoder = library_encoder(path)

                    def blocks(words=words):
                        yield from encoder.blocks(words)
                        yield end

                    writer.add(key, blocks())
        if writer is not None:
            docs_, ids = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, name, docs_, ids), layout, strict=True)], schema=layout)

    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("words"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "words")
    return stored(ordered.mapInArrow(run, "shard bigint, path string, docs bigint, ids bigint"))


def read_ids(manifest: DataFrame, folder: str, id_type) -> DataFrame:
    """Read the files back: id, start, n_tokens, ids_crc32. One task per file."""
    kind = to_arrow_type(id_type)
    layout = pa.schema([("id", kind), ("shard", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = file_system(folder)[0]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), layout, strict=True)], schema=layout)

        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place, rows = 0, []
                with store.open_input_file(path) as file:
                    for key, count, pieces in IdReader(file, file.size()).documents():
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece, crc)
                        rows.append((key, shard, place, count, crc))
                        place += count
                        if len(rows) == 4096:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    # one row per file in both of these: as many as the layout has ranges
    files = max(1, manifest.count())
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    read = manifest.select("shard", "path").repartitionByRange(files, "shard").mapInArrow(
        run, f"id {id_type.simpleString()}, shard bigint, place bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return read.join(F.broadcast(starts), "shard").select("id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_id_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "ids")
    manifest = write_ids(docs, folder, tokenizer_path())
    return read_ids(manifest, folder, docs.schema["doc_id"].dataType).withColumnRenamed("id", "doc_id")
