"""Packing documents into sequences of a fixed length: linear grouping, few-size configurations, best fit.

A document is its ids and the end id. One longer than a sequence is cut into
whole sequences from its end, so that its first piece alone may be shorter; each
whole piece is a sequence of its own. What is packed is one length per document,
between 1 and the capacity, so all there is to plan is how many documents have
each length: the driver gets that histogram, at most ``CAPACITY`` rows whatever
the corpus, and everything it computes depends on the histogram's rows and not
on the documents.

* Linear grouping. Lengths over a half, third or fifth of the capacity, largest
  first, are dealt into groups of equally many documents, and each is rounded up
  to its group's largest.
* Configurations. The sequences of fewest number that hold the rounded lengths
  are found as a linear program over all ways to fill one sequence, by column
  generation; its whole parts are used.
* Substitution. Each place of a configuration takes documents of its group in
  order of length. Sequences with the same lengths in the same places are a run.
* Best fit. Short documents and those that the whole parts leave over go, longest
  first, to the fullest sequence they fit into, a run at a time, which gives the
  same as one document at a time.

Several numbers of groups and thresholds are tried, and the plan with the fewest
sequences is taken. A document's place follows from its rank among those of its
length: ranks come from a range layout, so a length that a third of all documents
have is no hot key.

Null text counts as empty: the end id alone. Rows of one id, and equal rows, are
documents of their own; a null id stands first among its length. An empty table
gives no pieces. Texts of any length are whole; a task holds one document's ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewatch.durable import stored
from pagewatch.llm.bpe import tokenizer_path
from pagewatch.llm.common import each_row, text_of
from pagewatch.llm.words import WordEncoder
from pagewatch.operators.ordering import sorted_ranges, with_position, with_rank

CAPACITY = 1024
END_ID = 2
#: Numbers of groups, and shares of the capacity above which a length is large, that are tried.
GROUPS = (64, 128)
LARGE = (2, 3, 5)
#: Rounds of column generation at most; fewer than the best configurations cost a few sequences, never a document.
COLUMNS = 3000
#: A document's pieces are numbered below this in the numbers of whole sequences.
PIECE_BITS = 24


def pieces_of(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    value: Callable[[bytes], object] = bytes,
    value_type: str = "binary",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: id, n_tokens, and ``value`` of each piece's ids (little-endian unsigned 32-bit; the ids themselves by default)."""
    kind = docs.schema[doc_id].dataType
    arrow = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[value_type]
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encoder = WordEncoder(path)

        def of(key, words):
            ids = b"".join([*encoder.blocks(words), end])
            first = (len(ids) // 4 - 1) % capacity + 1
            cuts = [0, *range(4 * first, len(ids) + 1, 4 * capacity)]
            return key, len(ids) // 4, [value(ids[a:b]) for a, b in zip(cuts, cuts[1:])]

        return of

    return each_row(
        docs.select(F.col(doc_id), text_of(text)),
        make,
        f"id {kind.simpleString()}, n_tokens bigint, pieces array<{value_type}>",
        [("id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("pieces", pa.list_(arrow))],
    )


# --- the plan, from the histogram alone -----------------------------------------------------------------


def grouped(sizes: list[tuple[int, int]], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping of (size, count), largest first: per group its rounded size and its own (size, count)."""
    total = sum(n for _, n in sizes)
    each = -(-total // groups) if total else 1
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for size, count in sizes:
        while count:
            if not room:
                if out and out[-1][0] == size:
                    room = each  # a length that fills several groups stays one
                else:
                    out.append((size, []))
                    room = each
            take = min(room, count)
            held = out[-1][1]
            if held and held[-1][0] == size:
                held[-1] = (size, held[-1][1] + take)
            else:
                held.append((size, take))
            room, count = room - take, count - take
    return out


def _best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable way to fill one sequence with any number of each size."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for j, (size, value) in enumerate(zip(sizes, worth.tolist(), strict=True)):
        if value <= 0:
            continue
        for _ in range(capacity // size):
            more = best[:-size] + value
            better = more > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better] = more[better]
            last[size:][better] = j
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        j = last[room]
        if j < 0:
            break
        pattern[j] += 1
        room -= sizes[j]
    return float(pattern @ worth), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, columns: int = COLUMNS) -> list[tuple[list[int], int]]:
    """Patterns and how often each is used, whole parts of the linear program's solution."""
    m = len(sizes)
    if not m:
        return []
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(columns):
        worth = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = _best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-9:
            break
        used, way = np.linalg.solve(basis, np.stack([need, pattern], 1)).T
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, np.maximum(used, 0) / way, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
    used = np.linalg.solve(basis, need)
    return [(basis[:, i].astype(int).tolist(), int(u + 1e-6)) for i, u in enumerate(used.tolist()) if u >= 1 - 1e-6]


class Sequences:
    """Runs of sequences that are alike, and where documents of each length are put, by rank within the length."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity = capacity
        self.left = dict(counts)
        self.rank = dict.fromkeys(counts, 0)
        self.count = 0
        #: size, first rank, first sequence, how many in each sequence, where the first of them begins
        self.placed: list[tuple[int, int, int, int, int]] = []
        #: by room left: (first sequence, how many)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def place(self, size: int, count: int, first: int, each: int, offset: int) -> None:
        self.placed.append((size, self.rank[size], first, each, offset))
        self.rank[size] += count
        self.left[size] -= count

    def configured(self, pattern: list[int], times: int, queues: list[list[list[int]]]) -> None:
        """``times`` sequences of one pattern, each place filled from its group's documents in order."""
        places = [queues[j] for j, n in enumerate(pattern) for _ in range(n)]
        taken = []
        for queue in places:
            parts, want = [], times
            while want and queue:
                size, n = queue[0]
                now = min(n, want)
                parts.append((size, now))
                want -= now
                queue[0][1] -= now
                if not queue[0][1]:
                    queue.pop(0)
            if want:
                parts.append((0, want))  # fewer documents than places: the rest stays free
            taken.append(parts)
        at, done = [[0, 0] for _ in taken], 0
        while done < times:
            run = min(parts[i][1] - k for parts, (i, k) in zip(taken, at, strict=True))
            offset = 0
            for parts, place in zip(taken, at, strict=True):
                size = parts[place[0]][0]
                if size:
                    self.place(size, run, self.count, 1, offset)
                offset += size
                place[1] += run
                if place[1] == parts[place[0]][1]:
                    place[0], place[1] = place[0] + 1, 0
            if offset:
                self.runs.setdefault(self.capacity - offset, []).append((self.count, run))
                self.count += run
            done += run

    def best_fit(self) -> None:
        """What is left over, longest first, each into the fullest sequence that has room, else into a new one."""
        rooms = sorted(self.runs)
        for size in sorted(self.left, reverse=True):
            while self.left[size]:
                i = bisect_left(rooms, size)
                if i == len(rooms):
                    each = self.capacity // size
                    new = -(-self.left[size] // each)
                    first, count = self.count, new
                    room = self.capacity
                    self.count += new
                else:
                    room = rooms[i]
                    first, count = self.runs[room].pop()
                    if not self.runs[room]:
                        del self.runs[room]
                        rooms.pop(i)
                    each = room // size
                whole = min(count, self.left[size] // each)
                offset = self.capacity - room
                if whole:
                    self.place(size, whole * each, first, each, offset)
                    self._room(rooms, room - each * size, first, whole)
                some = min(self.left[size], each) if whole < count else 0
                if some:
                    self.place(size, some, first + whole, each, offset)
                    self._room(rooms, room - some * size, first + whole, 1)
                self._room(rooms, room, first + whole + bool(some), count - whole - bool(some))

    def _room(self, rooms: list[int], room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.runs:
                rooms.insert(bisect_left(rooms, room), room)
            self.runs.setdefault(room, []).append((first, count))


def _plan(counts: dict[int, int], capacity: int, groups: int, large: int) -> Sequences:
    out = Sequences(capacity, counts)
    sizes = [(s, counts[s]) for s in sorted(counts, reverse=True) if s * large > capacity]
    classes = grouped(sizes, groups)
    queues = [[list(part) for part in own] for _, own in classes]
    for pattern, times in configurations([s for s, _ in classes], [sum(n for _, n in own) for _, own in classes], capacity):
        out.configured(pattern, times, queues)
    out.best_fit()
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, large: tuple[int, ...] = LARGE) -> Sequences:
    """Where every document of each length goes, by its rank (from 0) within the length."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    return min((_plan(counts, capacity, g, share) for g in groups for share in large), key=lambda p: p.count)


# --- documents into their places ----------------------------------------------------------------------


def _first_length(n: Column, capacity: int) -> Column:
    return (n - 1) % capacity + 1


def _placed(ranked: DataFrame, found: Sequences) -> DataFrame:
    """``sequence`` and ``place`` from ``length`` and ``rank`` (from 1): one look into the plan's table a batch."""
    table = np.array(sorted(found.placed), np.int64).reshape(-1, 5)
    # rows of the table in order of (size, first rank); a document's row is the last that is not behind it
    order = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64) - 1
            row = table[np.searchsorted(order, size << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence, place = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * size
            yield batch.append_column("sequence", pa.array(sequence)).append_column("place", pa.array(place))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence bigint, place bigint")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, piece, start, length, value, sequence_id, offset. ``pieces`` as ``pieces_of`` gives them.

    Sequences that hold several documents are numbered from 0, whole pieces have
    negative numbers, from their document's place in the layout and their own.
    """
    rows = stored(pieces.withColumn("length", _first_length(F.col("n_tokens"), capacity)).withColumn("row", F.monotonically_increasing_id()))
    # at most one row per length
    found = plan({r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    layout = sorted_ranges(rows, ["length"], ["id", "row"], cheap=True)
    ranked = with_rank(with_position(layout, "number"), ["length"]).select("id", "n_tokens", "pieces", "length", "rank", "number")
    each = _placed(ranked, found).select("*", F.posexplode("pieces").alias("piece", "value"))
    first = F.col("piece") == 0
    whole = -(F.col("number") * (1 << PIECE_BITS) + F.col("piece")) - 1
    return each.select(
        "id",
        "piece",
        F.when(first, F.lit(0).cast("long")).otherwise(F.col("length") + (F.col("piece") - 1) * F.lit(capacity)).alias("start"),
        F.when(first, F.col("length")).otherwise(F.lit(capacity).cast("long")).alias("length"),
        "value",
        F.when(first, F.col("sequence")).otherwise(whole).alias("sequence_id"),
        F.when(first, F.col("place")).otherwise(F.lit(0).cast("long")).alias("offset"),
    )


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (packed like the pieces' values), at most ``CAPACITY`` pieces each."""
    held = F.sort_array(F.collect_list(F.struct("offset", "value")))
    return packed_pieces.groupBy("sequence_id").agg(F.aggregate(F.transform(held, lambda p: p["value"]), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = packed(pieces_of(docs, tokenizer_path(), value=zlib.crc32, value_type="bigint"))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("value").alias("ids_crc32"), "sequence_id", "offset")
