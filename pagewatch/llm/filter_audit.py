"""Which filter removes what: five filters over whole documents, in every order of them.

Measuring is one pass of a table-driven transducer over the texts' UTF-8 bytes.
``ACTION`` has, per state (between words, in a word) and byte, what the step
does: begin or end a word, count a capital, a symbol or a continuation byte.
The next state follows from the byte alone, so whole blocks of bytes step at
once. Every word's span is inserted into an open-addressing hash table: a slot
names the span that took it, and a word that meets a taken slot is the same word
only if its hash, its document and its bytes are. A document longer than a block
goes block by block, cut between words, and keeps the words it has seen.

A document's failures depend on its text alone but for one filter, that of
copies: a text equal to that of a smaller id anywhere in the table. Texts are
compared by SHA-256, and only the least id of each is shuffled. What is counted
per part is how many documents fail which filters: at most 32 rows a part, from
which all orders follow.

Null text counts as empty: no words, so it fails filter A, and not B (0 < 0 is
false). A null id is larger than all others. Rows that share id and text are rows
of their own, none of them a copy of the other. A document has a label if any of
its label rows has it. Null and empty parts are one part. No documents, no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewatch.durable import stored
from pagewatch.llm.common import BLANKS, text_of

BLOCK_BYTES = 1 << 21
#: Words up to this many bytes are hashed and compared eight bytes a step, longer ones one by one.
STEPPED_BYTES = 64

SYMBOLS = "#$%&*|"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3

BETWEEN, IN_WORD = 0, 1
BEGINS, ENDS, CAPITAL, SYMBOL, CONTINUES = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The next state by byte, and the action by state and byte."""
    after = np.full(256, IN_WORD, np.uint8)
    after[list(BLANKS.encode())] = BETWEEN
    action = np.zeros((2, 256), np.uint8)
    action[BETWEEN, after == IN_WORD] |= BEGINS
    action[IN_WORD, after == BETWEEN] |= ENDS
    action[:, ord("A") : ord("Z") + 1] |= CAPITAL
    action[:, list(SYMBOLS.encode())] |= SYMBOL
    action[:, 0x80:0xC0] |= CONTINUES
    return after, action


AFTER, ACTION = _tables()
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; ``data`` has eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


class Words:
    """Spans of one block of bytes: starts, lengths, and the document of each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray):
        self.data, self.starts, self.lengths, self.owners = data, starts, lengths, owners
        self.eights = _eights(data)

    def bytes_at(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def hashes(self) -> np.ndarray:
        times = np.uint64(0x9E3779B97F4A7C15)
        out = (self.owners.astype(np.uint64) << np.uint64(20)) ^ self.lengths.astype(np.uint64)
        out *= times
        left = np.arange(len(out))
        for at in range(0, STEPPED_BYTES, 8):
            left = left[self.lengths[left] > at]
            if not len(left):
                break
            part = self.eights[self.starts[left] + at] & MASKS[np.minimum(self.lengths[left] - at, 8)]
            mixed = (out[left] ^ part) * times
            out[left] = mixed ^ (mixed >> np.uint64(29))
        for i in np.flatnonzero(self.lengths > STEPPED_BYTES).tolist():
            out[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(self.bytes_at(i), digest_size=8).digest(), "little"))
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words ``a[i]`` and ``b[i]`` are the same word of the same document, by their bytes."""
        alike = (self.owners[a] == self.owners[b]) & (self.lengths[a] == self.lengths[b])
        left = np.flatnonzero(alike)
        for at in range(0, STEPPED_BYTES, 8):
            left = left[self.lengths[a[left]] > at]
            if not len(left):
                break
            mask = MASKS[np.minimum(self.lengths[a[left]] - at, 8)]
            differ = ((self.eights[self.starts[a[left]] + at] ^ self.eights[self.starts[b[left]] + at]) & mask) != 0
            alike[left[differ]] = False
            left = left[~differ]
        for i in left[self.lengths[a[left]] > STEPPED_BYTES].tolist():
            alike[i] = self.bytes_at(int(a[i])) == self.bytes_at(int(b[i]))
        return alike

    def distinct(self) -> np.ndarray:
        """The first found of each different word: insert all spans, verify those that meet."""
        count = len(self.starts)
        hashes = self.hashes()
        size = 1 << max(4, (2 * count).bit_length())
        table = np.full(size, -1, np.int64)
        slots = (hashes >> np.uint64(16)).astype(np.int64) & (size - 1)
        waiting, kept = np.arange(count), []
        while len(waiting):
            at = slots[waiting]
            free = table[at] < 0
            table[at[free]] = waiting[free]
            owner = table[at]
            own = owner == waiting
            kept.append(waiting[own])
            waiting, owner = waiting[~own], owner[~own]
            known = hashes[waiting] == hashes[owner]
            known[known] = self.same(waiting[known], owner[known])
            waiting = waiting[~known]
            slots[waiting] = (slots[waiting] + 1) & (size - 1)
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def transduce(data: np.ndarray, borders: np.ndarray) -> tuple[dict[str, np.ndarray], Words]:
    """Counts per document of a block, and its words. ``data`` is padded; document i lies from borders[i] to borders[i + 1]."""
    n = int(borders[-1])
    text = data[:n]
    state = np.empty(n + 1, np.uint16)
    state[0] = BETWEEN
    state[1:] = AFTER[text]
    last = state[borders[1:]].copy()  # the state in which each document ends
    last[borders[1:] == borders[:-1]] = BETWEEN
    state[borders[:-1]] = BETWEEN
    done = ACTION.reshape(-1)[(state[:-1] << 8) | text]
    found = {flag: np.flatnonzero(done & flag) for flag in (BEGINS, ENDS, CAPITAL, SYMBOL, CONTINUES)}
    ends = np.sort(np.concatenate([found[ENDS], borders[1:][last == IN_WORD]]), kind="stable")
    per = lambda flag: np.diff(np.searchsorted(found[flag], borders))
    words = per(BEGINS)
    counts = {"words": words, "capitals": per(CAPITAL), "symbols": per(SYMBOL), "points": np.diff(borders) - per(CONTINUES)}
    starts = found[BEGINS]
    return counts, Words(data, starts, ends - starts, np.repeat(np.arange(len(words)), words))


def _padded(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 8, np.uint8)
    out[: len(raw)] = raw
    return out


def _long(raw: np.ndarray, block: int) -> tuple[int, ...]:
    """Counts of one document that is longer than a block."""
    totals, seen, at = dict.fromkeys(("words", "capitals", "symbols", "points"), 0), set(), 0
    while at < len(raw):
        end = min(at + block, len(raw))
        while end < len(raw):  # cut after a blank; a word longer than a block stays whole
            blanks = np.flatnonzero(AFTER[raw[at:end]] == BETWEEN)
            if len(blanks):
                end = at + int(blanks[-1]) + 1
                break
            end = min(end + block, len(raw))
        counts, words = transduce(_padded(raw[at:end]), np.array([0, end - at]))
        for name, value in counts.items():
            totals[name] += int(value[0])
        seen.update(map(words.bytes_at, words.distinct().tolist()))
        at = end
    return totals["words"], len(seen), totals["capitals"], totals["points"], totals["symbols"]


def measured_texts(texts: pa.Array, block: int = BLOCK_BYTES) -> Iterator[tuple[int, ...]]:
    """Per text: words, different words, capitals, code points, symbols. Reads the array's own bytes, block by block."""
    texts = texts.cast(pa.large_string())
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + block, "right")) - 1)
        part = raw[borders[at] : borders[to]]
        if len(part) > block:
            yield _long(part, block)
        else:
            counts, words = transduce(_padded(part), borders[at : to + 1] - borders[at])
            different = np.bincount(words.owners[words.distinct()], minlength=to - at)
            rows = (counts["words"], different, counts["capitals"], counts["points"], counts["symbols"])
            yield from zip(*(c.tolist() for c in rows), strict=True)
        at = to


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per row: id, part, n_words, n_distinct, n_capitals, n_points, n_symbols, digest (SHA-256 of the text)."""
    kind = docs.schema[doc_id].dataType
    counted = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
    layout = pa.schema(
        [("id", to_arrow_type(kind)), ("part", pa.string()), *[(c, pa.int64()) for c in counted], ("digest", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            columns = list(zip(*measured_texts(texts), strict=True)) or [[]] * len(counted)
            digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts.cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(layout.field(0).type), batch.column(1).cast(pa.string())]
                + [pa.array(c, pa.int64()) for c in columns]
                + [pa.array(digests, pa.binary())],
                schema=layout,
            )

    rows = docs.select(F.col(doc_id), F.coalesce(F.col(part).cast("string"), F.lit("")), text_of(text))
    fields = ", ".join(f"{c} bigint" for c in counted)
    return rows.mapInArrow(run, f"id {kind.simpleString()}, part string, {fields}, digest binary")


def conditions() -> dict[str, Column]:
    """Letter by letter, what a document fails on, over ``measures`` columns and ``copy``."""
    return {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > MAX_CAPITAL_PERCENT * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
        "E": F.col("copy"),
    }


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``measures`` with ``copy`` and ``fails``: the letters of the filters that the document fails, in order."""
    rows = stored(measures(docs, doc_id, text, part))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    # a text's least id meets its own rows alone, so a text with many copies is no hot key
    first = first.select(F.col("digest").alias("its_digest"), "first", F.lit(False).alias("other"))
    met = rows.join(first, (F.col("digest") == F.col("its_digest")) & F.col("id").eqNullSafe(F.col("first")), "left")
    met = met.withColumn("copy", F.coalesce("other", F.lit(True))).drop("its_digest", "first", "other")
    return met.withColumn("fails", F.concat(*[F.when(c, F.lit(k)).otherwise(F.lit("")) for k, c in conditions().items()]))


def failure_counts(failed: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per part and set of failed filters: documents, those labelled good, those labelled toxic."""
    marks = labels.groupBy(F.col(doc_id).alias("its_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    )
    met = failed.select("id", "part", "fails").join(marks, F.col("id") == F.col("its_id"), "left")
    return met.groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("bad").alias("n_toxic")
    )


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step: what its filter does there."""
    orders = ["".join(p) for p in permutations(letters)]
    steps = F.sequence(F.lit(1), F.lit(len(letters)))
    each = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(steps))
    each = each.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    gone = F.expr("translate(fails, substring(filter_order, 1, step - 1), '') != fails")
    hit = F.expr("instr(fails, letter) > 0")
    total = lambda when, n="n": F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0))
    # of all orders, a document that fails k filters is removed by each of them in one of k
    shares = F.expr(f"n * {len(orders)} div length(fails)")
    return each.withColumns({"gone": gone, "hit": hit, "shares": F.when(hit, shares)}).groupBy("part", "filter_order", "step").agg(
        total(~F.col("gone") & ~F.col("hit")).alias("kept"),
        total(~F.col("gone") & F.col("hit")).alias("removed"),
        total(F.col("gone") & F.col("hit")).alias("redundant"),
        total(F.col("fails") == F.col("letter")).alias("unique_fails"),
        total(~F.col("gone") & F.col("hit"), "n_good").alias("good_lost"),
        total(~F.col("gone") & F.col("hit"), "n_toxic").alias("toxic_lost"),
        F.coalesce(F.sum("shares"), F.lit(0)).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return interactions(failure_counts(failures(docs), labels))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), f AS (
  SELECT doc_id, part,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first OR (doc_id IS NULL AND first IS NOT NULL) THEN 'E' ELSE '' END) AS fails
  FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS n_good, coalesce(sum(bad), 0) AS n_toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM k a JOIN k b ON b.x <> a.x JOIN k c ON c.x NOT IN (a.x, b.x) JOIN k d ON d.x NOT IN (a.x, b.x, c.x)
    JOIN k e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, letter, n, n_good, n_toxic, fails, contains(fails, letter) AS hit,
    translate(fails, before, '') <> fails AS gone
  FROM c, s
), g AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN n_good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND hit THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM g
"""
