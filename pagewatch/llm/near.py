"""Near copies by word shingles: sets of five words whose Jaccard similarity is 0.8 or more.

Candidates come from min-hashes: 48 lists of six each, so a pair at similarity
0.8 meets in none of them with probability (1 - 0.8^6)^48, or 5 in 10 million,
and less above. Every candidate is verified by the exact similarity of its two
sets of 64-bit shingle hashes; no other pair is linked.

Texts of equal sets form one class first. Lists are worked off in rounds. In a
round each open list (one that holds several components) names one leader, which
alone is compared with the whole list: as many pairs as entries. Leaders are the
members that meet most others, in turn of the list's largest component and of
the others. What is linked by then is one component and needs no more pairs. At
last every pair that is still open is looked at, however many those are, so no
link is lost. A round that links nothing leaves components and lists as they were,
and neither is worked out again; after two such rounds, one of each kind, the pairs
still open are looked at.

Two sets of a and b shingles are similar enough only if they differ in at most
(a + b) (1 - s) / (1 + s) shingles. A sketch of 1 024 bits has, per bit, whether an
odd number of the set's shingles fall on it; two sketches differ in no more bits
than the sets in shingles. Pairs whose sketches differ in too many bits are
dropped inside the join that finds them, so what comes out of it, is shuffled
and verified are links and a few pairs close below the limit.

Null text counts as empty, and texts without words are copies of each other; one
with fewer words than a shingle is one shingle. Repeated rows and equal texts are
one class. Of a component the smallest id stays, of rows of that id the one with
the smallest text hash; a null id never names a component unless there is no
other id. Texts of any length are whole; a task holds one text's shingles. An
empty table gives none.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.durable import stored
from pagewatch.llm.common import each_row, text_of
from pagewatch.llm.graph import components
from pagewatch.llm.simhash import rows_kept

SHINGLE_WORDS = 5
SIMILARITY = 0.8
LISTS = 48
HASHES = 6
#: Bits of a sketch, in numbers of 64.
WORDS = 16
#: Rounds of leaders before all pairs left are looked at; fewer if those are no more than ``EACH`` an entry.
ROUNDS = 4
EACH = 1


def shingles_of(shingle_words: int = SHINGLE_WORDS):
    """The row function: text to the sorted array of its distinct shingles' hashes."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    step, mix, mix2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

    def of(text: str | None):
        # bytes.lower and bytes.split know ASCII letters and white space alone
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        hashes = np.fromiter(map(digest, words), np.uint64, len(words))
        long_ = min(shingle_words, len(words))
        n = len(words) - long_ + 1 if words else 0
        out = np.zeros(n, np.uint64)
        for i in range(long_):
            out = out * step + hashes[i : i + n]
        out = (out ^ (out >> np.uint64(30))) * mix
        out = (out ^ (out >> np.uint64(27))) * mix2
        return np.unique(out ^ (out >> np.uint64(31)))

    return of


def lists_of(lists: int = LISTS, hashes: int = HASHES):
    """The row function: shingle hashes to the keys of the lists their text stands in."""
    import numpy as np

    rng = np.random.default_rng(42)
    flips = rng.integers(0, 1 << 63, lists * hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    times = rng.integers(0, 1 << 63, lists * hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    step = np.uint64(0x9E3779B97F4A7C15)

    def of(shingles) -> list[int]:
        if not len(shingles):
            return []
        least = np.full(lists * hashes, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 256):
            least = np.minimum(least, ((shingles[at : at + 256, None] ^ flips) * times).min(axis=0))
        keys = np.arange(1, lists + 1, dtype=np.uint64)
        for column in least.reshape(lists, hashes).T:
            keys = (keys * step) ^ column
            keys ^= keys >> np.uint64(29)
        return keys.view(np.int64).tolist()

    return of


def node_of(shingles) -> int:
    """A signed 64-bit hash of a set."""
    import xxhash

    value = xxhash.xxh64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def sketch_of(shingles, words: int = WORDS) -> list[int]:
    """Per bit whether an odd number of shingles fall on it, as signed 64-bit numbers."""
    import numpy as np

    odd = np.bincount((shingles >> np.uint64(5)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def signatures(docs: DataFrame, doc_id: str, text: str, shingle_words: int) -> DataFrame:
    """``id, mark, node, size, keys, sketch`` for every row; mark tells rows of one id apart, node is the class of equal sets."""
    from pyspark.sql.pandas.types import to_arrow_type

    def make():
        shingles, keys = shingles_of(shingle_words), lists_of()

        def of(key, mark, words):
            found = shingles(words)
            return key, mark, node_of(found), len(found), keys(found), sketch_of(found)

        return of

    kind, numbers = docs.schema[doc_id].dataType, pa.list_(pa.int64())
    return each_row(
        docs.select(F.col(doc_id), F.xxhash64(text_of(text)), F.col(text)),
        make,
        f"id {kind.simpleString()}, mark bigint, node bigint, size bigint, keys array<bigint>, sketch array<bigint>",
        [("id", to_arrow_type(kind)), ("mark", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("keys", numbers), ("sketch", numbers)],
    )


def _sets(docs: DataFrame, text: str, marks: DataFrame, shingle_words: int) -> DataFrame:
    """``node, shingles`` for each text whose mark is in ``marks``."""
    texts = docs.select(F.xxhash64(text_of(text)).alias("mark"), F.col(text).alias("text")).join(marks, "mark", "left_semi")

    def make():
        shingles = shingles_of(shingle_words)

        def of(words):
            found = shingles(words)
            return node_of(found), found.view("int64")

        return of

    sets = each_row(
        texts.select("text"), make, "node bigint, shingles array<bigint>", [("node", pa.int64()), ("shingles", pa.list_(pa.int64()))]
    )
    return sets.dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    # a quotient of two whole numbers is 0.8 exactly when it is the double 0.8
    return pairs.join(left, "u").join(right, "v").filter(both / (F.size("a") + F.size("b") - both) >= similarity).select("u", "v")


def _sketch_columns() -> list[str]:
    return [f"s{i}" for i in range(WORDS)]


def _may_link(similarity: float) -> Column:
    """Whether sizes and sketches of an entry and another (its columns end in _u) allow the similarity."""
    alike = F.least("size", "size_u") >= similarity * F.greatest("size", "size_u") - 1e-6
    bits = reduce(lambda a, b: a + b, [F.bit_count(F.col(s).bitwiseXOR(F.col(f"{s}_u"))) for s in _sketch_columns()])
    return alike & (bits <= (F.col("size") + F.col("size_u")) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _open_lists(placed: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Components of open lists (key, root, n, leader, main): main is the root of the list's largest. Pairs and entries there."""
    parts = stored(placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.max(F.struct("weight", "node")).alias("leader")))
    lists = parts.groupBy("key").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count("*").alias("parts"), F.max(F.struct("n", "leader", "root")).alias("main")
    )
    lists = stored(lists.filter("parts > 1").select("key", F.col("main.root").alias("main"), "all", "within"))
    pairs, entries = lists.agg(F.sum((F.col("all") * F.col("all") - F.col("within")) / 2), F.sum("all")).first()
    return parts, lists.select("key", "main"), pairs or 0, entries or 0


def links(met: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS, each: int = EACH) -> DataFrame:
    """``node, root`` over all links between nodes that meet (met: key, node, size, weight and the sketch's columns)."""
    roots, changed, idle = None, True, 0
    for turn in range(rounds + 1):
        if changed:
            all_ = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            parts, lists, pairs, entries = _open_lists(all_)
            placed = all_.join(lists, "key")
        if not pairs:
            break
        last = turn == rounds or pairs <= each * entries or idle == 2
        if last:
            chosen = placed.filter("root != main")
        else:
            led = parts.join(lists, "key").filter("root = main" if turn % 2 == 0 else "root != main")
            led = led.groupBy("key").agg(F.max("leader").alias("leader")).select("key", F.col("leader.node").alias("node"))
            if turn > 1:  # the first of each kind has been compared: now any of them
                own = placed.filter("root = main" if turn % 2 == 0 else "root != main")
                led = own.groupBy("key").agg(F.max_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("node"))
            chosen = led.join(placed, ["key", "node"])
        left = chosen.select("key", *[F.col(c).alias(f"{c}_u") for c in ("node", "size", "root", *_sketch_columns())])
        # of two that are both outside the main component, one order does when all are looked at
        once = (F.col("root") == F.col("main")) | (F.col("node_u") < F.col("node")) if last else F.lit(True)
        condition = (left["key"] == placed["key"]) & (F.col("root") != F.col("root_u")) & once & _may_link(similarity)
        near = stored(left.join(placed, condition).select(F.least("node", "node_u").alias("u"), F.greatest("node", "node_u").alias("v")).distinct())
        linked = stored(_verified(near, sets, similarity)) if near.head(1) else near
        # a turn that links nothing leaves components and lists as they are
        changed = bool(linked.head(1))
        idle = 0 if changed else idle + 1
        if changed:
            before = linked.limit(0) if roots is None else roots.filter("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = stored(components(linked.union(before)))
        if last:
            break
    return roots if roots is not None else met.select("node", F.col("node").alias("root")).limit(0)


def _with_classes(roots: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, root`` over all links and over ``classes`` (mark, class): nodes of one class are linked by a star."""
    nodes = stored(rows.select("mark", "node").distinct().join(classes, "mark").select("node", "class").distinct())
    least = nodes.groupBy("class").agg(F.min("node").alias("v"))
    stars = nodes.join(least, "class").filter("node != v").select(F.col("node").alias("u"), "v")
    return components(stars.union(roots.filter("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))).distinct())


def without_near_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    rounds: int = ROUNDS,
    each: int = EACH,
    alike: DataFrame | None = None,
) -> DataFrame:
    """One document of each component stays, that with its smallest id, with all its columns.

    ``alike`` (mark, class; mark is the hash of a text) links texts that another method finds alike.
    """
    rows = stored(signatures(docs, doc_id, text, shingle_words))
    classes = rows.select("node", "mark", "size", "keys").dropDuplicates(["node"])
    entries = stored(classes.select("node", "mark", "size", F.explode("keys").alias("key")))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(entries.join(shared, "key"))
    # a node's weight is how many entries it meets; its sketch is the same in all rows of the class
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    sketches = rows.select("node", *[F.col("sketch")[i].alias(s) for i, s in enumerate(_sketch_columns())]).join(weights, "node").dropDuplicates(["node"])
    sets = stored(_sets(docs, text, met.select("mark").distinct(), shingle_words))
    weighed = stored(met.select("key", "node", "size").join(sketches, "node"))
    roots = links(weighed, sets, similarity, rounds, each)
    if alike is not None:
        roots = _with_classes(roots, rows, alike)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    placed = rows.groupBy("node").agg(first).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows_kept(docs, placed.groupBy("root").agg(F.min("first").alias("chosen")).select("chosen.*"), doc_id, text)
