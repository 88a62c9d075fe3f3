"""Secret scans: fixed patterns, then a character convolutional network over every candidate.

A candidate is a run of ``CANDIDATE`` characters that mixes letters with digits, or
has a capital right after a small letter; runs of twelve or more are looked at. The
network sees all of it with the characters around it, convolves, takes the maximum
over all places, and gives a calibrated probability. It is trained in numpy on
labelled findings of four kinds: candidates that a pattern covers, and secrets of
public token forms that no pattern covers, planted between a document's own words
(both secrets); candidates of low entropy that no pattern covers, and planted names,
paths, versions and UUIDs (neither is). Candidates of high entropy that no pattern
covers have no known label and teach nothing. In half of the findings, chosen by
hash, the context is blanked, so that the network learns what a secret looks like
without the word before it.

Findings of all documents are dealt into three parts by a hash of the candidate.
All of the first train, on at most ``TRAIN_CHARS`` characters of each: they are
dealt into groups, each task trains the same network on its groups, the networks
are averaged by the groups' sizes, and again. A kind of finding counts as much as
any other, whatever their numbers. All of the second, scored whole in the tasks,
set the threshold: the highest at which the recall is still ``RECALL``; all of the
third, seen by neither, give ``Net.report``. Candidates that no pattern covers and
that reach the threshold are added.

Null text counts as empty and has no spans. Patterns are applied to whole texts,
whatever their length; a candidate of any length is convolved in blocks. Without
findings of both kinds nothing is added. Repeated rows give equal results; an
empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewatch.durable import stored
from pagewatch.llm.common import each_row, text_of

# The patterns and the least lengths of what they must find.
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_CHARS = 12
#: A run of these characters is one match, so a run that is too short holds none that is long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "net")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
LETTER, DIGIT, HUMP = re.compile("[A-Za-z]"), re.compile("[0-9]"), re.compile("[a-z][A-Z]")
#: From this length and entropy (bits a character) on, a candidate without a pattern has no known label.
OPEN_CHARS, OPEN_BITS = 20, 3.8
# Public token forms as (fixed text, how many characters of which set) parts.
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
DIGITS, URLSAFE, BASE64 = "0123456789", ALNUM + "_-", ALNUM + "+/"
FORMS = (
    (("ghp_", 36, ALNUM),),
    (("xoxb-", 11, DIGITS), ("-", 11, DIGITS), ("-", 24, ALNUM)),
    (("AIza", 35, URLSAFE),),
    (("sk_live_", 24, ALNUM),),
    (("glpat-", 20, URLSAFE),),
    (("npm_", 36, ALNUM),),
    (("SG.", 22, URLSAFE), (".", 43, URLSAFE)),
    (("eyJ", 33, URLSAFE), (".eyJ", 60, URLSAFE), (".", 43, URLSAFE)),
    (("", 40, BASE64),),
)
AROUND = 24
RECALL = 0.95
TRAIN_CHARS = 256
#: Findings a group has at least while there are fewer than ``GROUPS`` groups; also how many a task holds at once.
GROUP_FINDINGS = 1 << 14
GROUPS = 64
#: Times that networks are averaged, and how many findings each teaches between, repeats counted, if its group has fewer.
AVERAGES, TAUGHT = 2, 16_000
TRAIN, CALIBRATE, REPORT = 0, 1, 2
WIDTH, DEPTH, FILTERS, PLACES = 5, 8, 24, 1 << 15

Span = tuple[int, int, int]  # start, kind, end: sorts as spans are listed


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind, in order."""
    found: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if HUMP.search(m[0]) or (DIGIT.search(m[0]) and LETTER.search(m[0]))]


def covered(spans: list[tuple[int, int]], base: list[Span]) -> list[bool]:
    """Which spans overlap a base span; both are in order of their starts."""
    out, reach, k = [], -1, 0
    for start, end in spans:
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        out.append(reach > start)
    return out


def codes_of(text: str, start: int, end: int, around: int = AROUND) -> np.ndarray:
    """A candidate with its context as small numbers: 0 blank, then characters of the context, then those of the candidate."""
    before, after = text[max(0, start - around) : start], text[end : end + around]

    def plain(s: str) -> np.ndarray:
        points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        return np.where((points >= 32) & (points < 127), points - 31, np.where(points < 32, 1, 96))

    edge = np.zeros(WIDTH, np.int64)
    return np.concatenate([edge, plain(before), plain(text[start:end]) + 96, plain(after), edge])


class Net:
    """Embedding, one convolution, maximum over places, one output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (193, DEPTH))
        self.conv = rng.normal(0, 0.2, (WIDTH * DEPTH, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.2, FILTERS)
        self.rest = np.zeros(1)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 1.0
        #: Of the third part: secrets, those found, others, those taken for secrets.
        self.report = (0, 0, 0, 0)

    def peaks(self, codes: np.ndarray) -> np.ndarray:
        """Each filter's maximum over all places, in blocks of places."""
        peak = np.zeros(FILTERS)
        for at in range(0, len(codes) - WIDTH + 1, PLACES):
            part = codes[at : at + PLACES + WIDTH - 1]
            windows = np.lib.stride_tricks.sliding_window_view(part, WIDTH)
            peak = np.maximum(peak, (self.embed[windows].reshape(len(windows), -1) @ self.conv + self.bias).max(axis=0))
        return peak

    def value(self, codes: np.ndarray) -> float:
        return float(self.peaks(codes) @ self.out + self.rest[0])

    def probability(self, codes: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.value(codes) + self.shift))))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.rest]

    def train(
        self, rows: list[np.ndarray], secret: np.ndarray, rounds: int = 8, batch: int = 32, rate: float = 5e-3, seed: int = 7,
        weight: np.ndarray | None = None,
    ) -> None:
        """Goes on from the last call's moments. Without ``weight`` both labels count the same."""
        rng = np.random.default_rng(seed)
        params = self.params()
        first, second, step = getattr(self, "moments", None) or ([np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0)
        if weight is None:
            weight = np.where(secret > 0, 0.5 / max(secret.mean(), 1e-6), 0.5 / max(1 - secret.mean(), 1e-6))
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                longest = max(len(rows[i]) for i in own)
                codes = np.zeros((len(own), longest), np.int64)
                for k, i in enumerate(own):
                    codes[k, : len(rows[i])] = rows[i]
                windows = np.lib.stride_tricks.sliding_window_view(codes, WIDTH, axis=1)
                inputs = self.embed[windows].reshape(len(own), windows.shape[1], -1)
                hidden = inputs @ self.conv + self.bias
                place = hidden.argmax(axis=1)
                at_row = np.arange(len(own))[:, None]
                peak = np.maximum(hidden[at_row, place, np.arange(FILTERS)], 0)
                p = 1 / (1 + np.exp(-(peak @ self.out + self.rest[0])))
                error = (p - secret[own]) * weight[own] / len(own)
                back = error[:, None] * self.out * (peak > 0)
                met = inputs[at_row, place]  # the inputs at each filter's maximum
                d_conv = np.einsum("bfi,bf->if", met, back)
                d_met = (back[:, :, None] * self.conv.T[None]).reshape(-1, DEPTH)
                d_embed = np.zeros_like(self.embed)
                np.add.at(d_embed, windows[at_row, place].reshape(-1), d_met)
                grads = [d_embed, d_conv, back.sum(axis=0), peak.T @ error, np.array([error.sum()])]
                step += 1
                for param, grad, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.moments = first, second, step

    def calibrate(self, z: np.ndarray, secret: np.ndarray, recall: float = RECALL) -> None:
        """Fit slope and shift on the values of held findings, then the highest threshold that keeps the recall."""
        goals = 1 / ((1 - secret).sum() + 2), 1 - 1 / (secret.sum() + 2)

        def sums(a: float, b: float) -> list[float]:
            p = 1 / (1 + np.exp(-(a * z + b)))
            w, d = p * (1 - p) + 1e-9, p - np.where(secret > 0, goals[1], goals[0])
            return [float(x.sum()) for x in (w * z * z, w * z, w, d * z, d)]

        self.fit_line(sums)
        ranked = np.sort(1 / (1 + np.exp(-(self.slope * z[secret > 0] + self.shift))))
        self.threshold = float(ranked[int((1 - recall) * len(ranked))])

    def fit_line(self, sums: Callable[[float, float], list[float]]) -> None:
        """Newton steps to slope and shift; ``sums`` gives, at a line, the sums of wzz, wz, w, dz and d over all findings."""
        a, b = 1.0, 0.0
        for _ in range(50):
            wzz, wz, w, dz, d = sums(a, b)
            change = np.linalg.solve(np.array([[wzz + 1e-3, wz], [wz, w + 1e-3]]), np.array([dz, d]))
            a, b = a - np.clip(change[0], -1, 1), b - np.clip(change[1], -1, 1)
            if np.abs(change).max() < 1e-6:
                break
        self.slope, self.shift = float(a), float(b)


def blanked(codes: np.ndarray) -> np.ndarray:
    """The same without its context."""
    return np.where(codes > 96, codes, 0)


def fit(rows: list[np.ndarray], secret: np.ndarray, held: np.ndarray) -> Net | None:
    """A network trained on the findings not held, its threshold set on those held; none without both kinds in both parts."""
    parts = [secret[~held], secret[held]]
    if any(len(set(p.tolist())) < 2 for p in parts):
        return None
    net = Net()
    taught = [blanked(r) if k % 2 else r for k, r in enumerate(r for r, h in zip(rows, held, strict=True) if not h)]
    net.train(taught, parts[0])
    seen = [blanked(r) if k % 2 else r for k, r in enumerate(r for r, h in zip(rows, held, strict=True) if h)]
    net.calibrate(np.array([net.value(r) for r in seen]), parts[1])
    return net


def entropy(text: str) -> float:
    """Bits a character."""
    share = np.array([text.count(c) for c in set(text)], float) / max(len(text), 1)
    return float(-(share * np.log2(share)).sum())


def planted(words: list[str], rng: np.random.Generator) -> list[tuple[str, bool]]:
    """A secret of a public form, and two harmless runs made of a text's words and numbers."""

    def drawn(n: int, of: str) -> str:
        return "".join(of[i] for i in rng.integers(0, len(of), n))

    form = FORMS[int(rng.integers(len(FORMS)))]
    secret = "".join(fixed + drawn(n, of) for fixed, n, of in form)
    a, b, c = (words[int(rng.integers(len(words)))] for _ in range(3))
    n, m = (int(rng.integers(1, 1000)) for _ in range(2))
    uuid = "-".join(drawn(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12))
    harmless = (
        uuid, f"{a}/{b}{n}/{c}.html", f"{a}.{b}.{c}{m}.example.org", f"{a}{b.title()}{c.title()}", f"{a}-{b}-{c}-{n}",
        f"v{n % 20}.{m % 50}.{n}-{a}.{b}", f"20{n % 100:02}-{m % 12 + 1:02}-{n % 28 + 1:02}T{m % 24:02}-{n % 60:02}-{m % 60:02}", f"{a}_{b}_{n}={m}",
    )
    return [(secret, True), *((harmless[i], False) for i in rng.choice(len(harmless), 2, replace=False))]


def findings(text: str | None, number: int = 0) -> list[tuple[str, int, int, bool, bool]]:
    """Labelled findings: the text around, start and end in it, whether it is a secret, whether it was planted.

    ``number`` (a hash of the document) fixes what is planted and where.
    """
    text = text or ""
    spans, out = candidates(text), []
    for (a, b), known in zip(spans, covered(spans, base_spans(text)), strict=True):
        if known or b - a < OPEN_CHARS or entropy(text[a:b]) < OPEN_BITS:
            left = max(0, a - AROUND)
            out.append((text[left : b + AROUND], a - left, b - left, known, False))
    words = [w for w in re.findall("[a-z]{2,12}", text) if w not in ("password", "passwd", "secret", "token")]
    if not words:
        return out
    rng = np.random.default_rng(number)
    for run, secret in planted(words, rng):
        at = text.find(" ", int(rng.integers(len(text))))
        at = len(text) if at < 0 else at
        before, after = text[max(0, at - AROUND) : at], text[at : at + AROUND]
        placed = f"{before} {run}{after}"
        start = len(before) + 1
        if (start, start + len(run)) in candidates(placed) and not (not secret and base_spans(run)):
            out.append((placed, start, start + len(run), secret, True))
    return out


def part_of(run: str) -> tuple[int, bool, int]:
    """The part a candidate belongs to, whether its context is blanked, and its place in the order of choice."""
    digest = hashlib.md5(run.encode("utf-8", "surrogatepass")).digest()
    part = (CALIBRATE, CALIBRATE, REPORT)[digest[0] % 8] if digest[0] % 8 < 3 else TRAIN
    return part, bool(digest[1] % 2), int.from_bytes(digest[8:], "big") >> 1


def coded(around: str, start: int, end: int, blank: bool) -> np.ndarray:
    codes = codes_of(around, start, end)
    return blanked(codes) if blank else codes


FOUND = "struct<part:int,key:bigint,secret:boolean,planted:boolean,codes:binary>"
FOUND_ARROW = pa.struct([("part", pa.int32()), ("key", pa.int64()), ("secret", pa.bool_()), ("planted", pa.bool_()), ("codes", pa.binary())])
KIND = ("secret", "planted")


def _found(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The findings of all documents, each once: those to train on by their first characters, the others whole. A code is a byte."""

    def row(words: str | None, number: int) -> tuple[list[dict]]:
        out = []
        for around, a, b, secret, own in findings(words, number):
            part, blank, key = part_of(around[a:b])
            codes = coded(around, a, min(b, a + TRAIN_CHARS) if part == TRAIN else b, blank).astype(np.uint8).tobytes()
            out.append({"part": part, "key": key, "secret": secret, "planted": own, "codes": codes})
        return (out,)

    number = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), text_of(text)), 1)
    found = each_row(docs.select(F.col(text), number), lambda: row, f"found array<{FOUND}>", [("found", pa.list_(FOUND_ARROW))])
    # one of equal candidates by all that it carries, whatever the order of the rows
    return found.select(F.inline("found")).groupBy("part", "key", *KIND).agg(F.min("codes").alias("codes"))


def _averaged(net: Net, taught: DataFrame, numbers: dict[tuple, int], groups: int) -> None:
    """Train on all findings: each group from the network as it is, then their average by size, and so on."""
    rows = sum(numbers.values())
    weights = {kind: rows / (len(numbers) * n) for kind, n in numbers.items()}
    passes = min(4, max(1, TAUGHT * groups // rows))
    dealt = stored(
        taught.withColumn("group", F.pmod("key", F.lit(groups)).cast("int")).repartition(groups, "group").sortWithinPartitions("group", "key", *KIND)
    ).select("group", *KIND, "codes")
    layout = pa.schema([("group", pa.int32()), ("rows", pa.int64()), ("params", pa.binary())])

    for turn in range(AVERAGES):
        start = [p.copy() for p in net.params()]

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            held, now, own, done = [], None, None, 0

            def teach() -> None:
                kinds = [k[:2] for k in held]
                codes = [np.frombuffer(k[2], np.uint8).astype(np.int64) for k in held]
                own.train(codes, np.array([float(k[0]) for k in kinds]), passes, seed=7 + turn, weight=np.array([weights[k] for k in kinds]))

            def finished() -> pa.RecordBatch:
                whole = np.concatenate([p.reshape(-1) for p in own.params()]).tobytes()
                return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, done, whole), layout, strict=True)], schema=layout)

            for batch in batches:
                for group, *finding in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if group != now or len(held) == GROUP_FINDINGS:
                        if held:
                            teach()
                            done, held = done + len(held), []
                        if group != now:
                            if own is not None:
                                yield finished()
                            now, own, done = group, Net(), 0
                            for param, value in zip(own.params(), start, strict=True):
                                param[...] = value
                    held.append(tuple(finding))
            if held:
                teach()
                done += len(held)
                yield finished()

        # one small row a group
        parts = sorted(dealt.repartition(groups, "group").sortWithinPartitions("group", *KIND, "codes").mapInArrow(run, "group int, rows bigint, params binary").collect())
        whole = sum(np.frombuffer(r["params"]) * (r["rows"] / rows) for r in parts)
        for param in net.params():
            param[...], whole = whole[: param.size].reshape(param.shape), whole[param.size :]


def _nth(values: DataFrame, place: int) -> float:
    """The value at a place in ascending order, found in the narrow bin it lies in."""
    binned = values.select("value", F.floor(F.col("value") * 256).alias("bin"))
    for number, count in sorted(map(tuple, binned.groupBy("bin").count().collect())):
        if place < count:
            break
        place -= count
    for value, count in sorted(map(tuple, binned.where(F.col("bin") == number).groupBy("value").count().collect())):
        if place < count:
            return value
        place -= count


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: int = GROUPS, group_findings: int = GROUP_FINDINGS) -> Net | None:
    """Train, calibrate and report on the findings of all documents."""
    found = stored(_found(docs, doc_id, text))
    counts = {(r["part"], r["secret"], r["planted"]): r["count"] for r in found.groupBy("part", *KIND).count().collect()}
    # labels of the training part, and of the part that calibrates
    if any({s for part, s, _ in counts if part == wanted} != {True, False} for wanted in (TRAIN, CALIBRATE)):
        return None
    numbers = {(s, p): n for (part, s, p), n in counts.items() if part == TRAIN}
    net = Net()
    _averaged(net, found.where(F.col("part") == TRAIN), numbers, min(groups, max(1, sum(numbers.values()) // group_findings)))

    def value(part: int, secret: bool, codes: bytes) -> tuple:
        return part, secret, net.value(np.frombuffer(codes, np.uint8).astype(np.int64))

    held = stored(
        each_row(
            found.where(F.col("part") != TRAIN).select("part", "secret", "codes"), lambda: value,
            "part int, secret boolean, value double", [("part", pa.int32()), ("secret", pa.bool_()), ("value", pa.float64())],
        )
    )
    seen, z = held.where(F.col("part") == CALIBRATE), F.col("value")
    secrets, others = (sum(n for (part, s, _), n in counts.items() if part == CALIBRATE and s == kind) for kind in (True, False))
    goal = F.when(F.col("secret"), 1 - 1 / (secrets + 2)).otherwise(1 / (others + 2))

    def sums(a: float, b: float) -> list[float]:
        p = 1 / (1 + F.exp(-(z * float(a) + float(b))))
        parts = seen.select(z, (p * (1 - p) + 1e-9).alias("w"), (p - goal).alias("d"))
        w, d = F.col("w"), F.col("d")
        return list(parts.agg(*[F.sum(x) for x in (w * z * z, w * z, w, d * z, d)]).first())

    net.fit_line(sums)
    lowest = int((1 - RECALL) * secrets)
    edge = _nth(seen.where("secret"), lowest if net.slope > 0 else secrets - 1 - lowest)
    net.threshold = float(1 / (1 + np.exp(-(net.slope * edge + net.shift))))
    hit = (z >= edge) if net.slope > 0 else (z <= edge)
    last = held.where(F.col("part") == REPORT)
    secret = F.col("secret")
    net.report = tuple(last.agg(F.count_if(secret), F.count_if(secret & hit), F.count_if(~secret), F.count_if(~secret & hit)).first())
    return net


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: str | None, net: Net | None) -> tuple[int, int, int, str, str]:
    """Counts by pattern, the hash of the pattern spans, and all spans."""
    text = text or ""
    base = base_spans(text)
    added: list[Span] = []
    if net is not None:
        spans = candidates(text)
        for (start, end), known in zip(spans, covered(spans, base), strict=True):
            if not known and net.probability(codes_of(text, start, end)) >= net.threshold:
                added.append((start, 3, end))
    counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
    return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + added)))


def scanned(docs: DataFrame, net: Net | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans."""
    kind = docs.schema[doc_id].dataType

    def make():
        return lambda key, words: (key, *scan(words, net))

    return each_row(
        docs.select(doc_id, text),
        make,
        f"id {kind.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        [("id", to_arrow_type(kind)), *[(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")], ("base_sha256", pa.string()), ("spans", pa.string())],
    )


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scanned(docs, learn(docs)).withColumnRenamed("id", "doc_id")
