"""Secret scans by grammar inference.

Credentials that the base patterns label in the corpus are a sample of what
secrets look like. A probabilistic automaton is inferred from each kind's sample
(for kinds with few values, one from all samples together) and one from each
shape of ordinary tokens: letters, digits, both. Every token of credential length
is then scored by how much likelier it is under a credential's format than as
ordinary text. Spans of the base patterns are always in.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton
from .common import materialise, text_parts

KINDS = ("assign", "access", "hex")
#: Labelled values of each kind, and ordinary tokens of each shape, that automata
#: are inferred from: those with the least hashes, whatever the corpus size.
#: Thresholds take all ordinary tokens.
MAX_SAMPLE = 400
#: Kinds with fewer values are too sparse for a format of their own: one automaton
#: is inferred from the values of all kinds together, and what it finds is
#: reported as the kind POOL.
MIN_SAMPLE = 20
POOL = "assign"
#: Shapes of tokens (other characters beside them), and the share of the ordinary
#: tokens of a shape that its threshold is above. Unlabelled credentials are
#: among the tokens with letters and digits, so some of those lie beyond it.
SHAPES = {"letters": 0.9999, "digits": 0.9999, "both": 0.95}
#: Log-likelihood ratio a token needs over ordinary text, at least.
MIN_RATIO = 6.0
#: Ratios are counted in so many bins to a factor of e: 0.4 % wide.
BINS = 256
#: Distinct tokens that a task gathers before it hands them on.
FLUSH = 100_000
#: Judged tokens that a worker remembers, twice; ordinary words come again.
REMEMBERED = 200_000
#: Characters of all values that one automaton is inferred from. Values are whole
#: or not among them; tokens are scored whole, whatever their length.
MAX_SYMBOLS = 200_000
Span = tuple[int, int]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
#: Candidates: as long as the shortest value a base pattern takes, or longer.
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: What stands between the separators of paths and queries.
_PART = re.compile(r"[A-Za-z0-9+_-]{6,}")
#: Classes of characters after the fourth: digits, a-f, other small letters,
#: capitals; other characters, and the first four, stand for themselves. One that
#: is also among the two before it is marked: random strings rarely repeat.
_CLASS = {**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")}
_AGAIN = {c: f"{c}~" for c in (*_CLASS.values(), *"+/_.=-")}
_SYMBOLS = 80


def symbols(token: str) -> tuple:
    head = tuple(c if _CLASS.get(c) == "A" else _CLASS.get(c, c) for c in token[:4])
    if len(token) <= 4:
        return head
    tail = [_CLASS.get(c, c) for c in token[4:]]
    for k, (x, y, z) in enumerate(zip(token[2:], token[3:], token[4:])):
        if z == y or z == x:
            tail[k] = _AGAIN.get(tail[k], tail[k])
    return head + tuple(tail)


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, sorted: leftmost and
    non-overlapping in each kind, whole matches; failing ones are dropped."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in t:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(t)]
    return sorted(out)


def _value(t: str, span: tuple[int, int, int]) -> str:
    a, k, b = span
    return _ASSIGN.match(t, a)[2] if k == 0 else t[a:b]


def shape(token: str) -> str:
    if not _DIGIT.search(token):
        return "letters"
    return "both" if _LETTER.search(token) else "digits"


def _strings(token: str) -> list[Span]:
    """What is scored of a token: the whole of it, and its parts."""
    whole = (0, len(token))
    if "/" not in token and "=" not in token:
        return [whole]
    return [whole, *(m.span() for m in _PART.finditer(token) if m.span() != whole)]


def _ordinary(t: str, taken: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Tokens outside base spans (sorted by start), in one sweep."""
    end, k = 0, 0
    for m in _TOKEN.finditer(t):
        while k < len(taken) and taken[k][0] < m.end():
            end = max(end, taken[k][2])
            k += 1
        if end <= m.start():
            yield m


class Scanner:
    """Automata of the credentials and of ordinary tokens, with thresholds for
    each format and shape."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        by_shape = {x: [] for x in SHAPES}
        for token in (*ordinary, *_FILLERS):
            by_shape[shape(token)].append(symbols(token))
        self.backgrounds = [Automaton(x, _SYMBOLS) for x in by_shape.values() if x]
        known = {k: [symbols(v) for v in labelled.get(k, ())] for k in KINDS}
        self.formats = {k: Automaton(x, _SYMBOLS) for k, x in known.items() if len(x) >= MIN_SAMPLE}
        if any(0 < len(x) < MIN_SAMPLE for x in known.values()):
            self.formats["pool"] = Automaton([s for x in known.values() for s in x], _SYMBOLS)
        self._young, self._old = {}, {}
        self.settle(self.histogram(ordinary))

    def histogram(self, tokens: Iterable[str]) -> Counter:
        """How many of the tokens fall in each (format, shape, bin of their
        ratio); all ratios up to 1 are in bin 0."""
        out: Counter = Counter()
        for t in tokens:
            of = shape(t)
            for k, (r, _) in self._best(t).items():
                out[k, of, math.ceil(BINS * math.log(max(r, 1.0)))] += 1
        return out

    def settle(self, ordinary: Counter) -> None:
        """Thresholds from the histogram of all ordinary tokens and the fillers."""
        counts = ordinary + self.histogram(_FILLERS)
        self.threshold = {}
        for kind in self.formats:
            for of, share in SHAPES.items():
                bins = sorted((b, n) for (k, x, b), n in counts.items() if (k, x) == (kind, of))
                above = int(share * sum(n for _, n in bins))
                for b, n in bins:
                    above -= n
                    if above < 0:
                        self.threshold[kind, of] = max(MIN_RATIO, math.exp(b / BINS) + 1.0)
                        break
                else:
                    self.threshold[kind, of] = MIN_RATIO
        self._young, self._old = {}, {}

    def ratio(self, kind: str, string: str) -> float:
        """Log likelihood of a string in a format over that as ordinary text."""
        s = symbols(string)
        return self.formats[kind].log_likelihood(s) - max(x.log_likelihood(s) for x in self.backgrounds)

    def _best(self, token: str) -> dict[str, tuple[float, Span]]:
        """For each format the largest ratio of the token and its parts, and whose."""
        out: dict[str, tuple[float, Span]] = {}
        for a, b in _strings(token):
            string = symbols(token[a:b])
            base = max(x.log_likelihood(string) for x in self.backgrounds)
            for k, f in self.formats.items():
                r = f.log_likelihood(string) - base
                if k not in out or r > out[k][0]:
                    out[k] = r, (a, b)
        return out

    def find(self, token: str) -> tuple[str, Span] | None:
        """The likeliest kind whose threshold the token, or a part of it, passes,
        and where. Verdicts are remembered; forgetting one changes nothing."""
        if token in self._young:
            return self._young[token]
        out = self._old[token] if token in self._old else self._judged(token)
        if len(self._young) >= REMEMBERED:
            self._old, self._young = self._young, {}
        if len(token) <= 100:
            self._young[token] = out
        return out

    def _judged(self, token: str) -> tuple[str, Span] | None:
        of = shape(token)
        found = [(r, k, span) for k, (r, span) in self._best(token).items() if r > self.threshold[k, of]]
        if not found:
            return None
        _, k, span = max(found)
        return POOL if k == "pool" else k, span

    def judge(self, token: str) -> str | None:
        found = self.find(token)
        return found and found[0]

    def spans(self, t: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(t)
        if not self.formats:
            return base, base
        found = [(m.start(), x) for m in _ordinary(t, base) if (x := self.find(m[0]))]
        more = [(at + a, KINDS.index(k), at + b) for at, (k, (a, b)) in found]
        return base, sorted(base + more)


#: Forms that ordinary long tokens take, so that the background automaton knows
#: them in any corpus.
_FILLERS = tuple(
    x
    for k in range(1, 40)
    for x in (f"well-known-word-{k}", f"snake_case_name_{k}", f"SomeCamelCase{k}", f"path/to/file{k}", f"2024-01-{k:02d}T10-{k:02d}", "=" * (11 + k), "-" * (11 + k), "_" * (11 + k), f"UPPER_CASE_{k:03d}", f"{k:013d}", f"{k * 7919:05d}-{k * 104729:07d}")
) + tuple((pad * 40)[: 5 + k] for k in range(1, 40) for pad in ("a", "x", "X", "0", "ab", "xy", "01", "a1", "x0"))


def _fitting(values: list[str]) -> list[str]:
    """Those of ``values``, first ones first, that fit into MAX_SYMBOLS."""
    out, room = [], MAX_SYMBOLS
    for v in values:
        if len(v) <= room:
            out.append(v)
            room -= len(v)
    return out


def train(docs: DataFrame, most: int = MAX_SAMPLE) -> Scanner:
    """A scanner whose automata are inferred from at most ``most`` distinct
    values of each kind that the base patterns label in ``docs``, and as many
    ordinary tokens; those with the least hashes of all documents. Its
    thresholds are set over all distinct ordinary tokens. A value that is
    labelled anywhere is a known credential and nowhere an ordinary token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[str, str]] = set()

        def out() -> pa.RecordBatch:
            kinds, values = [k for k, _ in held], [v for _, v in held]
            hashes = [hashlib.blake2b(v.encode(), digest_size=8).digest() for v in values]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(hashes, pa.binary()), pa.array(values, pa.string())], ["kind", "h", "value"])

        for b in batches:
            for _, _, texts in text_parts(b.column(0)):
                for t in map(_text, texts):
                    base = base_spans(t)
                    held.update((KINDS[s[1]], _value(t, s)) for s in base)
                    held.update((f"-{shape(m[0])}", m[0]) for m in _ordinary(t, base))
                    if len(held) > FLUSH:
                        yield out()
        yield out()

    found = materialise(docs.select("text").mapInArrow(run, "kind string, h binary, value string").distinct(), "values")
    known = found.where("kind not like '-%'").select("value").distinct()
    ordinary = materialise(found.where("kind like '-%'").join(known, "value", "left_anti"), "ordinary")

    def sample(values: DataFrame) -> list[str]:
        return _fitting([r.value for r in values.where(F.length("value") <= MAX_SYMBOLS).orderBy("h", "value").limit(most).collect()])

    rows = {k: sample(found.where(F.col("kind") == k)) for k in KINDS}
    # Values that an assignment shares with another kind tell that kind's form.
    rows["assign"] = [v for v in rows["assign"] if not (_ACCESS.fullmatch(v) or _HEX.fullmatch(v))]
    scanner = Scanner(rows, [v for x in SHAPES for v in sample(ordinary.where(F.col("kind") == f"-{x}"))])
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = shared.value.histogram(b.column(0).to_pylist())
            k, of, x = zip(*n) if n else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.string()), pa.array(of, pa.string()), pa.array(x, pa.int64()), pa.array(list(n.values()), pa.int64())], ["kind", "shape", "bin", "n"]
            )

    # A few thousand bins a kind and shape.
    weighed = ordinary.select("value").mapInArrow(weigh, "kind string, shape string, bin long, n long")
    weighed = weighed.groupBy("kind", "shape", "bin").agg(F.sum("n").alias("n"))
    scanner.settle(Counter({(r.kind, r.shape, r.bin): r.n for r in weighed.collect()}))
    shared.unpersist()
    return scanner


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def report(docs: DataFrame, most: int = MAX_SAMPLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans and n_added (spans besides the base ones).

    Null and empty texts have no spans. Spans are in code points, end exclusive.
    Texts are searched whole, in a time that grows with their length. Repeated
    rows are reported each; other columns are not read. A table without any
    labelled value has its base spans only; an empty one gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in text_parts(b.column(1)):
                found = [shared.value.spans(_text(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[lo:hi],
                        *[pa.array([sum(s[1] == k for s in x) for x, _ in found], pa.int64()) for k in range(len(KINDS))],
                        pa.array([hashlib.sha256(_written(x).encode()).hexdigest() for x, _ in found], pa.string()),
                        pa.array([_written(x) for _, x in found], pa.string()),
                        pa.array([len(y) - len(x) for x, y in found], pa.int64()),
                    ],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
