"""Personal data by candidate gradient boosting.

Generators of high recall propose overlapping spans of four kinds; boosted trees
judge each by its format and context; thresholds, calibrated for precision on
held-out candidates, select. Spans of the strict base patterns are always in.

The tables hold no labelled spans, so the trees are fitted on a labelled sample
of fixed size that is drawn here from format templates (``training_sample``).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import text_parts

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 8000
#: Least precision, on held-out candidates, at a kind's threshold.
PRECISION = 0.98
CONTEXT = 40
Span = tuple[int, int]

_SOME = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(t: str) -> list[Span]:
    """Runs left of each @ and domains right of it: linear in any text."""
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > end and t[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(t, at + 1)):
            out.append((lo, m.end()))
            end = m.end()
        at = t.find("@", max(at + 1, end))
    return out


def _octets(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def base_spans(t: str) -> dict[str, list[Span]]:
    """Spans of the base patterns: leftmost, non-overlapping in each kind."""
    if not _SOME.search(t):
        return {k: [] for k in KINDS}
    cards = [m.span() for m in _CARD.finditer(t) if m.end() - m.start() >= 16]
    return {
        "email": _emails(t) if "@" in t else [],
        "ip": [m.span() for m in _IP.finditer(t) if _octets(m[0])],
        "card": [(a, b) for a, b in cards if 16 <= len(d := _digits(t[a:b])) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(t) if 8 <= len(_digits(m[0])) <= 15] if "+" in t else [],
    }


# Generators: what might be personal data, and mostly is not. Each kind has
# several, whose spans may overlap. Repeats are bounded, so that each is linear
# in any text.
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s?@\s?|\s(?:at|AT)\s)"
_LABELS = r"[\w-]{1,63}(?:(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\.|\s(?:dot|DOT)\s)[\w-]{1,63})"
_MAYBE = {
    "email": (re.compile(rf"[\w.+-]{{1,64}}{_AT}{_LABELS}{{1,6}}"),),
    "ip": (
        re.compile(r"(?<![\w.])(?:\d{1,4}(?:\.|\[\.\]|\s\.\s?)){3}\d{1,4}(?![\w])"),
        re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ),
    "card": (
        re.compile(r"(?<!\d)\d{13,19}(?!\d)"),
        re.compile(r"(?<!\d)\d{4}(?:[ ./_-]{1,3}\d{1,6}){2,4}(?!\d)"),
    ),
    "phone": (
        re.compile(r"(?<![\w.])(?:\+|00)?\(?\d{1,4}\)?(?:[ ./()-]{1,3}\d{2,5}){1,5}(?!\w)"),
        re.compile(r"\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}(?!\w)"),
    ),
}
#: A part of whatever the e-mail generator matches, so that texts without it have
#: no such candidate.
_OBFUSCATED = re.compile(_AT.replace(r"\s?[", "[", 1).replace(r"\s?@", "@", 1) + _LABELS)
_HINTS = {
    "email": re.compile(r"(?i)\be-?mail|\bmail|contact|write to|reach|correo|courriel"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|login|from|client"),
    "card": re.compile(r"(?i)card|visa|credit|payment|paid|tarjeta|carte|karte|billing"),
    "phone": re.compile(r"(?i)phone|\btel|call|mobile|fax|cell|whatsapp|contact|\bnumber"),
}
_OTHER = re.compile(r"(?i)version|\bv\b|order|invoice|isbn|issn|\bid\b|serial|section|chapter|page|figure|table|ratio|score|time|date|doi|build|release|size|area|km|part|code")


def candidates(t: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of all proposals; they may overlap."""
    out = []
    has_digit = _SOME.search(t) is not None
    for k, kind in enumerate(KINDS):
        if (has_digit if kind != "email" else _OBFUSCATED.search(t)) is None or (kind != "email" and not has_digit):
            continue
        out += sorted({(k, *m.span()) for p in _MAYBE[kind] for m in p.finditer(t)})
    return out


def describe(t: str, kind: int, a: int, b: int) -> list[float]:
    """Format and context features of a candidate."""
    s, left, right = t[a:b], t[max(0, a - CONTEXT) : a], t[b : b + CONTEXT]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    before, after = left[-1:], right[:1]
    year = sum(g[:2] in ("19", "20") and len(g) == 4 for g in groups)
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        len(s),
        len(d),
        len(groups),
        max(sizes),
        min(sizes),
        float(len(set(sizes)) == 1),
        float(sum(c.isalpha() for c in s)),
        float("@" in s),
        float(s.count(".")),
        float(s.count(":")),
        float(s.count("-")),
        float(s.count("(")),
        float(s.count(" ")),
        float(s.count("/")),
        float(s.startswith("+")),
        float(s.startswith("00")),
        float(16 <= len(d) <= 19 and luhn(d)),
        float(len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)),
        float(year),
        len(set(d)) / max(len(d), 1),
        float(s.rpartition(".")[2].isalpha() or bool(re.search(r"(?i)(dot|[\])}])\s?[a-z]{2,4}$", s))),
        float(bool(_HINTS[KINDS[kind]].search(left))),
        float(bool(_OTHER.search(left))),
        float(before.isalnum()),
        float(after.isalnum()),
        float(bool(before) and before in "$€£#=/"),
        float(bool(after) and after in "%/="),
    ]


def training_sample(size: int = SAMPLE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of ``size`` labelled candidates: values in the
    formats personal data come in, with and without a hint before them, against
    numbers and words of like form that are none."""
    rng = random.Random(seed)
    pick = rng.choice
    num = lambda n: "".join(pick("0123456789") for _ in range(n))
    word = lambda: "".join(pick("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 9)))
    octet = lambda: str(rng.randint(0, 255))

    def card() -> str:
        d = pick("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(["", " ", "-", ".", " - "]).join(d[k : k + 4] for k in range(0, 16, 4))

    def mail(at: str, dot: str) -> str:
        return f"{word()}{pick(['', '.' + word(), num(2)])}{at}{word()}{dot}{pick(['com', 'org', 'net', 'de', 'example' + dot + 'com'])}"

    good = {
        "email": lambda: mail(*pick([("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), (" @ ", "."), (" [at] ", " [dot] ")])),
        "ip": lambda: pick([".", ".", "[.]"]).join(octet() for _ in range(4)) if rng.random() < 0.7 else ":".join("%x" % rng.randint(0, 65535) for _ in range(8)),
        "card": card,
        "phone": lambda: pick(
            [f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"({num(3)}) 555-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(6)}", f"{num(3)}.{num(3)}.{num(4)}"]
        ),
    }
    bad = {
        "email": lambda: pick([f"{word()} at {word()}.{word().title()}", f"{word()}@{word()}.{num(2)}", f"{word()} at {num(2)}.{num(1)}", f"{word()} @ {num(3)}.{num(2)}"]),
        "ip": lambda: pick([f"{num(1)}.{num(1)}.{num(2)}.{num(4)}", f"{rng.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(1)}.{num(1)}"]),
        "card": lambda: pick([num(16), f"{num(4)} {num(4)} {num(4)}", f"20{num(2)}-{num(2)}-{num(2)} {num(4)}", num(13), num(18), f"{num(4)}/{num(3)}/{num(5)}"]),
        "phone": lambda: pick(
            [f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(1)}.{num(3)}.{num(3)}", f"19{num(2)}-20{num(2)}", f"{num(2)} - {num(2)}", f"{num(2)}.{num(2)}.{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(5)} {num(5)}", ".".join(octet() for _ in range(4)), f"{num(4)} {num(4)} {num(4)} {num(4)}"]
        ),
    }
    hints = {
        "email": ["email: ", "contact ", "write to "], "ip": ["ip ", "host ", "login from "],
        "card": ["card ", "credit card: ", "paid with visa "], "phone": ["phone: ", "tel. ", "call "],
    }
    others = ["version ", "order ", "isbn ", "section ", "date ", "id ", "page ", "score ", "build "]
    rows, labels, kinds = [], [], []
    while len(rows) < size:
        k = rng.randrange(len(KINDS))
        kind, label = KINDS[k], rng.random() < 0.5
        value = (good if label else bad)[kind]()
        lead = pick(hints[kind]) if rng.random() < (0.5 if label else 0.08) else pick(others) if rng.random() < (0.03 if label else 0.4) else ""
        text = f"{word()} {word()} {word()} {lead}{value}{pick(['', '.', ','])} {word()} {word()}"
        lo = text.index(value)
        found = [c for c in candidates(text) if c[0] == k and c[1] < lo + len(value) and c[2] > lo]
        for _, a, b in found[:1]:
            whole = (a, b) == (lo, lo + len(value))
            rows.append(describe(text, k, a, b))
            labels.append(float(label and whole))
            kinds.append(k)
    return np.array(rows), np.array(labels), np.array(kinds)


def _merged(spans: list[Span]) -> list[Span]:
    """The stretches that spans cover, sorted and apart."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _free(taken: list[Span], a: int, b: int) -> bool:
    """Whether no stretch (sorted, apart) overlaps the span: a bisection."""
    k = bisect_left(taken, (b,))
    return not k or taken[k - 1][1] <= a


class Selector:
    """Boosted trees and a threshold for each kind."""

    def __init__(self, sample: int = SAMPLE, precision: float = PRECISION):
        x, y, kinds = training_sample(sample)
        part = np.arange(len(y)) % 4
        self.trees = BoostedTrees.fit(x[part < 2], y[part < 2])
        self.trees.calibrate(x[part == 2], y[part == 2])
        p, t, k = self.trees.probabilities(x[part == 3]), y[part == 3], kinds[part == 3]
        self.thresholds = np.ones(len(KINDS)) * 1.1
        for kind in range(len(KINDS)):
            order = np.argsort(-p[k == kind], kind="stable")
            q, right = p[k == kind][order], t[k == kind][order]
            fine = np.flatnonzero(np.cumsum(right) >= precision * np.arange(1, len(right) + 1))
            if len(fine):
                self.thresholds[kind] = max(0.5, q[fine[-1]])

    def spans(self, texts: list[str]) -> list[tuple[dict[str, list[Span]], list[tuple[int, int, int]]]]:
        """For each text the base spans and all spans (kind index, start, end):
        base ones, and chosen candidates that overlap neither a base span nor a
        likelier candidate, of any kind."""
        base = [base_spans(t) for t in texts]
        out = [[(k, a, b) for k, kind in enumerate(KINDS) for a, b in x[kind]] for x in base]
        taken = [_merged([(a, b) for _, a, b in x]) for x in out]
        proposed = [(n, *c) for n, t in enumerate(texts) for c in candidates(t) if _free(taken[n], c[1], c[2])]
        if proposed:
            p = self.trees.probabilities(np.array([describe(texts[n], k, a, b) for n, k, a, b in proposed]))
            chosen = np.flatnonzero(p >= self.thresholds[[c[1] for c in proposed]])
            for i in sorted(chosen.tolist(), key=lambda i: (-p[i], proposed[i])):
                n, k, a, b = proposed[i]
                if _free(taken[n], a, b):
                    insort(taken[n], (a, b))
                    out[n].append((k, a, b))
        return list(zip(base, map(sorted, out)))


def _texts(raw: list[bytes]) -> list[str]:
    return [x.decode("utf-8", "replace") for x in raw]


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans and n_added (spans besides the base ones).

    Null and empty texts have no spans. Spans are in code points, end exclusive.
    Repeated rows are reported each. Texts are searched whole, in linear time.
    Other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Selector())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in text_parts(b.column(1)):
                found = shared.value.spans(_texts(texts))
                base = [[(k, *s) for k, kind in enumerate(KINDS) for s in x[kind]] for x, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[lo:hi],
                        *[pa.array([len(x[kind]) for x, _ in found], pa.int64()) for kind in KINDS],
                        pa.array([hashlib.sha256(_written(x).encode()).hexdigest() for x in base], pa.string()),
                        pa.array([_written(x) for _, x in found], pa.string()),
                        pa.array([len(x) - len(y) for (_, x), y in zip(found, base)], pa.int64()),
                    ],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cut(t: str, spans: list[tuple[int, int, int]]) -> str:
    """``t`` with each stretch that spans cover replaced by the name of the
    first one's kind, as in <EMAIL>."""
    out, end, last = [], 0, None
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if last is not None and a < end:
            end = max(end, b)
            continue
        out += [t[end:a], f"<{KINDS[k].upper()}>"]
        end, last = b, k
    return "".join([*out, t[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with personal data replaced in the text;
    n_chars, where there is such a column, is the new text's length. Null texts
    and texts without personal data stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(Selector())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in text_parts(b.column(at)):
                part, plain = b.slice(lo, hi - lo), _texts(texts)
                found = shared.value.spans(plain)
                if any(x for _, x in found):
                    new = [None if none else cut(t, x) if x else t for none, t, (_, x) in zip(part.column(at).is_null().to_pylist(), plain, found)]
                    columns = part.columns
                    columns[at] = pa.array(new, b.schema.field(at).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=b.schema)
                yield part

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return out
