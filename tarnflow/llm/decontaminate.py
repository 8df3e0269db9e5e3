"""Benchmark decontamination by a broadcast hash set of test n-grams.

The n-grams of the benchmark become sorted 64-bit hashes with the exact word
ids beside them. Each training text is scanned once: words that no benchmark
item has break the text into runs, windows inside the runs are hashed and
looked up, and every hit is verified word by word before it counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, materialise, mix64, text_parts, words_of

N_GRAM = 13
#: The broadcast index holds at most this many benchmark words (about 250 MB);
#: a larger benchmark is scanned in several passes of at most this size.
MAX_INDEX_WORDS = 2_000_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

REPORT = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
)


@dataclass
class BenchmarkIndex:
    """vocab: word -> id from 1; for each window length the sorted hashes, the
    id rows in the same order, and the items of each window."""

    vocab: dict[bytes, int]
    windows: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[str, ...]]]]
    base: int

    @classmethod
    def build(cls, items: list[tuple[str, bytes]], n: int = N_GRAM) -> BenchmarkIndex:
        vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)]
            size = min(n, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                found.setdefault(tuple(ids[k : k + size]), set()).add(item)
        base = 0x9E3779B97F4A7C15
        while True:
            windows = {}
            for size in sorted({len(w) for w in found}):
                rows = sorted(w for w in found if len(w) == size)
                ids = np.array(rows, dtype=np.uint64)
                hashes = _hash(ids.T, base)
                order = np.argsort(hashes)
                windows[size] = (hashes[order], ids[order], [tuple(sorted(found[rows[k]])) for k in order])
            if all(len(np.unique(h)) == len(h) for h, _, _ in windows.values()):
                return cls(vocab, windows, base)
            base += 2  # two windows share a hash: hash anew


def _hash(columns, base: int) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out = out * np.uint64(base) + c
    return mix64(out)


@dataclass
class Scan:
    """What a scan found: words of each text, hit flags of all words in one
    array (``starts`` has each text's first), and the items by text."""

    n_words: np.ndarray
    starts: np.ndarray
    hit: np.ndarray
    items: list[set[str]]


def scan(texts: list[bytes], index: BenchmarkIndex) -> Scan:
    get, ids, n_words = index.vocab.get, [], np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        w = t.translate(WORD_TABLE).split()
        n_words[k] = len(w)
        ids += map(get, w, repeat(0))
        ids.append(0)  # no window spans two texts
    all_ids = np.array(ids, dtype=np.uint64)
    starts = np.cumsum(n_words + 1) - (n_words + 1)
    step = np.zeros(len(all_ids) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    known = np.concatenate([[0], np.cumsum(all_ids != 0)])
    for size, (hashes, rows, owners) in index.windows.items():
        if len(all_ids) < size:
            continue
        at = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(at):
            continue
        h = _hash([all_ids[at + k] for k in range(size)], index.base)
        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        same = hashes[place] == h
        at, place = at[same], place[same]
        same = (all_ids[at[:, None] + np.arange(size)] == rows[place]).all(axis=1)
        at, place = at[same], place[same]
        np.add.at(step, at, 1)
        np.add.at(step, at + size, -1)
        of = np.searchsorted(starts, at, side="right") - 1
        for doc, window in {*zip(of.tolist(), place.tolist())}:
            items[doc].update(owners[window])
    return Scan(n_words, starts, np.cumsum(step[:-1]) > 0, items)


def _verdict(n_hit: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _hits(s: Scan) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(s.hit)])
    return total[s.starts + s.n_words] - total[s.starts]


def cut_spans(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its hit words and what stands between two of them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for k in np.flatnonzero(hit):
        a, b = spans[k]
        if k and hit[k - 1]:
            a = spans[k - 1][1]
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def load_indexes(benchmark: DataFrame, n: int = N_GRAM, most: int = MAX_INDEX_WORDS) -> Iterator[BenchmarkIndex]:
    """Indexes of at most ``most`` words together holding the whole benchmark,
    one after the other: the driver holds two at most. The benchmark is the
    stated query set; its size is checked here."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t")
    ).where("t is not null")
    part, size = [], 0
    for r in rows.toLocalIterator():
        words = len(words_of(bytes(r.t)))
        if part and size + words > most:
            yield BenchmarkIndex.build(part, n)
            part, size = [], 0
        part.append((r.i, bytes(r.t)))
        size += words
    yield BenchmarkIndex.build(part, n)


def _pass(texts: list[bytes], index: BenchmarkIndex, before: list[tuple[bytes, list[str]]] | None) -> Scan:
    """A scan with one index, joined with what earlier passes found."""
    s = scan(texts, index)
    for k, (flags, items) in enumerate(before or ()):
        s.items[k].update(items)
        old = np.unpackbits(np.frombuffer(flags, np.uint8), count=int(s.n_words[k]))
        s.hit[s.starts[k] : s.starts[k] + s.n_words[k]] |= old.astype(bool)
    return s


def _run(docs: DataFrame, benchmark: DataFrame, n: int, finish, schema) -> DataFrame:
    """``finish(batch, texts, scan) -> batch`` over a scan of ``docs`` with the
    whole benchmark. A benchmark of one index takes one pass; a larger one takes
    a pass an index, with the finds so far kept in a table between passes, so
    that no worker holds more than one index."""
    spark = docs.sparkSession
    indexes = load_indexes(benchmark, n)
    at, width, hidden = docs.columns.index("text"), len(docs.columns), None
    index, first = next(indexes), True

    while True:
        following = next(indexes, None)
        shared, last = spark.sparkContext.broadcast(index), following is None

        def run(batches, shared=shared, last=last, first=first) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, texts in text_parts(b.column(at)):
                    part = b.slice(lo, hi - lo)
                    before = None
                    if not first:
                        before = list(zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist()))
                        part = part.select(range(width))
                    s = _pass(texts, shared.value, before)
                    if last:
                        yield finish(part, texts, s)
                        continue
                    flags = [np.packbits(s.hit[a : a + m]).tobytes() for a, m in zip(s.starts, s.n_words)]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(flags, pa.binary()), pa.array([sorted(x) for x in s.items], pa.list_(pa.string()))],
                        [*part.schema.names, *hidden],
                    )

        if last:
            return docs.mapInArrow(run, schema)
        if hidden is None:
            hidden = _fresh(docs, "hit_flags", "hit_items")
            kept = T.StructType(
                [*docs.schema.fields, T.StructField(hidden[0], T.BinaryType()), T.StructField(hidden[1], T.ArrayType(T.StringType()))]
            )
        docs = materialise(docs.mapInArrow(run, kept), "benchmark-pass")
        shared.destroy()
        index, first = following, False


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for x in names:
        while x in taken:
            x = "_" + x
        out.append(x)
    return out


def report(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 and
    contaminated.

    Null and empty texts have no words and are clean. Repeated rows and ids are
    reported each; a null doc_id stays null. Items without words, and an empty
    benchmark, hit nothing; a null item_id counts as the empty string. Columns
    other than doc_id and text are not read, whatever their names.
    """

    def finish(part: pa.RecordBatch, texts: list[bytes], s: Scan) -> pa.RecordBatch:
        hits = _hits(s)
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(s.n_words),
                pa.array(hits),
                pa.array([len(x) for x in s.items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in s.items], pa.string()),
                pa.array(_verdict(hits, s.n_words)),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _run(docs.select("doc_id", "text"), benchmark, n, finish, f"doc_id {kind}, {REPORT}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", n: int = N_GRAM) -> DataFrame:
    """``docs``, all columns, cleaned of benchmark text.

    ``drop`` removes contaminated rows and leaves the others as they are;
    ``cut`` keeps every row and removes the hit spans from its text. Rows whose
    text is null or has no words stay, as do all with an empty benchmark.
    Repeated rows are judged each, long texts whole; the order of columns, which
    may have any names, is kept; an empty table stays empty.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"unknown action {action!r}")
    at = docs.columns.index("text")

    def finish(part: pa.RecordBatch, texts: list[bytes], s: Scan) -> pa.RecordBatch:
        hits = _hits(s)
        if action == "drop":
            return part.filter(pa.array(~_verdict(hits, s.n_words)))
        if not hits.any():
            return part
        new = part.column(at).to_pylist()
        for k in np.flatnonzero(hits):
            a = s.starts[k]
            new[k] = cut_spans(texts[k], s.hit[a : a + s.n_words[k]]).decode()
        columns = part.columns
        columns[at] = pa.array(new, part.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return _run(docs, benchmark, n, finish, docs.schema)
