"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for each host, the documents that have a line
are counted; lines above the limit are boilerplate and removed; a document of
which too little is left is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, bounded, hash_words, materialise, rolling, text_parts, utf8

#: A line that more documents of a host have is boilerplate there.
MAX_DOCS = 100
#: A document must keep at least this share of its words.
MIN_LEFT = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Repeated ids (8 bytes and the hash table) that may be broadcast.
MAX_REPEATED = 1_000_000
#: The rows of a hot line are joined in this many groups.
SALTS = 16
_SYMBOLS = b"#*$%&|<>"
_HOST = "_host"


def normal_line(line: bytes) -> bytes:
    """Lower-cased words (ASCII letters, digits, non-ASCII) with one space
    between; empty for a line without any, which is never boilerplate."""
    return b" ".join(line.translate(WORD_TABLE).split())


def repeat_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside the n-word windows that are in the text more than once."""
    if len(words) <= n:
        return 0
    h = rolling(hash_words(words), n)
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    if not len(at):
        return 0
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return int((np.cumsum(step) > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def lines_of(text: bytes) -> dict[int, int]:
    """Hash of each distinct normalised line -> the words it has in the text."""
    found: dict[bytes, int] = {}
    for raw in text.split(b"\n"):
        if line := normal_line(raw):
            found[line] = found.get(line, 0) + len(raw.split())
    keys = hash_words(found).view(np.int64).tolist()
    return dict(zip(keys, found.values()))


def line_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """_host, _line, n_docs: how many distinct documents of a host have a line.
    Rows with one doc_id are one document; each row without one is one. Null and
    empty texts have no lines, and an empty table has none."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    repeated = ids.where("count > 1").select("doc_id")
    few = bounded(repeated, MAX_REPEATED)
    if few is None:
        few = materialise(repeated, "repeated")
    elif few.isEmpty():
        return _row_counts(docs, host)
    else:
        few = F.broadcast(few)
    own = docs.select("doc_id", "text", F.col(f"`{host}`").alias(host))
    once = _row_counts(own.join(few, "doc_id", "left_anti"), host)
    lines = own.join(few, "doc_id", "left_semi").select("doc_id", _host_key(host), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, texts in text_parts(b.column(2)):
                of, keys = [], []
                for k, t in enumerate(texts, lo):
                    found = lines_of(t)
                    of += [k] * len(found)
                    keys += found
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(keys, pa.int64())], ["doc_id", _HOST, "_line"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    several = lines.mapInArrow(run, f"doc_id {kind}, {_HOST} string, _line long").distinct().groupBy(_HOST, "_line").agg(F.count(F.lit(1)).alias("n_docs"))
    return once.unionByName(several).groupBy(_HOST, "_line").agg(F.sum("n_docs").alias("n_docs"))


def _row_counts(docs: DataFrame, host: str) -> DataFrame:
    """_host, _line, n_docs: how many rows of ``docs`` of a host have a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(count)
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in keys], pa.string()),
                    pa.array([x for _, x in keys], pa.int64()),
                    pa.array([count[k] for k in keys], pa.int64()),
                ],
                [_HOST, "_line", "_n"],
            )
            count.clear()
            return made

        for b in batches:
            hosts = b.column(0).to_pylist()
            for lo, hi, texts in text_parts(b.column(1)):
                for h, t in zip(hosts[lo:hi], texts):
                    count.update((h, x) for x in lines_of(t))
                if len(count) > 100_000:
                    yield out()
        if count:
            yield out()

    key = _host_key(host)
    part = docs.select(key, "text").mapInArrow(run, f"{_HOST} string, _line long, _n long")
    return part.groupBy(_HOST, "_line").agg(F.sum("_n").alias("n_docs"))


def _host_key(host: str):
    """Null is a host of its own."""
    return F.when(F.col(f"`{host}`").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(f"`{host}`").cast("string"))).alias(_HOST)


def report(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row of ``docs``: doc_id, the base measures, base_failed, n_left
    (words outside boilerplate lines) and kept.

    Null and empty texts have no words and fail the base rules. Every row is
    judged by itself; for line frequencies rows of one doc_id are one document,
    and a row without an id is one. A null host is a host. Lines are compared by
    64-bit hashes; texts are read whole. Other columns are not read. An empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 36
        for b in batches:
            for lo, hi, texts in text_parts(b.column(2)):
                of, keys, words, rows = [], [], [], []
                firsts = []
                for k in range(lo, hi):
                    lines = lines_of(texts[k - lo]) or {0: 0}
                    firsts += [True, *[False] * (len(lines) - 1)]
                    of += [k] * len(lines)
                    keys += lines
                    words += lines.values()
                    rows += [measures(texts[k - lo]), *[(None,) * 5] * (len(lines) - 1)]
                take = pa.array(of, pa.int64())
                ids = b.column(0).take(take)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([serial + k for k in of], pa.int64()),
                        ids,
                        b.column(1).take(take),
                        pa.array(keys, pa.int64()),
                        pa.array(words, pa.int64()),
                        *[pa.array(c, pa.int64()) for c in zip(*rows)],
                    ],
                    ["_row", "doc_id", _HOST, "_line", "_words", *_MEASURES],
                )
            serial += b.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_row long, doc_id {kind}, {_HOST} string, _line long, _words long, " + ", ".join(f"{c} long" for c in _MEASURES)
    lines = docs.select("doc_id", _host_key(host), "text").mapInArrow(run, schema)
    salt = F.pmod(F.col("_row"), F.lit(SALTS)).cast("int")
    common = (
        line_counts(docs, host)
        .where(F.col("n_docs") > max_docs)
        .select(_HOST, "_line", F.lit(True).alias("_common"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    joined = lines.withColumn("_salt", salt).join(common, [_HOST, "_line", "_salt"], "left")
    removed = F.sum(F.when(F.col("_common"), F.col("_words")).otherwise(0))
    per_row = joined.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in _MEASURES], removed.alias("_removed")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("_removed")
    return per_row.select(
        "doc_id", *_MEASURES, failed.alias("base_failed"), left.alias("n_left"),
        (~failed & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def strip_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id and text of every row, without the host's boilerplate lines; a
    null text stays null, an empty one empty, and an empty table gives no rows.
    Repeated rows are stripped each. The boilerplate goes to the rows by a
    shuffle join on (host, line), so that no host's list has to fit anywhere."""
    lines = docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", _host_key(host), F.posexplode_outer(F.split("text", "\n")).alias("_at", "_raw")
    )
    common = line_counts(docs, host).where(F.col("n_docs") > max_docs).select(_HOST, "_line", F.lit(True).alias("_common"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = hash_words([normal_line(x) for x in utf8(b.column("_raw"))]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys)], [*b.schema.names, "_line"])

    keyed = lines.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in lines.dtypes)}, _line long")
    left = keyed.join(common, [_HOST, "_line"], "left").where("_common is null or _raw is null")
    kept = left.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_raw"))).alias("_kept"))
    whole = keyed.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.max(F.col("_raw").isNull()).alias("_null"))
    text = F.when(~F.col("_null"), F.coalesce(F.array_join(F.transform("_kept", lambda x: x["_raw"]), "\n"), F.lit("")))
    return whole.join(kept, "_row", "left").select("doc_id", text.alias("text"))
