"""Best-two-fit packing of token pieces into sequences of fixed capacity.

Packing needs only lengths, and there are at most ``capacity`` different ones.
So the bins are filled over the *histogram* of lengths, on the driver, whatever
the corpus size: each bin drawn there is a pattern of lengths and is repeated
for as long as the histogram can supply it. Pieces then take the places of the
patterns by their rank among pieces of the same length, which distributes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_parts, trim
from .tokens import TOKENIZER, encoder

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are ranked in groups of about this many rows.
GROUP_ROWS = 2_000_000
_END = np.array([END_ID], dtype="<u4").tobytes()


@dataclass
class Slot:
    """Ranks ``lo`` to ``hi`` - 1 of the pieces of ``length``: ``each`` of them
    in turn go to a sequence, from ``first`` on, beginning at ``offset``."""

    length: int
    lo: int
    hi: int
    each: int
    first: int
    offset: int


def _best_pair(lengths: np.ndarray, counts: np.ndarray, most: int) -> tuple[int, int] | None:
    """Two available lengths with the largest sum up to ``most``."""
    a = lengths[(lengths < most) & (counts > 0)]
    if not len(a):
        return None
    k = np.searchsorted(a, most - a, side="right") - 1
    twice = dict(zip(lengths.tolist(), counts.tolist()))
    best = None
    for x, j in zip(a.tolist(), k.tolist()):
        if j >= 0 and a[j] == x and twice[x] < 2:
            j -= 1
        if j >= 0 and (best is None or x + int(a[j]) > sum(best)):
            best = (x, int(a[j]))
    return best


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int]:
    """Slots for all pieces of a histogram {length: pieces}, and the number of
    sequences.

    A bin starts with the longest piece left and takes the longest that fits
    until none does. Then its smallest piece gives way to two unpacked ones if
    they fill the gap it leaves more tightly, again and again while that helps.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), dtype=np.int64)
    left = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    if len(lengths) and (lengths[0] < 1 or lengths[-1] > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    taken = {int(k): 0 for k in lengths}
    slots, sequences = [], 0
    while len(lengths):
        used = np.zeros(len(lengths), dtype=np.int64)
        gap = capacity
        top = len(lengths)
        while True:  # greedy: longest piece that fits
            top = min(top, int(np.searchsorted(lengths, gap, side="right")))
            while top and left[top - 1] == used[top - 1]:
                top -= 1
            if not top:
                break
            n = min(int(gap // lengths[top - 1]), int(left[top - 1] - used[top - 1]))
            used[top - 1] += n
            gap -= n * int(lengths[top - 1])
        while gap:  # one piece out, two in
            low = int(np.flatnonzero(used)[0])
            out = int(lengths[low])
            pair = _best_pair(lengths, left - used, gap + out)
            if pair is None or sum(pair) <= out:
                break
            used[low] -= 1
            for x in pair:
                used[np.searchsorted(lengths, x)] += 1
            gap += out - sum(pair)
        inside = np.flatnonzero(used)
        times = int((left[inside] // used[inside]).min())
        offset = 0
        for k in inside[::-1]:
            size, each = int(lengths[k]), int(used[k])
            slots.append(Slot(size, taken[size], taken[size] + times * each, each, sequences, offset))
            taken[size] += times * each
            offset += each * size
        left -= used * times
        sequences += times
        keep = left > 0
        lengths, left = lengths[keep], left[keep]
    return slots, sequences


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """The token pieces of every row: doc_id, piece, start, length, ids_crc32
    and, if asked for, ids (little-endian uint32 bytes).

    A document is its ids and then the end id; only one longer than the capacity
    is cut. Null and empty texts are the end id alone. Repeated rows are packed
    each; a null doc_id stays null. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = encoder(tokenizer), 4 * capacity
        for b in batches:
            for lo, _, texts in text_parts(b.column(1)):
                of, piece, parts = [], [], []
                for k, ids in enumerate(enc.encode(texts), lo):
                    ids += _END
                    for p, at in enumerate(range(0, len(ids), width)):
                        of.append(k)
                        piece.append(p)
                        parts.append(ids[at : at + width])
                number = np.array(piece, dtype=np.int32)
                columns = [
                    b.column(0).take(pa.array(of, pa.int64())),
                    pa.array(number),
                    pa.array(number.astype(np.int64) * capacity),
                    pa.array([len(x) >> 2 for x in parts], pa.int64()),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        enc.rest()
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with a column length) and, for each row, sequence_id and
    offset. ``parts`` is read three times and must be a stored table; a column
    _spread in it, if any, parts rows that are equal otherwise, and is dropped."""
    spark = parts.sparkSession
    total = parts.count()
    salts = max(16, min(4096, total // GROUP_ROWS))
    own = [c for c in parts.columns if c != "_spread"]
    order = ["doc_id", "piece", "ids_crc32", *["_spread"] * (len(own) < len(parts.columns))]
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots, _ = best_two_fit(histogram, capacity)
    # At most capacity x salts rows, whatever the number of pieces.
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)),
    )
    ranked = ranked.join(F.broadcast(groups) if salts <= 64 else groups, ["length", "_salt"]).withColumn(
        "_rank", F.col("_before") + F.col("_rank") - 1
    )
    plan = spark.createDataFrame(
        [(s.length, s.lo, s.hi, s.each, s.first, s.offset) for s in slots],
        "_length long, _lo long, _hi long, _each long, _first long, _offset long",
    )
    # Bounded by the capacity: some thousands of patterns of a few lengths each.
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    at = F.col("_rank") - F.col("_lo")
    return ranked.join(F.broadcast(plan), inside).select(
        *own,
        (F.col("_first") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (see ``pieces``) with their sequence_id and offset.
    An empty table packs into none."""
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int")
    return place(materialise(pieces(docs, capacity, tokenizer, with_ids).withColumn("_spread", spread), "pieces", 40 * docs.count()), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence, from ``pack(..., with_ids=True)``: its ids (bytes)
    and number of tokens. A group here holds at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
