"""Language-model scores from a log-frequency Bloom filter.

Training n-grams are hashed, counted by slices of the hash space, and their
counts quantised on a logarithmic scale: an n-gram of level q is stored as q
entries, (n-gram, 1) to (n-gram, q), in a Bloom filter that each slice builds for
itself. Workers get the filters by broadcast and find an n-gram's level by
probing (n-gram, 1), (n-gram, 2), ... until one is missing. Probabilities are
interpolated from order to order with a Dirichlet prior:

    P(w | h) = (c(h w) + MU * P(w | shorter h)) / (c(h) + MU)

down to (c(w) + 0.5) / (N + 0.5 (V + 1)). The exact unigram score that is given
beside it takes the counts of frequent words from a broadcast table of bounded
size and those of all other words from a join by slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX, forget, hash_words, materialise, mix64, text_parts, trim

ORDER = 2
MU = 500.0
LEVEL_BASE = 1.25
BITS_PER_ENTRY = 10
#: Filters broadcast at once. A larger model is scored in several passes.
MAX_FILTER_BYTES = 256 << 20
#: Words in the broadcast table of exact counts (12 bytes each).
MAX_FREQUENT = 1 << 20
#: A slice has about this many training tokens, whatever their number.
SLICE_TOKENS = 500_000
MIN_SLICES = 256
#: Runs of slices whose filter sizes the driver adds up.
MAX_BINS = 16_384
#: N-grams or rare words that a task gathers before it hands them on.
FLUSH = 1_000_000
#: Bytes of text scored at once.
CHUNK = 1 << 20
_END = hash_words([b" "])[0]  # no word has a space


def level_bounds(most: int = 1 << 50, base: float = LEVEL_BASE) -> np.ndarray:
    """The smallest count of each level: 1, 2, 3, ... and then by factors."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * base)))
    return np.array(out, dtype=np.int64)


_BOUNDS = level_bounds()
#: The count that a level stands for: the middle of its range, 0 for level 0.
_VALUES = np.concatenate([[0.0], np.sqrt(_BOUNDS[:-1] * (_BOUNDS[1:] - 1.0))])


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_BOUNDS, counts, side="right")


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash, from its upper 24 bits."""
    return ((h >> np.uint64(40)) * np.uint64(slices) >> np.uint64(24)).astype(np.int64)


def _entry(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First point and step, of 32 bits, of the probes for (key, level)."""
    e = mix64(keys + np.full(1, level, np.uint64) * MIX)
    return (e >> np.uint64(32)).astype(np.uint32), e.astype(np.uint32) | np.uint32(1)


def _places(points: np.ndarray, bits) -> np.ndarray:
    """Points of 32 bits spread over ``bits`` places, without a division."""
    return points.astype(np.uint64) * bits >> np.uint64(32)


def build_filter(keys: np.ndarray, counts: np.ndarray, most_bytes: int, bits: float = BITS_PER_ENTRY) -> tuple[bytes, int]:
    """The Bloom filter of one slice and its number of probes an entry."""
    levels = levels_of(counts)
    entries = int(levels.sum())
    size = max(8, min(-(-int(entries * bits) // 8), most_bytes))
    probes = max(1, min(12, round(8 * size / max(entries, 1) * np.log(2))))
    field = np.zeros(8 * size, dtype=bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        at, step = _entry(keys[levels >= q], q)
        for _ in range(probes):
            field[_places(at, np.uint64(8 * size)).astype(np.int64)] = True
            at = at + step
    return np.packbits(field, bitorder="little").tobytes(), probes


@dataclass
class Filters:
    """Filters of some slices; ``sizes`` is 0 for slices that are elsewhere."""

    field: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    probes: np.ndarray

    @classmethod
    def join(cls, slices: int, parts: dict[int, tuple[bytes, int]]) -> Filters:
        sizes, probes = np.zeros(slices, np.int64), np.zeros(slices, np.int64)
        for s, (data, k) in parts.items():
            sizes[s], probes[s] = len(data), k
        data = b"".join(parts[s][0] for s in sorted(parts))
        return cls(np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, sizes, probes)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram hash: probes (h, 1), (h, 2), ..."""
        out = np.zeros(len(h), dtype=np.int64)
        s = slice_of(h, len(self.sizes))
        live = np.flatnonzero(self.sizes[s])
        s, keys, level = s[live], h[live], 1
        bits, begin, probes = (8 * self.sizes[s]).astype(np.uint64), (8 * self.begins[s]).astype(np.uint64), self.probes[s]
        most = int(probes.max(initial=0))
        same = bool((probes == most).all())
        while len(live):
            at, step = _entry(keys, level)
            for j in range(most):
                place = _places(at, bits) + begin
                seen = (self.field[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                if not same:
                    seen |= j >= probes
                if not seen.all():
                    live, keys, at, step, bits, begin = live[seen], keys[seen], at[seen], step[seen], bits[seen], begin[seen]
                    if not same:
                        probes = probes[seen]
                    if not len(live):
                        return out
                at = at + step
            out[live] = level
            level += 1
        return out

    def counts(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0)
        return _VALUES[self.distinct_levels(h)]

    def distinct_levels(self, h: np.ndarray) -> np.ndarray:
        """As ``levels``, with one look-up for each distinct hash."""
        unique, back = np.unique(h, return_inverse=True)
        return self.levels(unique)[back]


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in a row, each text followed by the end token and
    the first one led by it; and the tokens of each text."""
    words, n = [], np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        w = t.lower().split()
        n[k] = len(w) + 1
        words += w
        words.append(b" ")
    return np.concatenate([[_END], hash_words(words)]), n


def _ngrams(tokens: np.ndarray, n: int) -> np.ndarray:
    """For each token after the leading one, the hash of the n-gram that ends
    there. Across a text's start the context is the end token before it."""
    lead = np.full(n - 1, _END, dtype=np.uint64)
    row = np.concatenate([lead[1:], tokens]) if n > 1 else tokens[1:]
    if n == 1:
        return row
    out = np.zeros(len(row) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * MIX + row[k : k + len(out)]
    return mix64(out)


def _log_p(counts: list[np.ndarray], norm: float, mu: float) -> np.ndarray:
    """The log10 probability of each token, from the counts of the n-grams that
    end there, by order. The last token is an end token, as is the leading one."""
    p = (counts[0] + 0.5) / norm
    context = np.concatenate([counts[0][-1:], counts[0][:-1]])
    for own in counts[1:]:
        c = np.minimum(own, context)
        p = np.where(context > 0, (c + mu * p) / (context + mu), p)
        context = np.concatenate([[0.0], c[:-1]])
    return np.log10(p)


def _pack(slices: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Per slice, its keys (8 bytes each) and their counts (4 bytes each)."""
    order = np.argsort(slices, kind="stable")
    slices, keys, counts = slices[order], keys[order], counts[order]
    cuts = np.flatnonzero(np.diff(slices)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(slices)]):
        if hi > lo:
            yield int(slices[lo]), keys[lo:hi].astype("<u8").tobytes() + counts[lo:hi].astype("<u4").tobytes()


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the blobs, sorted, and their total counts."""
    keys, counts = [], []
    for b in blobs:
        n = len(b) // 12
        keys.append(np.frombuffer(b, "<u8", n))
        counts.append(np.frombuffer(b, "<u4", n, 8 * n))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is not learned from; a null id is the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def train(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, int]:
    """A stored table with a row for each slice that has training tokens, and
    the number of slices. Columns: slice, n_tokens, n_words, words (keys and
    exact counts of the words), filters and probes (by order)."""
    learn = docs.where(~held_out()).select("text")
    size = learn.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(MIN_SLICES, int(size / 6 / SLICE_TOKENS) + 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]

        def out() -> pa.RecordBatch:
            rows = []
            for k, parts in enumerate(held):
                if parts:
                    h, n = np.unique(np.concatenate(parts), return_counts=True)
                    rows += [(s, k + 1, blob) for s, blob in _pack(slice_of(h, slices), h, n)]
                parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                ["slice", "n", "blob"],
            )

        size = 0
        for b in batches:
            for _, _, texts in text_parts(b.column(0), CHUNK):
                tokens, _ = _tokens(texts)
                for k in range(order):
                    held[k].append(_ngrams(tokens, k + 1))
                size += len(tokens)
                if size > FLUSH:
                    yield out()
                    size = 0
        if size:
            yield out()
        trim()

    def build(group: pa.Table) -> pa.Table:
        by_order: dict[int, list[bytes]] = {}
        for n, blob in zip(group.column("n").to_pylist(), group.column("blob").to_pylist()):
            by_order.setdefault(n, []).append(blob)
        filters, probes = [], []
        words, counts = _unpack(by_order.get(1, []))
        for n in range(1, order + 1):
            data, k = build_filter(*(_unpack(by_order.get(n, [])) if n > 1 else (words, counts)), 1 << 62)
            filters.append(data)
            probes.append(k)
        table = words.tobytes() + counts.tobytes()
        return pa.table(
            {
                "slice": pa.array([group.column("slice")[0].as_py()], pa.int32()),
                "n_tokens": pa.array([int(counts.sum())], pa.int64()),
                "n_words": pa.array([len(words)], pa.int64()),
                "words": pa.array([table], pa.binary()),
                "filters": pa.array([filters], pa.list_(pa.binary())),
                "probes": pa.array([probes], pa.list_(pa.int32())),
            }
        )

    model = (
        learn.mapInArrow(gather, "slice int, n int, blob binary")
        .groupBy("slice")
        .applyInArrow(build, "slice int, n_tokens long, n_words long, words binary, filters array<binary>, probes array<int>")
    )
    return materialise(model, "ngrams"), slices


def _words(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n)


def frequent_words(model: DataFrame, slices: int, most: int = MAX_FREQUENT) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count such that at most ``most`` words have it, the hashes of
    these words (sorted) and their counts."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(len(_BOUNDS) + 1, np.int64)
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n += np.bincount(levels_of(_words(blob, k)[1]), minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["level", "n"])

    by_level = model.select("n_words", "words").mapInArrow(histogram, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    least, total = 1 << 62, 0
    for r in sorted(by_level.collect(), reverse=True):  # at most a few hundred levels
        if total + r.n > most:
            break
        least, total = int(_BOUNDS[r.level - 1]), total + r.n

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, counts = [], []
            for k, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                w, c = _words(blob, k)
                keys.append(w[c >= least].tobytes())
                counts.append(c[c >= least].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["slice", "k", "c"])

    keys, counts = [], []
    for r in sorted(model.select("slice", "n_words", "words").mapInArrow(pick, "slice int, k binary, c binary").collect()):
        # Slices follow the order of the hashes, so the whole is sorted.
        keys.append(np.frombuffer(bytes(r.k), np.uint64))
        counts.append(np.frombuffer(bytes(r.c), np.int64))
    none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return least, np.concatenate(keys or none[0]), np.concatenate(counts or none[1])


def filter_segments(model: DataFrame, slices: int, order: int, most: int) -> list[tuple[int, int]]:
    """(first, last) slices of segments whose filters, of all orders together,
    have at most ``most`` bytes (or are of one slice), in order. The driver gets
    a row for each of MAX_BINS runs of slices at most, and one for each segment."""
    need = sum(F.octet_length(F.col("filters")[k]) for k in range(order))
    width = -(-slices // MAX_BINS)
    sized = model.select("slice", F.floor(F.col("slice") / width).alias("bin"), need.cast("long").alias("need"))
    total, largest, before = 0, 0, []
    for r in sized.groupBy("bin").agg(F.sum("need").alias("need"), F.max("need").alias("largest")).orderBy("bin").collect():
        before.append((r.bin, total))
        total, largest = total + r.need, max(largest, r.largest)
    if total <= most:
        return [(0, slices - 1)]
    starts = model.sparkSession.createDataFrame(before, "bin long, before long")
    upto = F.col("before") + F.sum("need").over(Window.partitionBy("bin").orderBy("slice"))
    # By where a slice ends: one that begins in the segment before adds a part
    # of itself, so that much is left free.
    at = F.floor((upto - 1) / max(1, most - largest))
    found = sized.join(F.broadcast(starts), "bin").select("slice", at.alias("at")).groupBy("at").agg(F.min("slice").alias("lo"), F.max("slice").alias("hi"))
    return sorted((r.lo, r.hi) for r in found.collect())


def score(docs: DataFrame, order: int = ORDER, mu: float = MU, max_filter_bytes: int = MAX_FILTER_BYTES, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (exact add-half unigram log10) and score (log10 probability).

    Learns from all rows that are not held out, and scores all. Null and empty
    texts are the end token alone. Every row counts, repeated or not. Without
    training rows every probability is that of an unknown word. Other columns
    are not read. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    model, slices = train(docs, order)
    total, distinct = model.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    least, keys, counts = frequent_words(model, slices, max_frequent)
    frequent = spark.sparkContext.broadcast((keys, counts))
    norm = total + 0.5 * (distinct + 1)

    segments = filter_segments(model, slices, order, max_filter_bytes)

    def fetch(k: int, ends: tuple[int, int]) -> Filters:
        rows = model.where(F.col("slice").between(*ends))
        rows = rows.select("slice", F.col("filters")[k].alias("f"), F.col("probes")[k].alias("p"))
        return Filters.join(slices, {r.slice: (bytes(r.f), r.p) for r in rows.toLocalIterator()})

    single = len(segments) == 1

    def scan(first: bool, segment):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            serial = TaskContext.get().partitionId() << 36
            rare: list[np.ndarray] = []
            known_words, exact = frequent.value
            owned = segment.value

            def send() -> pa.RecordBatch:
                h, row = np.concatenate([r[0] for r in rare]), np.concatenate([r[1] for r in rare])
                rare.clear()
                at = slice_of(h, slices)
                at_order = np.argsort(at, kind="stable")
                at, h, row = at[at_order], h[at_order], row[at_order]
                cuts = np.flatnonzero(np.diff(at)) + 1
                ends = [(lo, hi) for lo, hi in zip([0, *cuts], [*cuts, len(at)])]
                blobs = [h[lo:hi].tobytes() + row[lo:hi].tobytes() for lo, hi in ends]
                return _rows(len(ends), slice=[int(at[lo]) for lo, _ in ends], blob=blobs)

            pending = 0
            for b in batches:
                for lo, hi, texts in text_parts(b.column(2), CHUNK):
                    tokens, n = _tokens(texts)
                    own = tokens[1:]
                    starts = np.cumsum(n) - n
                    grams = [own, *(_ngrams(tokens, k + 1) for k in range(1, order))]
                    if single:
                        log_p = np.add.reduceat(_log_p([f.counts(g) for f, g in zip(owned, grams)], norm, mu), starts)
                    else:
                        # Each n-gram has its level from one pass and 0 from the others.
                        log_p = None
                        levels = np.concatenate([f.distinct_levels(g) for f, g in zip(owned, grams)]).astype(np.uint8)
                        yield _rows(1, row=[serial + lo], levels=[levels.tobytes()], sizes=[n.tobytes() if first else None])
                    row = serial + np.arange(lo, hi)
                    if not first:
                        continue
                    place = np.minimum(np.searchsorted(known_words, own), max(len(known_words) - 1, 0))
                    here = known_words[place] == own if len(known_words) else np.zeros(len(own), bool)
                    c = exact[place] if len(known_words) else np.zeros(len(own))
                    yield _rows(
                        hi - lo, row=row, score=log_p, doc_id=b.column(0)[lo:hi], held_out=b.column(1)[lo:hi], n_tokens=n,
                        n_known=np.add.reduceat(here.astype(np.int64), starts),
                        base=np.add.reduceat(np.where(here, np.log10(c + 0.5), 0.0), starts) - n * np.log10(norm),
                    )
                    rare.append((own[~here], np.repeat(row, n)[~here]))
                    pending += len(rare[-1][0])
                    if pending > FLUSH:
                        yield send()
                        pending = 0
                serial += b.num_rows
            if pending:
                yield send()
            del known_words, exact, owned
            forget(frequent, segment)
            trim()

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = f"row long, score double, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, slice int, blob binary, levels binary, sizes binary"
    types = {
        "row": pa.int64(), "score": pa.float64(), "doc_id": id_type, "held_out": pa.bool_(), "n_tokens": pa.int64(),
        "n_known": pa.int64(), "base": pa.float64(), "slice": pa.int32(), "blob": pa.binary(),
        "levels": pa.binary(), "sizes": pa.binary(),
    }

    def _rows(n: int, **columns) -> pa.RecordBatch:
        arrays = []
        for name, t in types.items():
            x = columns.get(name)
            arrays.append(pa.nulls(n, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t))
        return pa.RecordBatch.from_arrays(arrays, list(types))

    source = docs.select("doc_id", held_out().alias("held_out"), "text")
    made = None
    for k, ends in enumerate(segments):
        parts = [fetch(n, ends) for n in range(order)]
        segment = spark.sparkContext.broadcast(parts)
        del parts
        part = source.mapInArrow(scan(k == 0, segment), schema)
        # Stored at once: one segment is in the workers at a time, and none later.
        part = materialise(part, "scores")
        segment.destroy()
        made = part if made is None else made.unionByName(part)
    frequent.destroy()

    def look_up(group: pa.Table) -> pa.Table:
        table, rows = {}, []
        known, exact = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for n, blob in zip(group.column("n_words").to_pylist(), group.column("blob").to_pylist()):
            if n is None:
                rows.append((np.frombuffer(blob, np.uint64, len(blob) // 16), np.frombuffer(blob, np.int64, len(blob) // 16, len(blob) // 2)))
            else:
                known, exact = _words(blob, n)
        if not rows:
            return pa.table({"row": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base": pa.array([], pa.float64())})
        h, row = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        c = np.zeros(len(h), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            c = np.where(known[place] == h, exact[place], 0)
        unique, back = np.unique(row, return_inverse=True)
        return pa.table(
            {
                "row": pa.array(unique),
                "n_known": pa.array(np.bincount(back, weights=c > 0).astype(np.int64)),
                "base": pa.array(np.bincount(back, weights=np.log10(c + 0.5))),
            }
        )

    def put_together(group: pa.Table) -> pa.Table:
        """The scores of one part of texts from its levels of all passes."""
        levels = np.zeros(len(group.column("levels")[0].as_buffer()), np.uint8)
        for x in group.column("levels"):
            levels |= np.frombuffer(x.as_buffer(), np.uint8)
        n = np.frombuffer(next(x.as_buffer() for x in group.column("sizes") if x.is_valid), np.int64)
        log_p = _log_p([_VALUES[x] for x in levels.reshape(order, -1)], norm, mu)
        return pa.table({"row": group.column("row")[0].as_py() + np.arange(len(n)), "score": np.add.reduceat(log_p, np.cumsum(n) - n)})

    rare = made.where("blob is not null").select("slice", F.lit(None).cast("long").alias("n_words"), "blob")
    rare = rare.unionByName(model.select("slice", "n_words", F.col("words").alias("blob")))
    sums = rare.groupBy("slice").applyInArrow(look_up, "row long, n_known long, base double")
    own = made.where("n_tokens is not null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    both = own.unionByName(sums, allowMissingColumns=True)
    if not single:
        parts = made.where("levels is not null").select("row", "levels", "sizes")
        both = both.unionByName(parts.groupBy("row").applyInArrow(put_together, "row long, score double"), allowMissingColumns=True)
    both = both.groupBy("row")
    out = both.agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).alias("train_tokens"), "base_score", "score")
