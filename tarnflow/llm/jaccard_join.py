"""Similarity self-join on word shingles by chosen paths.

Texts become sets of hashed five-word shingles; equal sets are one class. Each
class is embedded by minhashing into a list of sampled tokens. A run descends a
tree: a node samples two positions of that list, and classes that share the
token at a position meet in the child for it. Small buckets are compared by
brute force; larger ones are split again, on further positions, as long as that
leaves less to compare. A group of near copies does not get smaller that way: it
stays one bucket, compared in blocks of bounded size. Several runs with other
positions bring a pair's chance to meet near one:

    a pair of similarity s misses a level-1 bucket with (1 - s) ** (2 * RUNS)
    (2.6e-6 at 0.8), and through split buckets, of depth 3, one run with 0.06
    at most, all runs with 1e-5.

Every pair is examined in one bucket only: the first, in the order of the tree,
that both are in. Candidates by sketch are then verified on the shingles
themselves. Buckets give back link counts and spanning edges, never pairs. A
group of up to BLOCK near copies costs each of them one row a level-1 bucket; in
a larger one a class is in as many rows as its bucket has blocks. That is no more
than splitting would take: copies of similarity 0.63 to each other would need
n ** 0.48 rows each (the exponent log 0.8 / log 0.63 of chosen paths).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, mix64, new_names, shingles_of, text_parts, trim
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Length of the embedding; 16 bits are kept of each position.
POSITIONS = 128
RUNS = 4
DEPTH = 3
#: A bucket of more classes is split if its children then have at most PAYS of
#: its pairs; otherwise, and at the last level, it is compared in blocks of at
#: most BLOCK classes and BLOCK_SHINGLES shingles (8 bytes each) on average. A
#: bucket of up to BLOCK classes is one block: each of them is there once.
BUCKET = 400
PAYS = 0.5
BLOCK = 2000
BLOCK_SHINGLES = 2_000_000
#: Large buckets (some 40 bytes each) that may be broadcast.
MAX_LARGE = 500_000
#: Sketch agreement (of 128) below which a pair of similarity 0.8 does not fall
#: but once in 3 million: the mean less five deviations.
MARGIN = 5.0

_SEEDS = mix64(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_NAMES = ["key", "n", "sketch"]


def _tree() -> tuple[list[tuple[int, ...]], list[int]]:
    """Slots of all runs, level by level: each is the positions on its path; and
    the parent of each slot (-1: the root of a run)."""
    order = np.random.default_rng(17)
    slots, parents, last = [], [], [((), -1)] * RUNS
    for _ in range(DEPTH):
        level = []
        for path, parent in last:
            free = order.permutation([p for p in range(POSITIONS) if p not in path])
            for p in free[:2]:
                slots.append((*path, int(p)))
                parents.append(parent)
                level.append((slots[-1], len(slots) - 1))
        last = level
    # Level-1 positions of all runs differ, so that no run repeats another.
    first = order.permutation(POSITIONS)[: 2 * RUNS]
    swap = {k: int(p) for k, p in enumerate(first)}
    fixed = []
    for k, path in enumerate(slots):
        root = k
        while parents[root] >= 0:
            root = parents[root]
        fixed.append(tuple(dict.fromkeys((swap[root], *(p for p in path[1:])))))
    return fixed, parents


SLOTS, PARENTS = _tree()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Minhashes: for each position the least of the shingles' hashes there."""
    out = np.empty(POSITIONS, dtype=np.uint64)
    for lo in range(0, POSITIONS, 16):
        h = shingles[None, :] * _SEEDS[lo : lo + 16, None]
        h ^= h >> np.uint64(31)
        out[lo : lo + 16] = h.min(axis=1)
    return (mix64(out) & np.uint64(0xFFFF)).astype("<u2")


def node_ids(sketches: np.ndarray, slots: list[int]) -> np.ndarray:
    """The node of each sketch (rows) at each slot (columns), as int64."""
    out = np.empty((len(sketches), len(slots)), dtype=np.uint64)
    for k, s in enumerate(slots):
        h = np.full(len(sketches), s + 1, dtype=np.uint64)
        for p in SLOTS[s]:
            h = mix64(h ^ sketches[:, p].astype(np.uint64))
        out[:, k] = h
    return out.view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, key (a 128-bit hash of the set of shingles; null without words),
    n (shingles) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sketches, seen = [], [], [], {}
            for _, _, texts in text_parts(b.column(1)):
                for t in texts:
                    s = shingles_of(t, SHINGLE)
                    key = xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None
                    if key is not None and key not in seen:
                        seen[key] = sketch(s).tobytes()
                    keys.append(key)
                    sizes.append(len(s))
                    sketches.append(seen.get(key))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
                ["doc_id", *_NAMES],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key string, n long, sketch binary")


def _nodes(classes: DataFrame, slots: list[int]) -> DataFrame:
    """(parent, slot, node, key, n) of every class at the given slots; parent is
    0, or with a column ``parents`` (array of slot and node) the nodes are the
    children of those only."""
    inner = "parents" in classes.columns
    below = {k: [c for c in slots if PARENTS[c] == k] for k in {PARENTS[c] for c in slots}}
    names = ["parent", "slot", "node", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = {s: k for k, s in enumerate(slots)}
        for b in batches:
            if not b.num_rows:
                continue
            s = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(-1, POSITIONS)
            ids = node_ids(s, slots)
            if inner:
                wanted = [(k, x["node"], c) for k, xs in enumerate(b.column(3).to_pylist()) for x in xs for c in below[x["slot"]]]
                row, parent, slot = (np.array(x, dtype=np.int64) for x in zip(*wanted))
            else:
                row, slot = np.repeat(np.arange(len(s)), len(slots)), np.tile(np.array(slots), len(s))
                parent = np.zeros(len(row), dtype=np.int64)
            node = ids[row, np.array([column[x] for x in slot.tolist()])]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parent), pa.array(slot.astype(np.int32)), pa.array(node), b.column(0).take(at), b.column(1).take(at)], names
            )

    columns = ["key", "n", "sketch", *["parents"] * inner]
    return classes.select(*columns).mapInArrow(run, "parent long, slot int, node long, key string, n long")


def _placed(members: DataFrame, sized: DataFrame) -> DataFrame:
    """``members`` of the buckets in ``sized`` (node, size, shingles). Members of
    large buckets do not meet in one task: these buckets are broadcast, or, where
    they are too many, salted."""
    large = bounded(sized.where(F.col("size") > BUCKET), MAX_LARGE)
    if large is not None:
        there = members.join(F.broadcast(large), "node")
        rest = members.join(F.broadcast(large.select("node")), "node", "left_anti")
    else:
        salts = 64
        salted = sized.where(F.col("size") > BUCKET).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keyed = members.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
        both = keyed.join(salted, ["node", "_salt"], "left").drop("_salt")
        there, rest = both.where("size is not null"), both.where("size is null").drop("size", "shingles")
    return there.unionByName(rest.join(sized.where(F.col("size") <= BUCKET), "node"))


def _sized(members: DataFrame) -> DataFrame:
    return members.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))


def _buckets(classes: DataFrame) -> DataFrame:
    """(slot, node, key, size, shingles): the buckets to compare, of two classes
    or more. Only classes of buckets that are split go a level deeper, and only
    into the children of these buckets. ``classes`` is a stored table."""
    rows = 2 * RUNS * classes.count()
    level = [k for k, p in enumerate(PARENTS) if p < 0]
    members = _nodes(classes, level)
    here = _sized(members).where("size > 1").drop("parent")
    found = materialise(_placed(members.drop("parent", "n"), here), "level1", rows)
    leaves = None
    for depth in range(1, DEPTH + 1):
        large = found.where(F.col("size") > BUCKET)
        if depth == DEPTH or large.isEmpty():
            return found if leaves is None else leaves.unionByName(found)
        level = [k for k, p in enumerate(PARENTS) if p in set(level)]
        parents = large.groupBy("key").agg(F.collect_list(F.struct("slot", "node")).alias("parents"))
        members = materialise(_nodes(classes.join(parents, "key"), level), f"children{depth}", rows)
        sized = _sized(members)
        pairs = lambda c: F.col(c) * (F.col(c) - 1)
        left = sized.groupBy(F.col("parent").alias("node")).agg(F.sum(pairs("size")).alias("_left"))
        whole = large.groupBy("node").agg(F.first("size").alias("_size"))
        split = left.join(whole, "node").where(F.col("_left") <= PAYS * pairs("_size")).select("node")
        few = bounded(split, MAX_LARGE)
        split = materialise(split, "split") if few is None else F.broadcast(few)
        stay = found.join(split, "node", "left_anti").select(*found.columns)
        leaves = stay if leaves is None else leaves.unionByName(stay)
        inner = split.withColumnRenamed("node", "parent")
        below = sized.where("size > 1").join(inner, "parent", "left_semi").drop("parent")
        members = members.join(inner, "parent", "left_semi")
        found = materialise(_placed(members.drop("parent", "n"), below).select(*found.columns), f"level{depth + 1}", rows)
    return leaves


def _shared_before(sk_a, sk_b, mask_a, mask_b, slot: int) -> np.ndarray:
    """Whether pairs share a leaf bucket at a slot before this one."""
    same, both, out = sk_a == sk_b, mask_a & mask_b, np.zeros(len(sk_a), dtype=bool)
    for s in range(slot):
        here = (both >> np.uint64(s)) & np.uint64(1) == 1
        if here.any():
            out |= here & same[:, list(SLOTS[s])].all(axis=1)
    return out


def _candidates(sk: np.ndarray, n: np.ndarray, mask: np.ndarray, block: np.ndarray, cross: bool, slot: int, similarity: float):
    """Pairs (i, j) of a bucket that the sketches leave open and that no earlier
    bucket has; ``cross``: only pairs between the two blocks."""
    need = POSITIONS * similarity - MARGIN * np.sqrt(POSITIONS * similarity * (1 - similarity))
    left, right = [], []
    for i in range(len(sk) - 1):
        j = np.arange(i + 1, len(sk))
        keep = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
        if cross:
            keep &= block[j] != block[i]
        j = j[keep]
        j = j[(sk[j] == sk[i]).sum(axis=1) >= need]
        left.append(np.full(len(j), i, dtype=np.int32))
        right.append(j.astype(np.int32))
    i, j = np.concatenate(left), np.concatenate(right)
    new = np.ones(len(i), dtype=bool)
    for lo in range(0, len(i), 20_000):
        a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
        new[lo : lo + 20_000] = ~_shared_before(sk[a], sk[b], mask[a], mask[b], slot)
    return i[new], j[new]


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal values of ``names`` in sorted batches."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(x).to_pylist() for x in names]
        keys = list(zip(*columns))
        lo = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[lo]:
                if held and keys[lo] != last:
                    yield last, held
                    held = []
                held.append(b.slice(lo, k - lo))
                last, lo = keys[lo], k
    if held:
        yield last, held


def _tasks(leaves: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows to compare: (slot, node, x, y) names a bucket, or a pair of
    blocks of one that is too large; each class with its sketch and its leaves."""
    masks = leaves.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("mask"))
    full = classes.join(masks, "key")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    placed = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "slot", "node", "key", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
    )
    return paired.join(full, "key").select("slot", "node", "x", "y", "block", "key", "n", "mask", "sketch")


def _sorted_by_bucket(df: DataFrame) -> DataFrame:
    return df.repartition("slot", "node", "x", "y").sortWithinPartitions("slot", "node", "x", "y", "key")


_BUCKET = ["slot", "node", "x", "y"]


def _arrays(parts: list[pa.RecordBatch]):
    t = pa.Table.from_batches(parts)
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(-1, POSITIONS)
    return t, sk, t.column("n").to_numpy(), t.column("mask").to_numpy().astype(np.uint64), t.column("block").to_numpy()


def _with_candidates(tasks: DataFrame, similarity: float) -> DataFrame:
    """Of ``tasks`` the rows that are in a candidate pair of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (slot, _, x, y), parts in _groups(batches, _BUCKET):
            t, sk, n, mask, block = _arrays(parts)
            if len(n) < 2:
                continue
            i, j = _candidates(sk, n, mask, block, x != y, slot, similarity)
            if len(i):
                yield from t.take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()
        trim()

    return _sorted_by_bucket(tasks).mapInArrow(run, tasks.schema)


def links_of(shingles: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs have this Jaccard similarity: exact."""
    size = np.array([len(s) for s in shingles])
    if len(i) <= 4 * len(shingles):
        common = np.array([len(np.intersect1d(shingles[a], shingles[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    else:  # a dense group: counts of common shingles by matrix products
        owner = np.repeat(np.arange(len(shingles)), size)
        _, column, df = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
        shared = df[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((len(shingles), len(shingles)), dtype=np.float32)
        width = 2048
        for lo in range(0, int(column.max(initial=-1)) + 1, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((len(shingles), width), dtype=np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            total += part @ part.T
        common = total[i, j].astype(np.int64)
    return common >= similarity * (size[i] + size[j] - common) - 1e-9


def _verified(tasks: DataFrame, similarity: float) -> DataFrame:
    """(key, root, links, linked_docs) by bucket: exact links of each class, and
    an edge to the least class of its part of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (slot, _, x, y), parts in _groups(batches, _BUCKET):
            t, sk, n, mask, block = _arrays(parts)
            i, j = _candidates(sk, n, mask, block, x != y, slot, similarity)
            if not len(i):
                continue
            shingles = [np.frombuffer(s, "<u8") for s in t.column("shingles").to_pylist()]
            good = links_of(shingles, i, j, similarity)
            i, j = i[good], j[good]
            if not len(i):
                continue
            docs, keys = t.column("n_docs").to_numpy(), t.column("key").to_pylist()
            both, other = np.concatenate([i, j]), np.concatenate([j, i])
            links = np.bincount(both, minlength=len(n))
            linked = np.bincount(both, weights=docs[other], minlength=len(n)).astype(np.int64)
            root = np.arange(len(n))
            while True:  # least index reached, by pointer jumping
                low = root.copy()
                np.minimum.at(low, both, root[other])
                low = np.minimum(low, low[low])
                if (low == root).all():
                    break
                root = low
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[k] for k in at], pa.string()),
                    pa.array([keys[k] for k in root[at]], pa.string()),
                    pa.array(links[at].astype(np.int64)),
                    pa.array(linked[at]),
                ],
                ["key", "root", "links", "linked_docs"],
            )
        trim()

    return _sorted_by_bucket(tasks).mapInArrow(run, "key string, root string, links long, linked_docs long")


def _shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the wanted classes, from one document of each. Rows of
    one doc_id may have different texts: only the class's own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in text_parts(b.column(1)):
                shingles = [shingles_of(t, SHINGLE).tobytes() for t in texts]
                good = [k == xxhash.xxh3_128_hexdigest(s) for k, s in zip(b.column(0)[lo:hi].to_pylist(), shingles)]
                out = pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(shingles, pa.binary())], ["key", "shingles"])
                yield out.filter(pa.array(good, pa.bool_()))

    return docs.join(wanted, "doc_id").select("key", "text").mapInArrow(run, "key string, shingles binary")


def classes_and_links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Two tables. ``members``: doc_id, key of every row. ``classes``: key,
    first (least doc_id), n_docs, group (root key), links and linked_docs."""
    docs = docs.select("doc_id", "text")
    rows = docs.count()  # hints are multiples of it: heavy rows get more files
    found = materialise(sets(docs), "sets", 40 * rows)
    members = found.select("doc_id", "key")
    classes = found.where("key is not null").groupBy("key").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_docs")
    )
    classes = materialise(classes, "classes", 4 * rows)
    tasks = _tasks(_buckets(classes), classes.select("key", "n", "sketch"))
    tasks = materialise(_with_candidates(tasks, similarity), "candidates", 8 * RUNS * rows)
    wanted = tasks.select("key").distinct().join(classes.select("key", "n_docs", F.col("first").alias("doc_id")), "key")
    wanted = materialise(wanted, "wanted", rows)
    # A null doc_id names no row to fetch; such classes are fetched by key.
    by_key = wanted.where("doc_id is null").select("key")
    near = wanted.where("doc_id is not null").select("doc_id", "key")
    small = wanted.count() <= 500_000  # some 50 bytes a row
    text = _shingles(docs, F.broadcast(near) if small else near)
    if not by_key.isEmpty():
        text = text.unionByName(_shingles_by_key(docs.where("doc_id is null"), by_key))
    text = text.dropDuplicates(["key"])
    full = tasks.join(text, "key").join(wanted.select("key", "n_docs"), "key")
    links = materialise(_verified(full, similarity), "links", 8 * RUNS * rows)
    roots = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("key").agg(F.sum("links").alias("links"), F.sum("linked_docs").alias("linked_docs"))
    out = (
        classes.select("key", "first", "n_docs")
        .join(sums, "key", "left")
        .join(roots.select(F.col("node").alias("key"), F.col("root").alias("group")), "key", "left")
        .select("key", "first", "n_docs", F.coalesce("group", "key").alias("group"), "links", "linked_docs")
    )
    return members, out.fillna(0, ["links", "linked_docs"])


def _shingles_by_key(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, texts in text_parts(b.column(0)):
                s = [shingles_of(t, SHINGLE).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_hexdigest(x) for x in s], pa.string()), pa.array(s, pa.binary())], ["key", "shingles"]
                )

    return docs.select("text").mapInArrow(run, "key string, shingles binary").join(wanted, "key", "left_semi")


def join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_links and
    n_copies.

    Documents are linked if their sets of five-word shingles have a Jaccard
    similarity of at least ``similarity``. class_id is the least doc_id of the
    documents connected by links; copy_id the least of those with the same set;
    n_links counts the other rows linked to this one, copies included, and
    n_copies those with the same set. A text of fewer than five words is one
    shingle. Texts without words (null, empty) have no links and their own
    doc_id for class. Repeated rows and ids are rows like others. Nulls do not
    count as least ids: a class of null ids alone has a null id.
    """
    members, classes = classes_and_links(docs, similarity)
    groups = classes.groupBy("group").agg(F.min("first").alias("class_id"))
    full = classes.join(groups, "group").select(
        "key", "class_id", F.col("first").alias("copy_id"), (F.col("n_docs") - 1 + F.col("linked_docs")).alias("n_links"), (F.col("n_docs") - 1).alias("n_copies")
    )
    return members.join(full, "key", "left").select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
    )


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns as they are, with one row of each class: the one
    with the least doc_id, nulls last; of rows that share it, any one. Rows
    whose text has no words (null, empty) have no class and stay, repeated or
    not. Long texts count whole, extra columns may have any names, an empty table
    stays empty.
    """
    ids = docs.select("doc_id")
    if ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = join(docs, similarity)
        gone = materialise(found.where("doc_id <> class_id").select("doc_id"), "dropped", docs.count())
        few = gone.count() <= 1_000_000  # 8 bytes a row and the hash table
        return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # Ids do not tell rows apart: each gets a number, which is stored with it.
    (serial,) = new_names(docs, "serial")
    numbered = materialise(docs.withColumn(serial, F.monotonically_increasing_id()), "numbered")
    ids = numbered.select(F.col(serial).alias("_id"), F.struct(F.col("doc_id").isNull(), "doc_id", F.col(serial).alias("_id")).alias("_order"))
    found = join(numbered.select(F.col(serial).alias("doc_id"), "text"), similarity)
    found = found.select(F.col("doc_id").alias("_id"), "class_id").join(ids, "_id")
    kept = found.groupBy("class_id").agg(F.min("_order")["_id"].alias(serial))
    kept = materialise(kept, "kept")
    return numbered.join(kept, serial, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
