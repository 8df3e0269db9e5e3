"""Uniform shuffle into shards of exact size, by a communication matrix.

Rows are in blocks (by a hash of their content) and go to cells: a shard is a
run of cells, a cell a run of slots. How many rows each block sends to each cell
is drawn, exactly as a uniform permutation of all rows would distribute them,
from the multivariate hypergeometric law. Each block permutes its rows and deals
them out by those counts, rows are exchanged, and each cell permutes what it got.
Every arrangement is then equally likely and every shard has its exact size,
while no task ever holds more than a block or a cell.

The main path is DataFrame operations only. The matrix, whose size is bounded,
is drawn on the driver.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialise, new_names

SHARDS = 40
#: Blocks, and cells of a shard, at least; beyond that there is one for each
#: PART_ROWS rows. The matrix has at most MAX_PARTS x MAX_PARTS entries.
BLOCKS = 256
CELLS_PER_SHARD = 8
PART_ROWS = 2_000_000
MAX_PARTS = 4096
#: Content that more rows share is hot, or more than an even share among MAX_HOT
#: kinds of content; so many (8 bytes each) are broadcast at most.
HOT_ROWS = 10_000
MAX_HOT = 1_000_000
SALTS = 256


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """How many of ``draws`` without replacement are among the ``good``: exact
    inversion outwards from the mode, in about as many steps as the deviation."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    lg = math.lgamma
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log_p = (
        lg(good + 1) - lg(mode + 1) - lg(good - mode + 1)
        + lg(bad + 1) - lg(draws - mode + 1) - lg(bad - draws + mode + 1)
        - lg(good + bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1)
    )
    p = math.exp(log_p)
    u = rng.random() - p
    up, down, p_up, p_down = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def matrix(blocks: dict[int, int], sizes: list[int], seed: int) -> dict[int, list[int]]:
    """Rows that each block sends to each cell: row sums are the block counts,
    column sums the cell sizes."""
    rng, room, out = random.Random(seed), list(sizes), {}
    for b in sorted(blocks):
        n, rest, row = blocks[b], sum(room), []
        for j, free in enumerate(room):
            rest -= free
            x = hypergeometric(free, rest, n, rng) if n else 0
            row.append(x)
            n -= x
            room[j] -= x
        out[b] = row
    return out


def _dealt(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def parts_of(total: int, shards: int = SHARDS) -> tuple[int, int]:
    """Blocks and cells per shard for so many rows."""
    wanted = total // PART_ROWS
    return min(MAX_PARTS, max(BLOCKS, wanted)), max(1, min(MAX_PARTS // shards, max(CELLS_PER_SHARD, wanted // shards)))


def _content(df: DataFrame, seed: int) -> Column:
    """A hash of a row's whole content."""
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns])


def _keyed(rows: DataFrame, key: str, serial: str, seed: int, total: int) -> DataFrame:
    """``rows`` (stored, numbered by ``serial``) with the key that deals them:
    the content, and for content that many rows share also a number among them.
    Equal rows are interchangeable, so the outcome does not depend on it; the
    numbers come from groups by content and SALTS, never from one task."""
    own = [c for c in rows.columns if c != serial]
    keyed = rows.withColumn(key, _content(rows.select(*[f"`{c}`" for c in own]), seed))
    most = max(HOT_ROWS, total // MAX_HOT)
    hot = keyed.groupBy(key).count().where(F.col("count") > most).select(key)  # MAX_HOT rows at most
    hot = bounded(hot, MAX_HOT)
    if hot is None or hot.isEmpty():
        return keyed
    salt, rank, before = new_names(keyed, "salt", "rank", "before")
    same = keyed.join(F.broadcast(hot), key).withColumn(salt, F.pmod(serial, F.lit(SALTS)).cast("int"))
    sizes = same.groupBy(key, salt).agg(F.count(F.lit(1)).alias(before))
    so_far = Window.partitionBy(key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(so_far), F.lit(0)))
    same = same.withColumn(rank, F.row_number().over(Window.partitionBy(key, salt).orderBy(serial))).join(sizes, [key, salt])
    same = same.withColumn(key, F.xxhash64(key, F.col(rank) + F.col(before)))
    rest = keyed.join(F.broadcast(hot), key, "left_anti")
    return rest.unionByName(same.select(*rest.columns))


def shard(rows: DataFrame, shards: int = SHARDS, seed: int = 1, blocks: int | None = None, cells_per_shard: int | None = None) -> DataFrame:
    """``rows`` and, for each, its shard and its slot there (from 0, gapless).

    Shard sizes are at most one apart. The result depends on the rows, the seed
    and the counts of shards, blocks and cells alone, not on the partitioning.
    Rows are stored first, with a number each, so that any number of equal rows
    spreads over all blocks and a task that runs again deals its rows as before.
    Null values are values like others; rows equal in all columns get different
    slots; an empty table has empty shards. Columns may have any names (the two
    new ones get underscores in front where theirs are taken) and any types.
    """
    spark = rows.sparkSession
    serial, block, key, rank, cell, shard_name, slot_name = new_names(rows, "serial", "block", "key", "rank", "cell", "shard", "slot")
    own = [F.col(f"`{c}`") for c in rows.columns]
    order = [c.cast("string") if "map<" in t else c for c, (_, t) in zip(own, rows.dtypes)]
    total = rows.count()
    rows = materialise(rows.withColumn(serial, F.monotonically_increasing_id()), "numbered", 4 * total)
    usual = parts_of(total, shards)
    blocks, cells_per_shard = blocks or usual[0], cells_per_shard or usual[1]
    blocked = _keyed(rows, key, serial, seed, total).drop(serial).withColumn(block, F.pmod(key, F.lit(blocks)).cast("int"))
    counts = {r[0]: r[1] for r in blocked.groupBy(block).count().collect()}  # one row a block
    cells = [x for size in _dealt(total, shards) for x in _dealt(size, cells_per_shard)]
    first, starts = 0, []
    for k, size in enumerate(cells):
        first = 0 if k % cells_per_shard == 0 else first
        starts.append(first)
        first += size

    drawn = matrix(counts, cells, seed)
    sent = []
    for b, row in drawn.items():
        ends, at = [], 0
        for k, x in enumerate(row):
            if x:
                at += x
                ends.append((at, k))
        sent.append((b, ends))
    sends = spark.createDataFrame(sent, f"{block} int, ends array<struct<upto: long, cell: int>>")
    begins = spark.createDataFrame([(k, x) for k, x in enumerate(starts)], f"{cell} int, begin long")

    # All orders below end with the whole row, so that a task that runs again
    # deals its rows as before.
    local = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed + 1), F.col(key)), key, *order)
    arrived = Window.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed + 2), F.col(key)), key, *order)
    dealt = (
        blocked.withColumn(rank, F.row_number().over(local))
        .join(F.broadcast(sends), block)  # blocks x cells entries
        .withColumn(cell, F.element_at(F.filter("ends", lambda e: e["upto"] >= F.col(rank)), 1)["cell"])
        .drop("ends", block, rank)
    )
    return (
        dealt.join(F.broadcast(begins), cell)
        .withColumn(slot_name, (F.col("begin") + F.row_number().over(arrived) - 1).cast("long"))
        .withColumn(shard_name, F.floor(F.col(cell) / cells_per_shard).cast("int"))
        .select(*own, F.col(shard_name), F.col(slot_name))
    )


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row
    of ``docs``. A null text has no bytes, an empty one neither; a null id stays
    null; repeated rows have slots of their own; an empty table gives no rows.
    Other columns are not read. Texts themselves are not moved."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
