"""Connected components of an edge list, by alternating star contractions.

Edges and labels stay distributed; each round is two grouped minima and two
joins, is written to the shared folder, and the number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise

MAX_ROUNDS = 60


#: A node with more neighbours is hot, or with more than an even share of the
#: edges among MAX_HOT nodes: there are at most MAX_HOT hot nodes, whatever the
#: number of edges. A key and its least neighbour of each are broadcast.
HOT_DEGREE = 10_000
MAX_HOT = 100_000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b), ``total`` in number, with the least neighbour m of a.
    The edges of a hot node are not brought into one task."""
    most = max(HOT_DEGREE, total // MAX_HOT)
    hot = bounded(least.where(F.col("degree") > most).select("a", "m"), MAX_HOT) if total > most else None
    if hot is None:
        return edges.join(least.drop("degree"), "a")
    there = edges.join(F.broadcast(hot), "a")
    rest = edges.join(F.broadcast(hot.select("a")), "a", "left_anti")
    return there.unionByName(rest.join(least.where(F.col("degree") <= most).drop("degree"), "a"))


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over ``total`` edges (a, b), a != b. Large: every larger
    neighbour of a node is linked to the least node around; small: every smaller
    one."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    least = least.select("a", F.least("a", "m").alias("m"), "degree")
    joined = _with_least(both, least, 2 * total)
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, any order):
    root is the least node connected with it, itself included. Loops (a = b) and
    nulls are ignored; nodes without an edge do not appear."""
    edges = materialise(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges", edges.count())
    total, last = edges.count(), None
    for _ in range(MAX_ROUNDS):
        stars = _star(edges, True, total)
        if total > HOT_DEGREE:
            stars = materialise(stars, "edges", 2 * total)
        edges = materialise(_star(stars, False, total), "edges", 2 * total)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
