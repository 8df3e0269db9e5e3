import random
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from tarnflow.llm import sharding as S
from tarnflow.llm.common import read_table

from .conftest import with_clashes


def gapless(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(k, ())) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = S.digest(docs).collect()
    gapless(rows, 40)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    again = S.digest(docs.repartition(7)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    import zlib

    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.size == len(texts[r.doc_id]) + 16 and r.law == "rows" and r.grown_shard is None for r in rows)


@pytest.mark.parametrize("size", [0, 1, 39, 41, 500])
def test_any_size(spark, size):
    rows = S.shard(spark.range(size), 40).collect()
    assert len(rows) == size
    gapless(rows, 40)


def test_odd_rows_keep_their_columns(spark, odd):
    docs = with_clashes(odd).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    out = S.shard(docs, 3)
    assert out.columns == [*docs.columns, "_shard", "_slot"]
    rows = out.withColumnsRenamed({"shard": "x", "slot": "y"}).withColumnsRenamed({"_shard": "shard", "_slot": "slot"}).collect()
    assert len(rows) == 10
    gapless(rows, 3)


@pytest.mark.parametrize("hot", [10_000, 50])
def test_a_third_of_rows_alike(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    df = spark.range(900).select(F.when(F.col("id") < 300, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    gapless(S.shard(df, 7).collect(), 7)
    gapless(S.shard(df.select("k"), 7).collect(), 7)


def test_equal_rows_spread_over_blocks_whatever_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 50)
    df = spark.range(1200).select(F.when(F.col("id") < 900, F.lit(7)).otherwise(F.col("id")).alias("k"))
    some = df.withColumn("n", F.monotonically_increasing_id())
    keys = S._keyed(some, "key", "n", 1, 1200).where("k = 7")
    assert keys.select("key").distinct().count() == 900
    assert keys.groupBy(F.pmod("key", F.lit(16))).count().agg(F.max("count")).first()[0] < 100
    shards = lambda d: sorted((r.k, r.shard, r.slot) for r in S.shard(d, 5).collect())
    assert shards(df) == shards(df.repartition(5))


def test_parts_follow_the_rows_within_a_bound():
    assert S.parts_of(0) == (256, 8) and S.parts_of(10**9) == (500, 12)
    blocks, cells = S.parts_of(10**13)
    assert blocks <= S.MAX_PARTS and cells * S.SHARDS <= S.MAX_PARTS


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_shuffle_is_uniform(spark, seed):
    """Where a row comes from says nothing about where it goes: chi-square of a
    table of 8 x 8 places, 49 degrees of freedom; and of every pair of rows next
    to each other before, half are in order after."""
    n = 4000
    rows = S.shard(spark.range(n), 4, seed).collect()
    place = {r.id: r.shard * (n // 4) + r.slot for r in rows}
    seen = Counter((i * 8 // n, p * 8 // n) for i, p in place.items())
    expected = n / 64
    assert sum((seen[a, b] - expected) ** 2 / expected for a in range(8) for b in range(8)) < 95
    assert sum(place[k] < place[k + 1] for k in range(n - 1)) / (n - 1) == pytest.approx(0.5, abs=0.04)
    fixed = sum(place[k] == k for k in range(n))
    assert fixed < 10  # one on average


def test_plan_has_no_python(spark, sf_dir):
    plan = S.digest(read_table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_hypergeometric_law():
    rng = random.Random(3)
    good, bad, draws, n = 7, 9, 6, 30000
    seen = Counter(S.hypergeometric(good, bad, draws, rng) for _ in range(n))
    for k in range(7):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(seen[k] / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-9
    assert S.hypergeometric(5, 0, 3, rng) == 3 and S.hypergeometric(0, 5, 3, rng) == 0 and S.hypergeometric(4, 4, 8, rng) == 4


def test_matrix_has_exact_margins():
    blocks, sizes = {0: 5, 1: 0, 2: 17, 5: 8}, [10, 0, 9, 11]
    m = S.matrix(blocks, sizes, 1)
    assert {b: sum(r) for b, r in m.items()} == blocks and [sum(c) for c in zip(*m.values())] == sizes


def test_arrangements_are_equally_likely(spark):
    """Three rows in three shards of one: over many seeds each of the six orders
    comes about equally often, by the same draws as the operator's."""
    seen = Counter()
    for seed in range(1800):
        rng = random.Random(f"{seed}")
        m = S.matrix({0: 2, 1: 1}, [1, 1, 1], seed)
        local = [0, 1] if rng.random() < 0.5 else [1, 0]
        order, at = [None] * 3, 0
        for j in range(3):
            if m[0][j]:
                order[j] = local[at]
                at += 1
            else:
                order[j] = 2
        seen[tuple(order)] += 1
    assert len(seen) == 6 and all(abs(v - 300) < 80 for v in seen.values())


def test_neighbours_are_torn_apart(spark):
    rows = S.shard(spark.range(2000), 4).collect()
    slot = {r.id: (r.shard, r.slot) for r in rows}
    assert sum(slot[k][0] == slot[k + 1][0] for k in range(1999)) / 1999 < 0.32
    assert sum(slot[k][1] < slot[k + 1][1] for k in range(1999)) / 1999 == pytest.approx(0.5, abs=0.06)
