"""Deduplication, validation and quarantine, expectations, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str], keep_null_keys: bool = False) -> DataFrame:
    """One row per key: the greatest by the order columns, nulls last. Rows with
    a null key collapse like others unless ``keep_null_keys``. The rank is pruned
    before the shuffle (WindowGroupLimit), so a hot key sends a row a task."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    if not keep_null_keys:
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return latest_by(df.where(~no_key), keys, order).unionByName(df.where(no_key))


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks; null for none. A rule whose
    condition is null counts as not broken."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    return reason


def split_rejects(df: DataFrame, rules: list[tuple[str, Column]], column: str = "_quarantine_reason") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): disjoint, and ``df`` together."""
    marked = df.withColumn(column, reject_reason(rules))
    return marked.where(F.col(column).isNull()).drop(column), marked.where(F.col(column).isNotNull())


def expect(df: DataFrame, drop: dict[str, str], warn: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all ``drop`` conditions, a table of failures: name,
    action, failed, total). Rows whose condition is not true fail it."""
    rules = [(n, "drop", c) for n, c in drop.items()] + [(n, "warn", c) for n, c in warn.items()]
    holds = {n: F.coalesce(F.expr(c), F.lit(False)) for n, _, c in rules}
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~holds[n]).alias(f"f{k}") for k, (n, _, _) in enumerate(rules)])
    stats = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("action"), F.col(f"f{k}").alias("failed")) for k, (n, a, _) in enumerate(rules)])
    report = counts.select(F.explode(stats).alias("s"), "total").select("s.name", "s.action", "s.failed", "total")
    kept = df
    for n in drop:
        kept = kept.where(holds[n])
    return kept, report


def explode_items(df: DataFrame, array: str, keep: list[str], number: str = "line_number") -> DataFrame:
    """A row per element, numbered from 1; null and empty arrays give none."""
    return df.select(*keep, F.posexplode(array).alias("_at", "_item")).select(*keep, (F.col("_at") + 1).cast("int").alias(number), "_item.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct_keys and duplicates of a table, as one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).cast("long").alias("duplicates"),
    )


#: A global rank is dealt out in ranges of about this many rows, RANGES at most.
#: Bounds are looked up in two steps, FAN of them at a time.
RANGE_ROWS = 1_000_000
RANGES = 1024
FAN = 32


def global_rank(df: DataFrame, order: list[Column], name: str, tie: str, stored: DataFrame | None = None, range_rows: int | None = None) -> tuple[DataFrame, int]:
    """(``df`` with row numbers from 1 over the whole table, its rows), without a
    one-task sort: rows go to ranges between sampled boundaries, ranges are
    counted, and a row's rank is its place in its range after the rows of all
    ranges before. Exact whatever the sample; ``order`` ends with the column
    ``tie``, which must be unique. Sample and counts are taken from ``stored``,
    a stored table with the same rows, where given."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    source = (df if stored is None else stored).select(key.alias("_key"), F.col(tie).alias("_tie"))
    ranges = min(RANGES, -(-source.count() // (range_rows or RANGE_ROWS)))
    bounds = []
    if ranges > 1:
        sample = sorted(r[0] for r in source.orderBy(F.xxhash64("_tie"), "_tie").limit(20 * ranges).select("_key").collect())
        bounds = [sample[k] for k in range(0, len(sample), max(1, len(sample) // ranges))][1:]
    place = F.lit(0)
    if bounds:
        fields = source.schema["_key"].dataType.fields
        listed = lambda some: F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, fields)]) for b in some])
        upto = lambda some: F.size(F.filter(some, lambda b: b <= F.col("_key")))
        fans = [bounds[k : k + FAN] for k in range(0, len(bounds), FAN)]
        fan = upto(listed([x[0] for x in fans]))
        inside = F.element_at(F.array(*[listed(x) for x in fans]), F.greatest(fan, F.lit(1)))
        place = F.when(fan == 0, 0).otherwise((fan - 1) * FAN + upto(inside))
    counts = {r[0]: r[1] for r in source.groupBy(place.alias("_range")).count().collect()}  # a row a range
    before, total = [], 0
    for k in range(len(bounds) + 1):
        before.append(total)
        total += counts.get(k, 0)
    ranged = df.withColumn("_key", key).withColumn("_range", place)
    w = Window.partitionBy("_range").orderBy("_key")
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_range") + 1)
    return ranged.withColumn(name, start + F.row_number().over(w)).drop("_key", "_range"), total


def global_ntile(df: DataFrame, n: int, order: list[Column], name: str, tie: str, stored: DataFrame | None = None) -> DataFrame:
    """``ntile(n)`` over the whole table, by ``global_rank``."""
    ranked, total = global_rank(df, order, "_rank", tie, stored)
    small, extra = divmod(total, n)
    big = extra * (small + 1)
    rank = F.col("_rank")
    tile = F.when(rank <= big, F.floor((rank - 1) / (small + 1))).otherwise(extra + F.floor((rank - 1 - big) / max(small, 1)))
    return ranked.withColumn(name, (tile + 1).cast("int")).drop("_rank")
