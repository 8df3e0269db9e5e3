"""Slowly changing dimensions and joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import OPEN_END, row_hash, version_key


def scd2_initial(df: DataFrame, keys: list[str], tracked: list[str], seq: str) -> DataFrame:
    """All versions from a history of snapshots: rows whose tracked columns
    differ from those of the snapshot before (A, B, A are three versions), with
    closed intervals [effective_from, effective_to], is_current and version_id, a
    hash of key and start. Snapshots are unique on (keys, seq); a key missing
    later stays open."""
    w = Window.partitionBy(*keys).orderBy(seq)
    hashed = df.withColumn("_row_hash", row_hash(*tracked))
    changed = hashed.withColumn("_before", F.lag("_row_hash").over(w)).where("_before is null or _before <> _row_hash").drop("_before")
    following = F.lead(seq).over(w)
    return (
        changed.withColumn("effective_from", F.col(seq))
        .withColumn("effective_to", F.coalesce(F.date_sub(following, 1), F.lit(OPEN_END).cast("date")))
        .withColumn("is_current", F.col("effective_to") == F.lit(OPEN_END).cast("date"))
        .withColumn("version_id", version_key(keys, "effective_from"))
    )


def scd2_changes(target: DataFrame, snapshot: DataFrame, keys: list[str], tracked: list[str]) -> DataFrame:
    """Rows of a snapshot (unique on keys) that are new or changed against the
    open versions, with _is_new."""
    open_rows = target.where("is_current").select(*keys, F.col("_row_hash").alias("_old_hash"))
    joined = snapshot.withColumn("_row_hash", row_hash(*tracked)).join(open_rows, keys, "left")
    return joined.where("_old_hash is null or _old_hash <> _row_hash").withColumn("_is_new", F.col("_old_hash").isNull()).drop("_old_hash")


def scd2_apply(target: DataFrame, snapshot: DataFrame, keys: list[str], tracked: list[str], seq: str) -> DataFrame:
    """``target`` after one snapshot: new keys open a version, changed ones
    close theirs the day before and open another; the rest is untouched. A
    snapshot not later than an open version it changes is an error."""
    changes = scd2_changes(target, snapshot, keys, tracked)
    closing = changes.where("not _is_new").select(*keys, F.col(seq).alias("_closed_at"))
    late = F.when(
        F.col("is_current") & (F.col("_closed_at") <= F.col("effective_from")),
        F.raise_error(F.lit("snapshot is not later than the open version")),
    ).otherwise(F.date_sub("_closed_at", 1))
    hit = F.col("is_current") & F.col("_closed_at").isNotNull()
    old = target.join(closing, keys, "left").withColumns(
        {"effective_to": F.when(hit, late).otherwise(F.col("effective_to")), "is_current": F.col("is_current") & ~hit}
    )
    opened = changes.drop("_is_new").withColumns(
        {"effective_from": F.col(seq), "effective_to": F.lit(OPEN_END).cast("date"), "is_current": F.lit(True)}
    ).withColumn("version_id", version_key(keys, "effective_from"))
    return old.drop("_closed_at").unionByName(opened.select(*target.columns))


def apply_changes(df: DataFrame, keys: list[str], sequence_by: str, track: list[str]) -> DataFrame:
    """Change data to half-open versions [__START_AT, __END_AT), null for
    current. Only a change of a ``track`` column opens a version; other columns
    have, in each version, their last values."""
    w = Window.partitionBy(*keys).orderBy(sequence_by)
    hashed = df.withColumn("_h", row_hash(*track))
    opens = hashed.withColumn("_opens", F.coalesce((F.lag("_h").over(w) != F.col("_h")), F.lit(True)).cast("int"))
    numbered = opens.withColumn("_version", F.sum("_opens").over(w))
    others = [c for c in df.columns if c not in (*keys, sequence_by)]
    versions = numbered.groupBy(*keys, "_version").agg(
        F.min(sequence_by).alias("__START_AT"), *[F.max_by(c, sequence_by).alias(c) for c in others]
    )
    order = Window.partitionBy(*keys).orderBy("__START_AT")
    return versions.withColumn("__END_AT", F.lead("__START_AT").over(order)).select(*keys, *others, "__START_AT", "__END_AT")


def interval_join(fact: DataFrame, dim: DataFrame, keys: list[str], at: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Left join with the version whose closed interval holds ``at``: an equi
    join on the keys with a residual range, so hash-partitioned and, as versions
    of a key are disjoint, one match at most. Unmatched rows keep nulls."""
    versions = dim.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in dim.columns if c not in keys])
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    condition = inside
    for s in same:
        condition = s & condition
    return fact.join(versions, condition, "left").drop(*[f"_k_{k}" for k in keys])


def asof_join(fact: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, period_days: int | None = None) -> DataFrame:
    """Left, backward, inclusive as-of join: facts and versions are sorted
    together by key and time, and a fact has the last version before it. One
    exchange, one sort, and a time that grows with the rows of a key, not with
    its facts times its versions. Versions are unique on (keys, since); null keys
    and times match nothing. With ``period_days`` (dates and timestamps) a hot
    key's facts are dealt out by period, to each of which every version that
    holds in it is copied."""
    own = [c for c in versions.columns if c not in keys]
    names = [f"_k{i}" for i in range(len(keys))]
    key = [F.col(k).alias(n) for k, n in zip(keys, names)]
    known = versions.where(F.col(since).isNotNull()).select(*key, F.col(since).alias("_at"), F.lit(0).alias("_is_fact"), F.struct(*own).alias("_version"))
    time = known.schema["_at"].dataType
    facts = fact.select(*key, F.col(at).cast(time).alias("_at"), F.lit(1).alias("_is_fact"), F.struct("*").alias("_fact"))
    period = F.lit(0)
    if period_days:
        number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / period_days).cast("int")
        first, last = facts.agg(F.min(number(F.col("_at"))), F.max(number(F.col("_at")))).first()
        period, first, last = number(F.col("_at")), F.lit(first).cast("int"), F.lit(last).cast("int")
        until = F.lead("_at").over(Window.partitionBy(*names).orderBy("_at"))
        known = known.withColumn("_lo", F.greatest(period, first)).withColumn("_hi", F.least(F.coalesce(number(until), last), last))
        known = known.where("_lo <= _hi").withColumn("_period", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    else:
        known = known.withColumn("_period", period)
    both = facts.withColumn("_period", period).unionByName(known, allowMissingColumns=True)
    upto = Window.partitionBy(*names, "_period").orderBy("_at", "_is_fact").rowsBetween(Window.unboundedPreceding, 0)
    usable = F.lit(True)
    for n in names:
        usable = usable & F.col(n).isNotNull()
    found = both.withColumn("_version", F.last("_version", ignorenulls=True).over(upto)).where("_is_fact = 1")
    found = found.select("_fact", F.when(usable, F.col("_version")).alias("_version"))
    return found.select("_fact.*", *[F.col("_version")[c].alias(c) for c in own])


def dim_date(spark, start: str, end: str) -> DataFrame:
    """The calendar, a row a day."""
    from ..functions.exprs import fiscal_quarter, us_holiday

    d = F.col("date_key")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date_key"))
    return days.select(
        d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).alias("day_of_month"), F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("week_of_year"), F.dayofweek(d).isin(1, 7).alias("is_weekend"), fiscal_quarter(d).alias("fiscal_quarter"),
        (F.dayofmonth(d) == 1).alias("is_month_start"), (d == F.last_day(d)).alias("is_month_end"), us_holiday(d).alias("is_holiday_us"),
        F.date_format(d, "yyyy-MM-dd").alias("date_iso"),
    )
