"""Masks, row filters, grants, tags, lineage and the audit gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import mask_dob, mask_email, mask_phone, region_filter
from ..sources.table import SnapshotTable

Mask = Callable[[Column, bool], Column]
MASKS: dict[str, Mask] = {"email": mask_email, "phone": mask_phone, "dob": mask_dob}
LAYERS = ("bronze", "silver", "gold")
#: What each role may do, by layer (fixed values).
GRANTS = {
    "engineers": {"bronze": "ALL", "silver": "ALL", "gold": "ALL"},
    "analysts": {"silver": "SELECT", "gold": "SELECT"},
    "executives": {"gold": "SELECT"},
    "pii_readers": {"silver": "SELECT", "gold": "SELECT"},
}


def secure_view(df: DataFrame, groups: set[str], masks: dict[str, str], row_filter: Callable[[set[str]], Column] | None = None, privileged: str = "pii_readers") -> DataFrame:
    """``df`` as members of ``groups`` see it: columns in ``masks`` (column ->
    mask) are clear only for the privileged group, rows pass the filter."""
    clear = privileged in groups
    if row_filter is not None:
        df = df.where(row_filter(groups))
    return df.withColumns({c: MASKS[m](F.col(c), clear).alias(c) for c, m in masks.items()}) if masks else df


def create_mask_functions(spark: SparkSession, groups: set[str], privileged: str = "pii_readers") -> None:
    """The masks as SQL functions mask_email, mask_phone and mask_dob."""
    clear = "true" if privileged in groups else "false"
    for name, kind, body in (
        ("mask_email", "STRING", "CASE WHEN {c} THEN x WHEN x IS NULL THEN NULL ELSE concat(left(x, 4), '****@****') END"),
        ("mask_phone", "STRING", "CASE WHEN {c} THEN x WHEN x IS NULL THEN NULL ELSE concat('***-***-', right(regexp_replace(x, '[^0-9]', ''), 4)) END"),
        ("mask_dob", "DATE", "CASE WHEN {c} THEN x ELSE trunc(x, 'year') END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x {kind}) RETURNS {kind} RETURN {body.format(c=clear)}")


#: Row filters that can be bound to a table, by name.
ROW_FILTERS: dict[str, Callable[[Column, set[str]], Column]] = {"region": region_filter}


def bind_mask(table: SnapshotTable, column: str, mask: str | None) -> None:
    """Store a mask with a column of a table; None drops it."""
    if mask is not None and mask not in MASKS:
        raise ValueError(f"unknown mask {mask!r}")
    table.annotate(column_tags={column: {"mask": mask}})


def bind_row_filter(table: SnapshotTable, name: str | None, column: str | None = None) -> None:
    """Store a row filter over a column with a table; None drops it."""
    if name is not None and name not in ROW_FILTERS:
        raise ValueError(f"unknown row filter {name!r}")
    table.annotate(row_filter=None if name is None else f"{name}:{column}")


def read_secured(table: SnapshotTable, groups: set[str]) -> DataFrame:
    """The table as members of ``groups`` see it, by the masks and the row filter
    that are stored with it."""
    e = table.entry()
    masks = {c: x["mask"] for c, x in e.column_tags.items() if "mask" in x}
    rule = None
    if bound := e.properties.get("row_filter"):
        name, _, column = bound.partition(":")
        rule = lambda g: ROW_FILTERS[name](F.col(column), g)
    return secure_view(table.read(), groups, masks, rule)


def grants_matrix(spark: SparkSession) -> DataFrame:
    rows = [(g, layer, GRANTS[g].get(layer, "NONE")) for g in sorted(GRANTS) for layer in LAYERS]
    return spark.createDataFrame(rows, "role string, layer string, privilege string")


def check_access(groups: set[str], layer: str, write: bool = False) -> bool:
    have = {GRANTS.get(g, {}).get(layer) for g in groups}
    return "ALL" in have or (not write and "SELECT" in have)


def safe_grant(grants: dict[str, dict[str, str]], role: str, layer: str, privilege: str) -> bool:
    """Grant to a role if it exists; a missing one is reported, not an error."""
    if role not in grants:
        return False
    grants[role][layer] = privilege
    return True


def tags(tables: dict[str, SnapshotTable], spark: SparkSession) -> DataFrame:
    """table, column (null: the table's own), tag and value."""
    rows = []
    for name, t in sorted(tables.items()):
        e = t.entry()
        rows += [(name, None, k, v) for k, v in e.tags.items()]
        rows += [(name, c, k, v) for c, x in e.column_tags.items() for k, v in x.items()]
    return spark.createDataFrame(rows, "table string, column string, tag string, value string")


def lineage(tables: dict[str, SnapshotTable], spark: SparkSession, days: int | None = None) -> DataFrame:
    """source, target and committed_at of every commit that named its inputs."""
    rows = [(s, name, e.committed_at) for name, t in sorted(tables.items()) for e in map(t.entry, t.versions()) for s in e.inputs]
    df = spark.createDataFrame(rows, "source string, target string, at double").select("source", "target", F.timestamp_seconds("at").alias("committed_at"))
    return df if days is None else df.where(F.col("committed_at") >= F.current_timestamp() - F.expr(f"INTERVAL {days} DAYS"))


class AuditFailed(RuntimeError):
    pass


def check(df: DataFrame, name: str, value: Column, threshold: float, least: bool) -> DataFrame:
    """One audit row: an aggregate against its threshold."""
    v = df.agg(value.cast("double").alias("value"))
    passed = F.col("value") >= threshold if least else F.col("value") <= threshold
    return v.select(F.lit(name).alias("check"), "value", F.lit(float(threshold)).alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"))


def _rows(run: int) -> Column:
    return F.count_if(F.col("v") == run)


def _against(before: DataFrame, now: DataFrame, name: str, ratio: Column, threshold: float, least: bool) -> DataFrame:
    both = before.select(F.lit(0).alias("v")).unionByName(now.select(F.lit(1).alias("v")))
    return check(both, name, ratio, threshold, least)


def no_drop(before: DataFrame, now: DataFrame, name: str, least: float = 0.8) -> DataFrame:
    """Rows of this run over those of the last: at least ``least``. Passes where
    the last run had none."""
    return _against(before, now, name, F.coalesce(F.round(_rows(1) / F.nullif(_rows(0), F.lit(0)), 6), F.lit(1.0)), least, True)


def no_surge(before: DataFrame, now: DataFrame, name: str, most: float = 10.0) -> DataFrame:
    """Rejects of this run over those of the last (one, if it had none): at most
    ``most``."""
    return _against(before, now, name, F.round(_rows(1) / F.greatest(_rows(0), F.lit(1)), 6), most, False)


def same_rows(source: DataFrame, built: DataFrame, name: str) -> DataFrame:
    """Rows that a build has lost or made: none."""
    return _against(source, built, name, F.abs(_rows(1) - _rows(0)), 0, False)


def audit(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def enforce(report: DataFrame) -> None:
    """Raise, once all checks have run, naming every one that failed."""
    failed = [f"{r.check}: {r.value} against {r.threshold}" for r in report.where("not passed").orderBy("check").collect()]
    if failed:
        raise AuditFailed("; ".join(failed))
