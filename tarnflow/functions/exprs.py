"""Reusable column expressions; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARK = "\x00"
OPEN_END = "9999-12-31"


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def email_hash(c: Column) -> Column:
    return F.sha2(F.lower(c), 256)


def phone_hash(c: Column) -> Column:
    return F.sha2(digits_only(c), 256)


def row_hash(*columns: str) -> Column:
    """SHA-256 over positions: null has a mark of its own and separators inside
    values are escaped, so that no two different rows share their input."""
    parts = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([\\|])", r"\\$1"), F.lit(NULL_MARK)) for c in columns]
    return F.sha2(F.concat_ws("||", *parts), 256)


def version_key(keys: list[str], start: str) -> Column:
    """The surrogate key of a version: SHA-256 of its key and start, so that a
    build that runs again gives the same one."""
    return row_hash(*keys, start)


def opt_col(df: DataFrame, name: str, kind: str) -> Column:
    """A column that may be missing: null of the given type then."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def margin_pct(price: Column, cost: Column) -> Column:
    return F.when(price > 0, F.round((price - cost) / price * 100, 2)).cast("decimal(18,2)")


def price_band(price: Column) -> Column:
    """Below 50 BUDGET, below 200 MID, else PREMIUM; so null is PREMIUM."""
    return F.when(price < 50, "BUDGET").when(price < 200, "MID").otherwise("PREMIUM")


def performance_tier(revenue: Column) -> Column:
    return F.when(revenue > 50000, "TOP").when(revenue > 10000, "MID").when(revenue > 1000, "LOW").otherwise("MINIMAL")


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """The first rule that holds names the segment."""
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "CHAMPION")
        .when((r >= 4) & (m >= 4), "BIG_SPENDER")
        .when(r >= 4, "RECENT")
        .when((r <= 2) & (f >= 4), "AT_RISK")
        .when(r <= 1, "LOST")
        .otherwise("REGULAR")
    )


def fiscal_quarter(d: Column) -> Column:
    """Fiscal years start in February; January is Q4 under its own year."""
    m = F.month(d)
    q = F.when(m.isin(2, 3, 4), "Q1").when(m.isin(5, 6, 7), "Q2").when(m.isin(8, 9, 10), "Q3").otherwise("Q4")
    return F.concat(F.lit("FY"), F.year(d).cast("string"), F.lit("-"), q)


def us_holiday(d: Column) -> Column:
    m, day = F.month(d), F.dayofmonth(d)
    return ((m == 12) & (day == 25)) | ((m == 7) & (day == 4)) | ((m == 1) & (day == 1))


def mask_email(c: Column, privileged: bool = False) -> Column:
    return c if privileged else F.when(c.isNotNull(), F.concat(F.left(c, F.lit(4)), F.lit("****@****")))


def mask_phone(c: Column, privileged: bool = False) -> Column:
    return c if privileged else F.when(c.isNotNull(), F.concat(F.lit("***-***-"), F.right(digits_only(c), F.lit(4))))


def mask_dob(c: Column, privileged: bool = False) -> Column:
    return c if privileged else F.trunc(c, "year")


#: Countries by region group (fixed values).
EU = ("DE", "FR", "IT", "ES", "NL", "BE")


def region_filter(country: Column, groups: set[str]) -> Column:
    """Which rows members of ``groups`` see; members of none see no row."""
    if groups & {"global", "admins"}:
        return F.lit(True)
    seen = F.lit(False)
    if "us" in groups:
        seen = seen | (country == "US")
    if "eu" in groups:
        seen = seen | country.isin(*EU)
    return F.coalesce(seen, F.lit(False))
