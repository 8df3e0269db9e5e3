"""URL filters as a temporal list join.

A list is a log of dated entries. The entries of one pattern, in order of date,
become validity intervals [listed, next listed); an as-of join finds, for every
capture, the entries of its host, parent domains and path prefixes that were
active when it was fetched, and the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK, ALLOW, REMOVE = "block", "allow", "remove"
#: Intervals (some 100 bytes each) that may be broadcast.
MAX_BROADCAST = 500_000
#: Beyond it, the captures of a hot host are joined in this many groups.
SALTS = 16


def host_of(url: Column) -> Column:
    """The host of an absolute http(s) URL, lower-cased, without user, port and
    final dot; null for anything else."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def path_of(url: Column) -> Column:
    """The path of an absolute URL, as written, without query and fragment."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z]+://[^/?#]*(/[^?#]*)", 1)


def depth_of(entries: DataFrame) -> int:
    """The largest number of path segments that a pattern has."""
    return entries.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0


def keys_of(url: Column, depth: int) -> Column:
    """The list patterns a URL falls under, most specific last: its parent
    domains and host ("a.example.com", "example.com", "com"), then host and path
    prefixes ("a.example.com/x", "a.example.com/x/y") of up to ``depth``
    segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    segments = F.slice(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), 1, depth)
    prefixes = F.transform(segments, lambda s, k: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k + 1), "/")))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.concat(domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of entries (pattern, action,
    listed_at). Of entries of one pattern at one time the greatest action counts
    ("remove", then "block", then "allow"). Patterns that differ in case only
    are one. Repeated entries count once; those
    without a pattern, an action or a time are ignored. A pattern that was
    removed is on no list until it is listed again; the last entry has no end.
    """
    known = entries.where("pattern is not null and action is not null and listed_at is not null")
    one = known.groupBy(F.lower("pattern").alias("pattern"), F.col("listed_at").alias("valid_from")).agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern").orderBy("valid_from")
    ended = one.withColumn("valid_to", F.lead("valid_from").over(order))
    return ended.where(F.col("action") != REMOVE).select("pattern", "action", "valid_from", "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Per row of ``captures``: its id, url and time, host, the pattern and
    action that decided, since when it was listed, and kept.

    The most specific active pattern decides: path prefixes before hosts before
    parent domains, longer before shorter. Captures under no active pattern are
    kept; those with a null or unusable URL have no host and are not kept; with
    a null time no entry is active. Repeated rows are evaluated each. Patterns
    are compared without regard to case. Without entries every capture that has
    a host is kept; without captures there are no rows. Other columns of either
    table are not read, whatever their names; long URLs count whole.
    """
    rows = captures.select(
        F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{time_col}`").alias("_time")
    )
    valid = materialise(intervals(entries.select("pattern", "action", "listed_at")), "intervals")
    keys = rows.select("*", F.posexplode_outer(keys_of(F.col("_url"), depth_of(valid))).alias("_rank", "_key")).withColumn("_key", F.lower("_key"))
    active = (F.col("_time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to")))
    same = F.col("_key") == F.col("pattern")
    if valid.count() <= MAX_BROADCAST:
        joined = keys.join(F.broadcast(valid), same & active, "left")
    else:
        salted = valid.withColumn("_side", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys = keys.withColumn("_salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
        joined = keys.join(salted, same & (F.col("_salt") == F.col("_side")) & active, "left")
    hit = F.when(F.col("pattern").isNotNull(), F.struct("_rank", "pattern", "action", "valid_from"))
    best = joined.groupBy("_row").agg(F.max("_id").alias("_id"), F.max("_url").alias("_url"), F.max("_time").alias("_time"), F.max(hit).alias("_hit"))
    host = host_of(F.col("_url"))
    return best.select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_time").alias(time_col),
        host.alias("host"),
        F.col("_hit.pattern").alias("pattern"),
        F.col("_hit.action").alias("action"),
        F.col("_hit.valid_from").alias("listed_at"),
        (host.isNotNull() & F.coalesce(F.col("_hit.action") != BLOCK, F.lit(True))).alias("kept"),
    )


def demo_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and fetched_at: the tables hold no fetch times, so each page
    has a day of 2024 by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched_at"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: blocks and later removals or
    returns of a part of the hosts, a block of one domain, exceptions for paths.
    Everything follows from the md5 of the host, so SQL can make the same list."""
    host = materialise(pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct(), "hosts")
    number = lambda at: F.conv(F.substring(F.md5("host"), at, 3), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    h = host.select("host", number(1).alias("a"), number(4).alias("b"), number(7).alias("c"))
    parts = [
        h.where("a % 3 = 0").select(F.col("host").alias("pattern"), F.lit(BLOCK).alias("action"), day(F.col("b") % 300).alias("listed_at")),
        h.where("a % 3 = 0 and c % 2 = 0").select("host", F.lit(REMOVE), day(F.col("b") % 300 + 20 + F.col("c") % 60)),
        h.where("a % 6 = 0 and c % 2 = 0").select("host", F.lit(BLOCK), day(F.col("b") % 300 + 100 + F.col("c") % 60)),
        h.where("a % 2 = 0").select(F.concat("host", F.lit("/en")), F.lit(ALLOW), day(F.col("c") % 366)),
        h.where("a % 5 = 0").select(F.concat("host", F.lit("/fr")), F.lit(BLOCK), day(F.col("b") % 200)),
        h.where("host like '%.example.org'").select(F.lit("example.org"), F.lit(BLOCK), day(F.lit(180))).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
