from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import queries, url_filter as U
from tarnflow.llm.sql import ORACLE_SQL

from .conftest import with_clashes

D = date.fromisoformat


def brute(url, at, entries):
    """The deciding (pattern, action) by walking every entry."""
    from urllib.parse import urlsplit

    if url is None or not url.lower().startswith(("http://", "https://")):
        return None, None, False
    host = (urlsplit(url).hostname or "").rstrip(".")
    if not host:
        return None, None, False
    labels, segs = host.split("."), [s for s in urlsplit(url).path.split("/") if s]
    keys = [".".join(labels[-k:]) for k in range(1, len(labels) + 1)] + [f"{host}/{'/'.join(segs[:k])}".lower() for k in range(1, len(segs) + 1)]
    best = (None, None)
    for k in keys:
        log = {}
        for p, a, t in entries:
            if p is not None and a is not None and t is not None and p.lower() == k and at is not None and t <= at:
                log[t] = max(log.get(t, ""), a)
        if log and log[max(log)] != "remove":
            best = (k, log[max(log)])
    return *best, best[1] != "block"


ENTRIES = [
    ("bad.com", "block", D("2024-01-10")), ("bad.com", "remove", D("2024-02-01")), ("bad.com", "block", D("2024-03-01")), ("ok.bad.com", "allow", D("2024-01-15")),
    ("bad.com/free", "allow", D("2024-01-10")), ("site.org/Private/a", "block", D("2024-01-01")), ("same.net", "allow", D("2024-01-01")), ("same.net", "block", D("2024-01-01")),
    ("same.net", "block", D("2024-01-01")), (None, "block", D("2024-01-01")), ("x.y", None, D("2024-01-01")), ("x.y", "block", None), ("com", "block", D("2024-06-01")),
    ("Mixed.com", "block", D("2024-01-01")), ("mixed.com", "remove", D("2024-01-31")), ("MIXED.COM/Path", "block", D("2024-01-10")), ("mixed.com/path", "remove", D("2024-03-01")),
]
URLS = [
    "http://bad.com", "https://www.bad.com/x", "https://ok.bad.com/", "http://BAD.com:80/free/x?y#z", "http://u:p@bad.com./", "http://site.org/private/A/b", "http://site.org/privat", "http://same.net/a//b",
    "ftp://bad.com", "nonsense", "", None, "http://", "http://x.y/", "http://notbad.com/", "http://mixed.com/", "http://MIXED.com/path/a",
]
DATES = [D(x) for x in ("2023-12-31", "2024-01-01", "2024-01-10", "2024-01-31", "2024-02-01", "2024-03-01", "2024-06-01")] + [None]


@pytest.mark.parametrize("most", [500_000, 0])
def test_equals_a_walk_over_the_list(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MAX_BROADCAST", most)
    rows = [(k, u, t) for k, (u, t) in enumerate((u, t) for u in URLS for t in DATES)]
    captures = with_clashes(spark.createDataFrame(rows + rows[:1], "page_id long, url string, fetched_at date"))
    got = U.evaluate(captures, spark.createDataFrame(ENTRIES, "pattern string, action string, listed_at date")).collect()
    assert len(got) == len(rows) + 1
    by = {r.page_id: (r.pattern, r.action, r.kept) for r in got}
    for k, u, t in rows:
        assert by[k] == brute(u, t, ENTRIES), (u, t)


def test_intervals_do_not_overlap(spark):
    iv = U.intervals(spark.createDataFrame(ENTRIES, "pattern string, action string, listed_at date"))
    assert {(r.pattern, r.action, str(r.valid_from), r.valid_to and str(r.valid_to)) for r in iv.where("pattern in ('bad.com', 'same.net')").collect()} == {
        ("bad.com", "block", "2024-01-10", "2024-02-01"), ("bad.com", "block", "2024-03-01", None), ("same.net", "block", "2024-01-01", None)}


def test_query_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    rel = c.sql(ORACLE_SQL["op9_url_filter"])
    got = queries.op9_url_filter(spark, sf_dir).select(*rel.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rel.fetchall()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, fetched_at date")
    entries = spark.createDataFrame([], "pattern string, action string, listed_at date")
    assert U.evaluate(none, entries).count() == 0
    one = spark.range(1).select(F.col("id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.lit("2024-01-01").cast("date").alias("fetched_at"))
    assert U.evaluate(one, entries).first().kept


def test_patterns_match_at_any_depth(spark):
    deep = "deep.com/" + "/".join(f"s{k}" for k in range(1, 13))
    entries = [("deep.com/s1", "allow", D("2024-01-01")), (deep, "block", D("2024-01-01")), (deep.rpartition("/")[0], "allow", D("2024-01-01"))]
    urls = [f"http://{deep}", f"http://{deep}/more?x", f"http://{deep.rpartition('/')[0]}/other", "http://deep.com/s1/s2", "http://deep.com/"]
    captures = spark.createDataFrame([(k, u, D("2024-02-01")) for k, u in enumerate(urls)], "page_id long, url string, fetched_at date")
    got = U.evaluate(captures, spark.createDataFrame(entries, "pattern string, action string, listed_at date")).collect()
    assert {r.page_id: (r.pattern, r.action, r.kept) for r in got} == {k: brute(u, D("2024-02-01"), entries) for k, u in enumerate(urls)}
    assert [r.kept for r in sorted(got)] == [False, False, True, True, True]
