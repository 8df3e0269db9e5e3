from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnflow.operators import temporal as T

D = date.fromisoformat
OPEN = date(9999, 12, 31)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v string, w string, seq date")


def versions(df):
    return sorted(((r.k, r.v, r.w, r.effective_from, r.effective_to, r.is_current) for r in df.collect()), key=str)


HISTORY = [
    ("same", "a", "x", "2025-01-01"), ("same", "a", "x", "2025-01-08"), ("aba", "a", "x", "2025-01-01"), ("aba", "b", "x", "2025-01-08"), ("aba", "a", "x", "2025-01-15"),
    ("null", "a", None, "2025-01-01"), ("null", None, "a", "2025-01-08"), ("new", "n", "x", "2025-01-08"), ("gone", "g", "x", "2025-01-01"),
]


def test_initial_history(spark):
    got = versions(T.scd2_initial(frame(spark, [(*r[:3], D(r[3])) for r in HISTORY]), ["k"], ["v", "w"], "seq"))
    by = {}
    for k, *_, a, b, c in got:
        by.setdefault(k, []).append((a, b, c))
    assert sorted(by["aba"]) == [(D("2025-01-01"), D("2025-01-07"), False), (D("2025-01-08"), D("2025-01-14"), False), (D("2025-01-15"), OPEN, True)]
    assert len(by["same"]) == 1 and len(by["null"]) == 2 and by["gone"] == [(D("2025-01-01"), OPEN, True)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("pqr"), st.integers(0, 4), st.sampled_from(["a", "b", None])), max_size=12, unique_by=lambda r: r[:2]))
def test_snapshots_one_by_one_equal_the_initial_load(spark, rows):
    start = date(2025, 1, 1)
    rows = [(k, v, "x", start + timedelta(days=7 * d)) for k, d, v in rows]
    whole = versions(T.scd2_initial(frame(spark, rows), ["k"], ["v", "w"], "seq"))
    dates = sorted({r[3] for r in rows})
    table = T.scd2_initial(frame(spark, [r for r in rows if dates and r[3] == dates[0]]), ["k"], ["v", "w"], "seq")
    for d in dates[1:]:
        table = T.scd2_apply(table, frame(spark, [r for r in rows if r[3] == d]), ["k"], ["v", "w"], "seq")
    assert versions(table) == whole
    assert all(sum(r[5] for r in whole if r[0] == k) == 1 for k in {r[0] for r in whole})


def test_a_snapshot_that_is_not_later_is_refused(spark):
    t = T.scd2_initial(frame(spark, [("k", "a", "x", D("2025-01-08"))]), ["k"], ["v", "w"], "seq")
    with pytest.raises(Exception, match="not later"):
        T.scd2_apply(t, frame(spark, [("k", "b", "x", D("2025-01-08"))]), ["k"], ["v", "w"], "seq").collect()


def test_interval_join_on_the_days_of_a_downgrade(spark):
    dim = T.scd2_initial(frame(spark, [("c", "PLATINUM", "", D("2024-12-01")), ("c", "BRONZE", "", D("2025-01-15"))]), ["k"], ["v"], "seq").select("k", "v", "effective_from", "effective_to")
    days = ["2024-11-30", "2024-12-01", "2025-01-01", "2025-01-14", "2025-01-15", "2025-01-16"]
    fact = spark.createDataFrame([("c", D(x)) for x in days] + [("other", D("2025-01-01")), (None, D("2025-01-01"))], "k string, at date")
    got = {(r.k, r["at"]): r.v for r in T.interval_join(fact, dim, ["k"], "at").collect()}
    assert len(got) == 8
    assert [got["c", D(x)] for x in days] == [None, "PLATINUM", "PLATINUM", "PLATINUM", "BRONZE", "BRONZE"]
    assert got["other", D("2025-01-01")] is None


@pytest.mark.parametrize("period", [None, 1, 3, 400])
def test_asof_join_is_backward_inclusive_and_keeps_rows(spark, period):
    prices = spark.createDataFrame([("p", D("2025-01-02"), 1), ("p", D("2025-01-05"), 2)], "k string, since date, price int")
    days = ["2025-01-01", "2025-01-02", "2025-01-04", "2025-01-05", "2025-02-01"]
    fact = spark.createDataFrame([("p", D(x)) for x in days + days], "k string, at date")
    got = sorted((r["at"], r.price or 0) for r in T.asof_join(fact, prices, ["k"], "at", "since", period).collect())
    assert [p for _, p in got] == [0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
    odd = spark.createDataFrame([(None, D("2025-01-03")), ("p", None), ("q", D("2025-01-03"))], "k string, at date")
    more = prices.unionByName(spark.createDataFrame([(None, D("2025-01-01"), 3), ("q", None, 4)], "k string, since date, price int"))
    assert [r.price for r in T.asof_join(odd, more, ["k"], "at", "since", period).collect()] == [None] * 3
    assert T.asof_join(fact, prices.limit(0), ["k"], "at", "since", period).count() == 10 and T.asof_join(fact.limit(0), prices, ["k"], "at", "since", period).count() == 0


def test_apply_changes_updates_untracked_columns_in_place(spark):
    df = frame(spark, [("k", "a", "1", D("2025-01-01")), ("k", "a", "2", D("2025-01-02")), ("k", "b", "3", D("2025-01-03"))])
    got = sorted(tuple(r) for r in T.apply_changes(df, ["k"], "seq", ["v"]).select("v", "w", "__START_AT", F.coalesce("__END_AT", F.lit(OPEN))).collect())
    assert got == [("a", "2", D("2025-01-01"), D("2025-01-03")), ("b", "3", D("2025-01-03"), OPEN)]


def test_calendar(spark):
    c = {r.date_iso: r for r in T.dim_date(spark, "2024-01-01", "2026-01-01").collect()}
    assert len(c) == 732
    assert c["2024-02-29"].is_month_end and c["2024-01-31"].fiscal_quarter == "FY2024-Q4" and c["2024-02-01"].fiscal_quarter == "FY2024-Q1"
    assert c["2024-07-04"].is_holiday_us and c["2024-12-25"].is_holiday_us and not c["2024-11-01"].is_holiday_us
    assert c["2025-12-31"].week_of_year == 1 and c["2024-01-06"].is_weekend and c["2024-01-07"].day_of_week == 1
