import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnflow.functions import exprs as X
from tarnflow.operators import rows as R


def test_latest_by_keeps_the_greatest_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n"), (None, 2, "m")], "k string, t int, v string")
    assert sorted(r.v for r in R.latest_by(df, ["k"], ["t"]).collect()) == ["m", "y", "z"]
    assert sorted(r.v for r in R.latest_by(df, ["k"], ["t"], keep_null_keys=True).collect()) == ["m", "n", "y", "z"]


def test_first_broken_rule_names_the_reason(spark):
    df = spark.createDataFrame([(1, 5), (None, -1), (2, -1), (3, None)], "k int, v int")
    valid, rejects = R.split_rejects(df, [("NO_KEY", F.col("k").isNull()), ("NEGATIVE", F.col("v") < 0)])
    assert sorted(r.k for r in valid.collect()) == [1, 3] and valid.columns == ["k", "v"]
    assert {(r.k, r._quarantine_reason) for r in rejects.collect()} == {(None, "NO_KEY"), (2, "NEGATIVE")}


def test_expectations_drop_and_warn(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (3, None)], "a int, b int")
    kept, report = R.expect(df, {"has_a": "a is not null"}, {"b_is_one": "b = 1"})
    assert kept.count() == 2
    assert {tuple(r) for r in report.collect()} == {("has_a", "drop", 1, 3), ("b_is_one", "warn", 2, 3)}


def test_explode_items_numbers_from_one_and_drops_empty(spark):
    df = spark.createDataFrame([("a", [(7,), (8,)]), ("b", []), ("c", None)], "k string, items array<struct<x int>>")
    assert [tuple(r) for r in R.explode_items(df, "items", ["k"]).orderBy("line_number").collect()] == [("a", 1, 7), ("a", 2, 8)]


@pytest.mark.parametrize("n", [1, 3, 5])
@pytest.mark.parametrize("size", [0, 2, 101])
def test_global_ntile_is_ntile(spark, monkeypatch, n, size):
    monkeypatch.setattr(R, "RANGE_ROWS", 10)
    df = spark.range(size).select("id", (F.col("id") * 7 % 5).alias("v"))
    got = R.global_ntile(df, n, [F.col("v"), F.col("id")], "t", "id")
    want = df.withColumn("t", F.ntile(n).over(Window.orderBy("v", "id")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bands_segments_and_masks(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    bands = [show(X.price_band(F.lit(v).cast("double"))) for v in (49.99, 50, 199.99, 200, None)]
    assert bands == ["BUDGET", "MID", "MID", "PREMIUM", "PREMIUM"]
    assert [show(X.performance_tier(F.lit(v))) for v in (1000.0, 1000.01, 10000.01, 50000.0, 50000.01)] == ["MINIMAL", "LOW", "MID", "MID", "TOP"]
    assert show(X.mask_email(F.lit("ab"))) == "ab****@****" and show(X.mask_email(F.lit(None).cast("string"))) is None
    assert show(X.mask_phone(F.lit("+1 (555) 12-34"))) == "***-***-1234"
    assert show(X.margin_pct(F.lit("0").cast("decimal(10,2)"), F.lit("1").cast("decimal(10,2)"))) is None


def test_row_hash_keeps_nulls_and_separators_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|", "|b", ""), ("a", "||b", ""), ("a||", "b", "")], "x string, y string, z string")
    assert df.select(X.row_hash("x", "y", "z").alias("h")).distinct().count() == 5


def test_region_filter(spark):
    df = spark.createDataFrame([("US",), ("DE",), ("GB",), (None,)], "c string")
    seen = lambda *g: {r.c for r in df.where(X.region_filter(F.col("c"), set(g))).collect()}
    assert seen() == set() and seen("us") == {"US"} and seen("us", "eu") == {"US", "DE"} and seen("global") == {"US", "DE", "GB", None}
