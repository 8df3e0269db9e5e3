import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnflow.config import TARGETS
from tarnflow.plans import governance as G
from tarnflow.plans import retail
from tarnflow.plans.datasets import Registry, Task, TaskFailed, run_dag
from tarnflow.sources import generators
from tarnflow.sources.table import SnapshotTable

ORDER = "order_id string, customer_id string, order_date string, status string, items string, total_amount double, shipping_address string, payment_method string, _extracted_at string"
ITEM = '[{"product_id":"p","quantity":2,"unit_price":1.255},{"product_id":"q","quantity":1,"unit_price":3.0}]'
PLACE = '{"street":"s","city":"c","state":"CA","zip":"1","country":"US"}'


def order(oid="o", cust="c", at="2025-01-01T00:00:00+00:00", items=ITEM, total=5.0, extracted="2025-01-01T00:00:00+00:00"):
    return (oid, cust, at, "NEW", items, total, PLACE, "CARD", extracted)


def transformed(spark, *rows):
    return retail.transform_orders(spark.createDataFrame(list(rows), ORDER), F.lit(datetime(2025, 6, 1)))


def test_dirty_orders_get_their_first_reason(spark):
    valid, rejects = transformed(
        spark, order("good"), order(None), order(None, None), order("nc", None), order("zero", total=0.0), order("neg", total=-1.0), order("null", total=None),
        order("empty", items="[]"), order("nil", items=None), order("cut", items="[{"), order("future", at="2099-01-01T00:00:00+00:00"), order("baddate", at="soon"),
        order("two", total=-1.0, items="[]"), order("twice", total=1.0), order("twice", total=2.0, extracted="2025-01-02T00:00:00+00:00"),
    )
    assert sorted((r.order_id, float(r.total_amount)) for r in valid.collect()) == [("baddate", 5.0), ("good", 5.0), ("twice", 2.0)]
    assert sorted((r.order_id or "", r._quarantine_reason) for r in rejects.collect()) == sorted([
        ("", "NULL_ORDER_ID"), ("", "NULL_ORDER_ID"), ("nc", "NULL_CUSTOMER_ID"), ("zero", "NON_POSITIVE_TOTAL"), ("neg", "NON_POSITIVE_TOTAL"), ("null", "NON_POSITIVE_TOTAL"),
        ("two", "NON_POSITIVE_TOTAL"), ("empty", "EMPTY_ITEMS"), ("nil", "EMPTY_ITEMS"), ("cut", "EMPTY_ITEMS"), ("future", "FUTURE_ORDER_DATE")])
    lines = retail.order_items(valid.where("order_id = 'good'")).orderBy("line_number").collect()
    assert [(r.line_number, r.quantity, str(r.unit_price), str(r.line_amount)) for r in lines] == [(1, 2, "1.26", "2.51"), (2, 1, "3.00", "3.00")]
    assert valid.schema["discount_code"].dataType.simpleString() == "string"


def test_orders_build_again_changes_nothing(spark, tmp_path):
    w = retail.Warehouse(spark, f"file://{tmp_path}", TARGETS["dev"])
    first = spark.createDataFrame([order("a"), order("b"), order(None)], ORDER)
    as_of = F.lit(datetime(2025, 6, 1))
    assert w.build_orders(first, as_of) == {"orders": 2, "items": 4, "rejects": 1}
    assert w.build_orders(first, as_of) == {"orders": 0, "items": 0, "rejects": 0}
    more = spark.createDataFrame([order("a", items='[{"product_id":"z","quantity":1,"unit_price":1.0}]', extracted="2025-02-01T00:00:00+00:00"), order("c")], ORDER)
    assert w.build_orders(more, as_of) == {"orders": 1, "items": 2, "rejects": 0}


def test_customers_in_steps_equal_one_load(spark, tmp_path):
    weeks = [generators.customers(spark, d, 60) for d in (0, 7, 14)]
    one, steps = (retail.Warehouse(spark, f"file://{tmp_path}/{x}") for x in ("one", "steps"))
    whole = weeks[0].unionByName(weeks[1]).unionByName(weeks[2])
    one.build_customers(whole)
    steps.build_customers(weeks[0])
    steps.build_customers(whole)
    assert steps.build_customers(whole) == {"versions": 0}
    columns = ["customer_id", "effective_from", "effective_to", "is_current", "_row_hash"]
    a, b = (w.table("silver", "dim_customers").read().select(columns) for w in (one, steps))
    assert a.count() > 60 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_products_conform(spark):
    raw = spark.createDataFrame(
        [("p", "n", "c", "s", "b", "10.005", "6", "1.23456", "True", "2025-01-01"), ("z", "n", "c", "s", "b", "0", "1", "1", "x", "2025-01-01"), (None, "n", "c", "s", "b", "1", "1", "1", "False", "2025-01-01")],
        "product_id string, product_name string, category string, subcategory string, brand string, price string, cost string, weight_kg string, is_active string, last_updated string",
    )
    (r,) = retail.conform_products(raw).collect()
    assert (str(r.price), str(r.weight_kg), r.is_active, r.price_band) == ("10.01", "1.235", True, "BUDGET") and str(r.margin_pct) == "40.06"


def test_vault_keeps_the_latest_snapshot(spark):
    raw = spark.createDataFrame([("c", "old@x", "1", "2000-01-01", "2025-01-01"), ("c", "new@x", "2", "2000-01-01", "2025-01-08")], "customer_id string, email string, phone string, date_of_birth string, _snapshot_date string")
    assert [r.email for r in retail.pii_vault(raw).collect()] == ["new@x"]


def test_generators_repeat_and_have_their_faults(spark):
    a, b = (generators.orders(spark, 6, 2000) for _ in range(2))
    assert a.exceptAll(b).count() == 0 and "discount_code" in a.columns and "discount_code" not in generators.orders(spark, 4, 1).columns
    assert a.count() > 2000 and 0 < a.where("customer_id is null").count() < 40
    p = generators.products(spark, 0, 50).join(generators.products(spark, 9, 50).withColumnRenamed("category", "later"), "product_id")
    assert p.where("category <> later").count() == 0
    assert generators.json_lines(generators.clickstream(spark, 1, 2000), 0.05).where("value not like '%}'").count() > 20


def test_registry_reads_make_the_graph(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}")
    reg.dataset("raw")(lambda r: spark.range(5))
    reg.dataset("clean", kind="table", comment="c", drop={"big": "id > 1"}, warn={"odd": "id % 2 = 1"})(lambda r: r.read("raw"))
    assert reg.read("clean").count() == 3 and reg.edges == {("raw", "clean")}
    assert SnapshotTable(spark, f"file://{tmp_path}/clean").entry().inputs == ["raw"]
    assert {(r.name, r.failed) for r in reg.reports["clean"].collect()} == {("big", 2), ("odd", 3)}
    reg.dataset("a")(lambda r: r.read("b"))
    reg.dataset("b")(lambda r: r.read("a"))
    with pytest.raises(ValueError, match="each other"):
        reg.read("a")


def test_dag_order_retries_and_failure():
    done, fails, lock = [], {"b": 1}, threading.Lock()

    def task(name):
        def run():
            with lock:
                if fails.get(name, 0) > 0:
                    fails[name] -= 1
                    raise RuntimeError("not yet")
                done.append(name)
            return name

        return run

    out = run_dag([Task("c", task("c"), ("a", "b")), Task("a", task("a")), Task("b", task("b"), retries=1)])
    assert done[-1] == "c" and out["b"] == ("b", 2)
    fails["x"] = 9
    with pytest.raises(TaskFailed, match="x failed"):
        run_dag([Task("x", task("x"), retries=2), Task("y", task("y"), ("x",))])
    assert "y" not in done


def test_audit_names_every_failure(spark):
    df = spark.range(4)
    report = G.audit([G.check(df, "enough", F.count(F.lit(1)), 3, True), G.check(df, "few", F.max("id"), 1, False), G.check(df, "none", F.max("id"), 0, False)])
    with pytest.raises(G.AuditFailed, match="few.*none"):
        G.enforce(report)
    G.enforce(report.where("passed"))


def test_access(spark):
    assert G.check_access({"engineers"}, "bronze", write=True) and not G.check_access({"analysts"}, "bronze")
    assert G.check_access({"analysts"}, "gold") and not G.check_access({"analysts"}, "gold", write=True)
    assert not G.safe_grant({}, "ghosts", "gold", "SELECT")
    df = spark.createDataFrame([("abcdef@x", "US")], "email string, c string")
    assert G.secure_view(df, {"pii_readers"}, {"email": "email"}).first().email == "abcdef@x"
    assert G.secure_view(df, set(), {"email": "email"}).first().email == "abcd****@****"
