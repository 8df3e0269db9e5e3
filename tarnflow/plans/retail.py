"""The retail pipeline: landed records to bronze, silver and gold tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.exprs import email_hash, margin_pct, opt_col, phone_hash, price_band
from ..operators.rows import explode_items, latest_by, split_rejects
from ..operators.temporal import asof_join, dim_date, interval_join, scd2_apply, scd2_changes, scd2_initial
from ..session import stored
from ..sources.table import SnapshotTable
from . import marts

# Column lists, reject reasons and constraint names that users of
# the tables rely on.
ADDRESS = "struct<street string, city string, state string, zip string, country string>"
ITEMS = "array<struct<product_id string, quantity int, unit_price double>>"
TRACKED = [
    "first_name", "last_name", "email_hash", "phone_hash", "date_of_birth", "address_street", "address_city", "address_state",
    "address_zip", "address_country", "loyalty_tier", "preferred_language",
]
PRODUCT_COMPARED = ["product_name", "category", "subcategory", "brand", "price", "cost", "margin_pct", "price_band", "weight_kg", "is_active"]


def conform_products(bronze: DataFrame, now=None) -> DataFrame:
    """Typed products with margin and band; rows without a key, a positive price
    or a cost are dropped, and one row stays for each product and day."""
    price, cost = F.col("price").try_cast("decimal(10,2)"), F.col("cost").try_cast("decimal(10,2)")
    typed = bronze.select(
        "product_id", "product_name", "category", "subcategory", "brand", price.alias("price"), cost.alias("cost"),
        margin_pct(price, cost).alias("margin_pct"), price_band(price).alias("price_band"), F.col("weight_kg").try_cast("decimal(8,3)").alias("weight_kg"),
        F.col("is_active").try_cast("boolean").alias("is_active"), F.col("last_updated").try_cast("date").alias("last_updated"),
        opt_col(bronze, "_source_file", "string").alias("_bronze_source_file"), opt_col(bronze, "_ingestion_timestamp", "timestamp").alias("_bronze_ingested_at"),
        (F.current_timestamp() if now is None else now).alias("_silver_processed_at"),
    ).where("product_id is not null and price > 0 and cost >= 0")
    return latest_by(typed, ["product_id", "last_updated"], ["_bronze_ingested_at", "price", "cost", "product_name"])


def conform_customers(bronze: DataFrame) -> DataFrame:
    """Flat customers with hashed e-mail and phone, one row a key and snapshot;
    the address may be a struct or a map."""
    flat = bronze.select(
        "customer_id", "first_name", "last_name", email_hash(F.col("email")).alias("email_hash"), phone_hash(F.col("phone")).alias("phone_hash"),
        F.col("date_of_birth").try_cast("date").alias("date_of_birth"), *[F.col(f"address.{x}").alias(f"address_{x}") for x in ("street", "city", "state", "zip", "country")],
        F.col("signup_date").try_cast("date").alias("signup_date"), "loyalty_tier", "preferred_language", F.col("_snapshot_date").try_cast("date").alias("_snapshot_date"),
    ).where("customer_id is not null and _snapshot_date is not null")
    return latest_by(flat, ["customer_id", "_snapshot_date"], [c for c in flat.columns if c not in ("customer_id", "_snapshot_date")])


def flatten_orders(bronze: DataFrame) -> DataFrame:
    """Typed orders; address and items may be nested or JSON strings."""
    kinds = dict(bronze.dtypes)
    address = F.from_json("shipping_address", ADDRESS) if kinds["shipping_address"] == "string" else F.col("shipping_address")
    items = F.from_json("items", ITEMS) if kinds["items"] == "string" else F.col("items")
    total = F.col("total_amount").try_cast("decimal(12,2)")
    base = bronze.withColumns({"_address": address, "_items": items})
    return base.select(
        "order_id", "customer_id", F.try_to_timestamp(F.col("order_date")).alias("order_date"), "status", total.alias("total_amount"),
        F.coalesce(F.size("_items"), F.lit(0)).alias("item_count"), "payment_method", *[F.col(f"_address.{x}").alias(f"ship_{x}") for x in ("street", "city", "state", "zip", "country")],
        opt_col(base, "discount_code", "string"), F.try_to_timestamp(F.col("_extracted_at")).alias("_extracted_at"),
        opt_col(base, "_source_file", "string").alias("_bronze_source_file"), opt_col(base, "_ingestion_timestamp", "timestamp").alias("_bronze_ingested_at"),
        F.col("_items").alias("items"),
    )


def order_rules(as_of) -> list:
    """Reasons for quarantine; the first that holds is given."""
    return [
        ("NULL_ORDER_ID", F.col("order_id").isNull()),
        ("NULL_CUSTOMER_ID", F.col("customer_id").isNull()),
        ("NON_POSITIVE_TOTAL", F.col("total_amount").isNull() | (F.col("total_amount") <= 0)),
        ("EMPTY_ITEMS", F.coalesce(F.col("item_count"), F.lit(0)) <= 0),
        ("FUTURE_ORDER_DATE", F.col("order_date") > as_of),
    ]


def transform_orders(bronze: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of deduplicated orders: of several records for an order
    the last extracted, then last ingested; rows without an id are all kept."""
    flat = flatten_orders(bronze)
    one = latest_by(flat, ["order_id"], ["_extracted_at", "_bronze_ingested_at", "total_amount", "status"], keep_null_keys=True)
    return split_rejects(one, order_rules(F.current_timestamp() if as_of is None else as_of))


def order_items(orders: DataFrame) -> DataFrame:
    """A row per item; the amount is the product in double, rounded half up."""
    lines = explode_items(orders, "items", ["order_id", "customer_id", "order_date"])
    return lines.select(
        "order_id", "customer_id", "order_date", "line_number", "product_id", "quantity", F.col("unit_price").cast("decimal(10,2)").alias("unit_price"),
        (F.col("quantity") * F.col("unit_price")).cast("decimal(12,2)").alias("line_amount"),
    )


def fact_sales(lines: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their order, the customer version of that day and the last
    product version up to it. Lines without an order vanish; without a version
    they keep nulls."""
    head = orders.select("order_id", "status", "payment_method", "ship_state", "ship_country")
    base = lines.join(head, "order_id").withColumnRenamed("status", "order_status").withColumn("date_key", F.to_date("order_date"))
    versions = customers.select(
        "customer_id", "effective_from", "effective_to", *[F.col(c).alias(f"customer_{c}_at_order_time") for c in ("loyalty_tier",)],
        *[F.col(c).alias(f"customer_{name}_at_order_time") for c, name in (("address_state", "state"), ("address_country", "country"), ("preferred_language", "language"))],
        F.col("first_name").alias("customer_first_name"), F.col("last_name").alias("customer_last_name"),
    )
    with_customer = interval_join(base, versions, ["customer_id"], "date_key").drop("effective_from", "effective_to")
    prices = products.select(
        "product_id", F.col("last_updated").alias("_since"), "product_name", "category", "subcategory", "brand",
        *[F.col(c).alias(f"{c}_at_order_time") for c in ("price", "cost", "margin_pct", "price_band")],
    )
    return asof_join(with_customer, prices, ["product_id"], "date_key", "_since", period_days=90).drop("_since").withColumn("_gold_processed_at", F.current_timestamp())


def apply_snapshot(t: SnapshotTable, snapshot: DataFrame, keys: list[str], tracked: list[str], seq: str, inputs: list[str] | None = None) -> dict[str, int]:
    """One snapshot applied to a table of versions: only files that hold an open
    version which it closes are rewritten; without changes there is no commit."""
    changes = stored(scd2_changes(t.read(), snapshot, keys, tracked), "changes")
    made = {r[0]: r[1] for r in changes.groupBy("_is_new").count().collect()}
    if not made:
        return {"inserted": 0, "updated": 0}
    closing = changes.where("not _is_new").select(*keys)
    touched = t.files_with(t.read().where("is_current"), closing, keys) if made.get(False) else []
    rows = scd2_apply(t.read_files(touched), changes.drop("_is_new", "_row_hash"), keys, tracked, seq)
    metrics = {"inserted": made.get(True, 0), "updated": made.get(False, 0)}
    t.replace(touched, rows, "merge", inputs, metrics)
    return metrics


def pii_vault(bronze: DataFrame) -> DataFrame:
    """One clear-text row per customer, of the latest snapshot."""
    rows = bronze.select("customer_id", "email", "phone", F.col("date_of_birth").try_cast("date").alias("date_of_birth"), F.col("_snapshot_date").try_cast("timestamp").alias("_last_updated"))
    return latest_by(rows.where("customer_id is not null"), ["customer_id"], ["_last_updated", "email", "phone", "date_of_birth"])


@dataclass
class Warehouse:
    """The silver and gold tables under a folder, and the builds that fill them.
    Every build can run again: it then changes nothing."""

    spark: SparkSession
    root: str
    config: Config = Config()

    def table(self, layer: str, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/{getattr(self.config, layer)}/{name}")

    def build_products(self, bronze: DataFrame) -> dict[str, int]:
        source, t = conform_products(bronze), self.table("silver", "products")
        if not t.exists():
            t.overwrite(source, inputs=["bronze.products_raw"])
            return {"inserted": t.read().count(), "updated": 0}
        return t.merge_upsert(source, ["product_id", "last_updated"], PRODUCT_COMPARED)

    def build_customers(self, bronze: DataFrame) -> dict[str, int]:
        """All snapshots newer than the table, in order of date."""
        source, t = conform_customers(bronze), self.table("silver", "dim_customers")
        if not t.exists():
            t.overwrite(scd2_initial(source, ["customer_id"], TRACKED, "_snapshot_date"), inputs=["bronze.customers_raw"])
            return {"versions": t.read().count()}
        last = t.read().agg(F.max("_snapshot_date")).first()[0]
        dates = [r[0] for r in source.where(F.col("_snapshot_date") > F.lit(last)).select("_snapshot_date").distinct().orderBy("_snapshot_date").collect()]
        before = t.read().count()
        for d in dates:  # one commit a snapshot date
            apply_snapshot(t, source.where(F.col("_snapshot_date") == F.lit(d)), ["customer_id"], TRACKED, "_snapshot_date", ["bronze.customers_raw"])
        return {"versions": t.read().count() - before}

    def build_orders(self, bronze: DataFrame, as_of=None) -> dict[str, int]:
        """Header, lines and rejects: headers are first-wins, and lines come only
        with a header that is new."""
        valid, rejects = transform_orders(bronze, as_of)
        orders, items, quarantine = (self.table("silver", n) for n in ("fact_orders", "fact_order_items", "fact_orders_quarantine"))
        headers = valid.drop("items")
        out = {}
        if not orders.exists():
            lines = order_items(valid)
            items.overwrite(lines, inputs=["bronze.orders_raw"])
            orders.overwrite(headers, inputs=["bronze.orders_raw"])
            for name, sql in (("positive_total", "total_amount > 0"), ("non_null_customer", "customer_id is not null"), ("non_empty_items", "item_count > 0")):
                orders.add_constraint(name, sql)
            for name, sql in (("positive_qty", "quantity > 0"), ("non_negative_price", "unit_price >= 0")):
                items.add_constraint(name, sql)
            quarantine.overwrite(rejects.drop("items"), inputs=["bronze.orders_raw"])
            out = {"orders": orders.read().count(), "items": items.read().count(), "rejects": quarantine.read().count()}
        else:
            known = orders.read(orders.entry().version).select("order_id")
            lines = order_items(valid.join(known, "order_id", "left_anti"))
            out["items"] = items.merge_insert_only(lines, ["order_id", "line_number"])["inserted"]
            out["orders"] = orders.merge_insert_only(headers, ["order_id"])["inserted"]
            out["rejects"] = quarantine.merge_insert_only(rejects.drop("items"), ["order_id", "_quarantine_reason"])["inserted"]
        return out

    def build_gold(self) -> dict[str, int]:
        read = lambda n: self.table("silver", n).read()
        fact = self.table("gold", "fact_sales")
        fact.overwrite(
            fact_sales(read("fact_order_items"), read("fact_orders"), read("dim_customers"), read("products")),
            cluster_by=["date_key", "customer_id", "product_id"], inputs=["silver.fact_order_items", "silver.fact_orders", "silver.dim_customers", "silver.products"],
        )
        sales = fact.read().withColumn("cost", F.col("cost_at_order_time"))
        tables = {
            "dim_date": (dim_date(self.spark, "2020-01-01", "2030-12-31"), None),
            "daily_revenue_by_category": (marts.daily_revenue(sales), ["date_key", "category"]),
            "customer_lifetime_value": (marts.customer_lifetime(sales, self.config.as_of, "customer_loyalty_tier_at_order_time"), ["rfm_segment", "customer_id"]),
            "product_performance": (marts.product_performance(sales), ["category", "performance_tier"]),
        }
        for name, (df, cluster) in tables.items():
            self.table("gold", name).overwrite(df, cluster_by=cluster, inputs=["gold.fact_sales"] if name != "dim_date" else [])
        return {n: self.table("gold", n).read().count() for n in ("fact_sales", *tables)}
