"""Fact and aggregate builders over conformed columns.

Lines have order_id, product_id, quantity, line_amount (decimal), customer_id
and date_key, and product attributes where a builder names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import performance_tier, rfm_segment
from ..operators.rows import global_ntile
from ..session import work_path


def _money(c: Column) -> Column:
    """An exact decimal sum, as a double with two decimals."""
    return F.round(c, 2).cast("double")


def _per(amount: Column, n: Column) -> Column:
    """A decimal amount over a count, to two decimals, half up: in whole cents,
    so that no binary fraction decides a tie. Null over 0."""
    cents = (amount * 100).cast("long")
    whole = F.floor((2 * cents + n).cast("decimal(38,0)") / F.nullif(2 * n, F.lit(0)).cast("decimal(19,0)"))
    return whole.cast("double") / 100


def daily_revenue(lines: DataFrame) -> DataFrame:
    """By day, category and subcategory; rows without a category are left out."""
    revenue, cost = F.sum("line_amount"), F.sum(F.col("quantity") * F.col("cost"))
    g = lines.where("category is not null").groupBy("date_key", "category", "subcategory").agg(
        F.countDistinct("order_id").alias("orders"), F.sum("quantity").alias("units_sold"), revenue.alias("r"), cost.alias("c")
    )
    margin = F.col("r") - F.col("c")
    pct = F.round(margin.cast("double") / F.nullif(F.col("r").cast("double"), F.lit(0.0)) * 100, 2)
    return g.select(
        "date_key", "category", "subcategory", "orders", F.col("units_sold").cast("long").alias("units_sold"),
        _money(F.col("r")).alias("revenue"), _money(F.col("c")).alias("total_cost"), _money(margin).alias("gross_margin"), pct.alias("gross_margin_pct"),
    )


def customer_lifetime(lines: DataFrame, as_of: str, tier: str = "loyalty_tier") -> DataFrame:
    """By customer: recency, frequency and monetary value, their quintiles over
    all customers, and the segment. The tier is that of the last order. Lines are
    summed by order and day first, so that distinct counts multiply those alone."""
    today = F.lit(as_of).cast("date")
    g = lines.where("customer_id is not null").groupBy("customer_id", "order_id", "date_key").agg(
        F.sum("line_amount").alias("m"), F.count("line_amount").alias("n"), F.max_by(tier, F.struct("date_key", "order_id")).alias("tier")
    )
    g = g.groupBy("customer_id").agg(
        F.max("date_key").alias("last_order_date"), F.min("date_key").alias("first_order_date"), F.countDistinct("order_id").alias("total_orders"),
        F.sum("m").alias("m"), F.sum("n").alias("n"), F.countDistinct("date_key").alias("distinct_order_days"),
        F.max_by("tier", F.struct("date_key", "order_id")).alias("latest_loyalty_tier"),
    )
    g = g.select(
        "customer_id", "last_order_date", "first_order_date", "total_orders", _money(F.col("m")).alias("lifetime_revenue"), "m",
        _per(F.col("m"), F.col("n")).alias("avg_line_value"), "distinct_order_days", "latest_loyalty_tier",
        F.datediff(today, "last_order_date").alias("days_since_last_order"), F.datediff("last_order_date", "first_order_date").alias("customer_tenure_days"),
    )
    # Stored, as each quintile also samples and counts it.
    path = work_path(lines.sparkSession, "customers")
    g.write.parquet(path)
    stored = g = lines.sparkSession.read.schema(g.schema).parquet(path)
    key = F.col("customer_id")
    g = global_ntile(g, 5, [-F.col("days_since_last_order"), key], "recency_score", "customer_id", stored)
    g = global_ntile(g, 5, [F.col("total_orders"), key], "frequency_score", "customer_id", stored)
    g = global_ntile(g, 5, [F.col("m"), key], "monetary_score", "customer_id", stored)
    return g.drop("m").withColumn("rfm_segment", rfm_segment(F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")))


def product_performance(lines: DataFrame) -> DataFrame:
    """By product: distinct orders, customers and days, units and revenue. Lines
    are summed by order, customer and day first."""
    names = [F.min(c).alias(c) for c in ("product_name", "category", "brand")]
    g = lines.where("product_id is not null").groupBy("product_id", "order_id", "customer_id", "date_key").agg(
        *names, F.sum("quantity").alias("quantity"), F.sum("line_amount").alias("line_amount")
    )
    g = g.groupBy("product_id").agg(
        *names, F.countDistinct("order_id").alias("total_orders"), F.countDistinct("customer_id").alias("unique_customers"),
        F.sum("quantity").cast("long").alias("total_units_sold"), F.sum("line_amount").alias("r"),
        F.countDistinct("date_key").alias("days_with_sales"), F.max("date_key").alias("last_sale_date"),
    )
    r = F.col("r")
    return g.select(
        "product_id", "product_name", "category", "brand", "total_orders", "unique_customers", "total_units_sold", _money(r).alias("total_revenue"),
        _per(r, F.col("total_units_sold")).alias("avg_selling_price"), _per(r, F.col("days_with_sales")).alias("avg_daily_revenue"),
        "days_with_sales", "last_sale_date", performance_tier(r).alias("performance_tier"),
    )
