"""Synthetic landed sources, as plans over ``spark.range``: every value follows
from hashes of its day and number, so the same day is the same data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Names and shares that the landed sources have.
BASE_DATE = "2025-01-01"
STATUSES = (("PENDING", 0.05), ("CONFIRMED", 0.15), ("SHIPPED", 0.25), ("DELIVERED", 0.45), ("CANCELLED", 0.07), ("RETURNED", 0.03))
EVENTS = (("page_view", 0.6), ("add_to_cart", 0.12), ("remove_from_cart", 0.05), ("search", 0.15), ("purchase", 0.05), ("wishlist_add", 0.03))
PAYMENTS = ("CARD", "PAYPAL", "BANK_TRANSFER", "GIFT_CARD")
CATEGORIES = ("Electronics", "Home", "Sports", "Beauty", "Toys")
BRANDS = tuple(f"Brand{k}" for k in range(1, 9))
TIERS = ("BRONZE", "SILVER", "GOLD", "PLATINUM")
COUNTRIES = ("US", "DE", "FR", "IT", "ES", "GB")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that follows from the parts."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, (str, int)) else p for p in parts]), F.lit(1 << 30)) / float(1 << 30)


def choose(values: tuple, u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def weighted(values: tuple[tuple[str, float], ...], u: Column) -> Column:
    out, below = F.lit(values[-1][0]), 1.0
    for (v, _), w in zip(reversed(values[:-1]), reversed([w for _, w in values])):
        below -= w
        out = F.when(u < below, v).otherwise(out)
    return out


def _day(offset: int) -> Column:
    return F.date_add(F.lit(BASE_DATE).cast("date"), F.lit(offset))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss+00:00")


def orders(spark: SparkSession, day: int, size: int = 500, batch: int = 0, customers: int = 10000, products: int = 1000, duplicate_rate: float = 0.01) -> DataFrame:
    """A batch of orders: about 0.5 % without a customer, 0.1 % with a negative
    total, duplicates at the given rate, discount_code from day 5 on."""
    n = F.col("id")
    u = lambda name, *more: uniform(name, F.lit(day), F.lit(batch), n, *more)
    count = weighted((("1", 0.4), ("2", 0.3), ("3", 0.15), ("4", 0.1), ("5", 0.05)), u("items")).cast("int")
    item = lambda k: F.struct(
        F.format_string("PROD_%05d", F.floor(u("product", k) * products).cast("int")).alias("product_id"),
        (F.floor(u("quantity", k) * 3) + 1).cast("int").alias("quantity"), F.round(5 + u("price", k) * 495, 2).alias("unit_price"),
    )
    rows = spark.range(size).withColumn("items", F.transform(F.sequence(F.lit(1), count), item))
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["quantity"] * x["unit_price"])
    at = _iso(F.timestamp_seconds(F.unix_timestamp(_day(day).cast("timestamp")) + F.floor(u("second") * 86400)))
    made = rows.select(
        F.format_string("ORD-%d-%d-%06d", F.lit(day), F.lit(batch), n).alias("order_id"),
        F.when(u("anonymous") >= 0.005, F.format_string("CUST_%06d", F.floor(u("customer") * customers).cast("int"))).alias("customer_id"),
        at.alias("order_date"), weighted(STATUSES, u("status")).alias("status"), "items",
        F.round(F.when(u("negative") < 0.001, -total).otherwise(total), 2).alias("total_amount"),
        F.struct(F.format_string("%d Main St", n).alias("street"), F.lit("Springfield").alias("city"), choose(("CA", "NY", "TX", "California"), u("state")).alias("state"),
                 F.format_string("%05d", (u("zip") * 99999).cast("int")).alias("zip"), choose(COUNTRIES, u("country")).alias("country")).alias("shipping_address"),
        choose(PAYMENTS, u("payment")).alias("payment_method"), at.alias("_extracted_at"),
        *([F.when(u("discount") >= 0.7, F.format_string("SAVE%02d", (u("code") * 50).cast("int"))).alias("discount_code")] if day >= 5 else []),
        u("twice").alias("_twice"),
    )
    return made.unionByName(made.where(F.col("_twice") < duplicate_rate)).drop("_twice")


def products(spark: SparkSession, day: int, size: int = 1000) -> DataFrame:
    """A snapshot: prices move by up to 15 % on about one day in twenty; the
    other attributes follow from the product alone."""
    n = F.col("id")
    base = 5 + uniform("price", n) * 495
    move = F.when(uniform("moves", n, day) < 0.05, 1 + (uniform("move", n, day) - 0.5) * 0.3).otherwise(1.0)
    price = F.round(base * move, 2)
    category = choose(CATEGORIES, uniform("category", n))
    return spark.range(size).select(
        F.format_string("PROD_%05d", n).alias("product_id"), F.format_string("Product %d", n).alias("product_name"), category.alias("category"),
        F.concat(category, F.lit("-"), (F.floor(uniform("sub", n) * 5) + 1).cast("string")).alias("subcategory"), choose(BRANDS, uniform("brand", n)).alias("brand"),
        price.alias("price"), F.round(price * 0.6, 2).alias("cost"), F.round(0.1 + uniform("weight", n) * 10, 3).alias("weight_kg"),
        (uniform("active", n, day) >= 0.02).alias("is_active"), _day(day).cast("string").alias("last_updated"),
    )


def customers(spark: SparkSession, day: int, size: int = 10000) -> DataFrame:
    """A weekly snapshot: one customer in 33 has moved, 5 % draw a new tier."""
    n, week = F.col("id"), day // 7
    moved = F.when(uniform("moves", n, week) < 1 / 33, F.lit(week)).otherwise(0)
    tier = F.when(uniform("retier", n, week) < 0.05, choose(TIERS, uniform("tier", n, week))).otherwise(choose(TIERS, uniform("tier", n)))
    return spark.range(size).select(
        F.format_string("CUST_%06d", n).alias("customer_id"), F.format_string("First%d", n).alias("first_name"), F.format_string("Last%d", n % 997).alias("last_name"),
        F.format_string("user%d@mail.example.com", n).alias("email"), F.format_string("+1 (555) %07d", n).alias("phone"),
        F.date_add(F.lit("1950-01-01").cast("date"), (uniform("born", n) * 20000).cast("int")).cast("string").alias("date_of_birth"),
        F.date_add(F.lit("2020-01-01").cast("date"), (uniform("signup", n) * 1800).cast("int")).cast("string").alias("signup_date"),
        tier.alias("loyalty_tier"), choose(("en", "de", "fr", "es"), uniform("language", n)).alias("preferred_language"), _day(day).cast("string").alias("_snapshot_date"),
        F.struct(F.concat((F.pmod(F.xxhash64(n, moved), F.lit(9999))).cast("string"), F.lit(" Oak Ave")).alias("street"), F.lit("Springfield").alias("city"),
                 choose(("CA", "NY", "TX"), uniform("state", n, moved)).alias("state"), F.lit("12345").alias("zip"), choose(COUNTRIES, uniform("country", n)).alias("country")).alias("address"),
    )


def clickstream(spark: SparkSession, day: int, size: int = 2000, batch: int = 0, products: int = 1000) -> DataFrame:
    """Events: 5 % up to a day early, 30 % anonymous."""
    n = F.col("id")
    u = lambda name: uniform(name, day, batch, n)
    second = F.unix_timestamp(_day(day).cast("timestamp")) + F.floor(u("second") * 86400) - F.when(u("late") < 0.05, F.floor(u("by") * 86400)).otherwise(0)
    kind = weighted(EVENTS, u("event"))
    return spark.range(size).select(
        F.format_string("EVT-%d-%d-%06d", F.lit(day), F.lit(batch), n).alias("event_id"), F.when(u("anon") >= 0.3, F.format_string("CUST_%06d", (u("user") * 10000).cast("int"))).alias("user_id"),
        F.format_string("S%08d", (u("session") * 1e8).cast("int")).alias("session_id"), kind.alias("event_type"), _iso(F.timestamp_seconds(second)).alias("event_timestamp"),
        F.concat(F.lit("/p/"), n.cast("string")).alias("page_url"), F.when(kind != "search", F.format_string("PROD_%05d", (u("product") * products).cast("int"))).alias("product_id"),
        F.struct(choose(("mobile", "desktop", "tablet"), u("type")).alias("type"), choose(("iOS", "Android", "Windows"), u("os")).alias("os"), choose(("Safari", "Chrome", "Firefox"), u("browser")).alias("browser")).alias("device"),
        F.struct(choose(COUNTRIES, u("country")).alias("country"), F.lit("R1").alias("region"), F.lit("C1").alias("city")).alias("geo"),
    )


def json_lines(df: DataFrame, truncate_rate: float = 0.0) -> DataFrame:
    """Rows as JSON text, a part of the lines cut in the middle."""
    line = F.to_json(F.struct(*df.columns))
    cut = uniform("cut", line) < truncate_rate
    return df.select(F.when(cut, F.substring(line, 1, 20)).otherwise(line).alias("value"))


def land_day(spark: SparkSession, root: str, day: int, orders_per_batch: int = 500, clicks_per_batch: int = 2000, batches: int = 3) -> list[str]:
    """Land a day's files below ``root``: batches of orders as JSON lines, the
    products as CSV, on every seventh day the customers as Parquet, and twice as
    many batches of clicks, one line in 1,000 cut. The folders written; landing a
    day again writes the same files anew."""
    made = []

    def path(kind: str, name: str) -> str:
        made.append(f"{root}/{kind}/{name}")
        return made[-1]

    for b in range(batches):
        files.write_jsonl(orders(spark, day, orders_per_batch, b).coalesce(1), path("orders", f"day{day:03d}_batch{b:02d}"))
    files.write_csv(products(spark, day).coalesce(1), path("products", f"day{day:03d}"))
    if day % 7 == 0:
        files.write_parquet_file(customers(spark, day), path("customers", f"week_{day // 7:03d}"))
    for b in range(2 * batches):
        lines = json_lines(clickstream(spark, day, clicks_per_batch, b), 0.001)
        lines.coalesce(1).write.mode("overwrite").text(path("clickstream", f"day{day:03d}_batch{b:02d}"))
    return made
