"""The query catalogue over the driver's tables: each query applies an operator
of the library to whole tables.

Roles: orders are order headers, lineitem their lines, part the products,
customer the customers, events the click stream. Money is summed as decimals and
given as doubles with two decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import streaming
from .functions import exprs as X
from .operators import rows as R
from .operators import temporal as T
from .plans import governance as G
from .plans import marts, retail
from .plans.datasets import Registry, Task, run_dag
from .session import work_path
from .sources import files, generators
from .sources.table import SnapshotTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "2001-12-31"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str) -> F.Column:
    return F.col(c).cast("date")


def product_columns() -> list:
    size = F.col("p_size")
    return [
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
        F.when(size <= 15, "SMALL").when(size <= 35, "MEDIUM").otherwise("LARGE").alias("subcategory"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"), (F.col("p_retailprice").cast("decimal(10,2)") * F.lit(0.6).cast("decimal(3,1)")).cast("decimal(12,2)").alias("cost"),
    ]


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their header and product."""
    line = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(12,2)").alias("line_amount")
    )
    head = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), day("o_orderdate").alias("date_key"), F.col("o_orderpriority").alias("loyalty_tier")
    )
    return line.join(head, "order_id").join(read(spark, sf_dir, "part").select(*product_columns()), "product_id", "left")


# Gold aggregates ----------------------------------------------------------


@query
def daily_revenue_by_category(spark, sf_dir):
    return marts.daily_revenue(sales(spark, sf_dir))


@query
def customer_lifetime_rfm(spark, sf_dir):
    return marts.customer_lifetime(sales(spark, sf_dir), AS_OF)


@query
def rfm_segment_summary(spark, sf_dir):
    g = customer_lifetime_rfm(spark, sf_dir).groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(F.col("lifetime_revenue").cast("decimal(18,2)")).alias("r"), F.sum("total_orders").alias("o")
    )
    return g.select("rfm_segment", "customers", F.col("r").cast("double").alias("revenue"), F.round(F.col("o").cast("double") / F.col("customers"), 4).alias("avg_orders"))


@query
def product_performance(spark, sf_dir):
    return marts.product_performance(sales(spark, sf_dir))


@query
def category_summary(spark, sf_dir):
    g = sales(spark, sf_dir).groupBy("category").agg(F.sum("line_amount").alias("r"), F.sum("quantity").cast("long").alias("units"), F.count(F.lit(1)).alias("lines"))
    return g.select("category", F.col("r").cast("double").alias("revenue"), "units", F.round(F.col("r").cast("double") / F.col("lines"), 4).alias("avg_line"))


@query
def top_products(spark, sf_dir):
    """The ten products of the largest revenue."""
    g = sales(spark, sf_dir).groupBy("product_id", "product_name").agg(F.sum("line_amount").alias("r"))
    return g.orderBy(F.desc("r"), "product_id").limit(10).select("product_id", "product_name", F.col("r").cast("double").alias("revenue"))


@query
def dim_date(spark, sf_dir):
    return T.dim_date(spark, "2020-01-01", "2030-12-31")


# History and joins in time ------------------------------------------------


def observations(spark, sf_dir) -> DataFrame:
    """One row per customer and day: the priority of the day's last order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"), day("o_orderdate").alias("seen"), "o_orderkey", F.col("o_orderpriority").alias("priority"))
    return R.latest_by(o, ["customer_id", "seen"], ["o_orderkey"]).drop("o_orderkey")


def versions(spark, sf_dir) -> DataFrame:
    return T.scd2_initial(observations(spark, sf_dir), ["customer_id"], ["priority"], "seen")


def version_columns(df: DataFrame) -> DataFrame:
    return df.select("customer_id", "priority", "effective_from", "effective_to", "is_current")


@query
def scd2_customer_history(spark, sf_dir):
    return version_columns(versions(spark, sf_dir))


@query
def scd2_incremental(spark, sf_dir):
    """History up to 1998 in one load, then each customer's first later state as
    one snapshot, through the two-step apply on a stored table."""
    seen = observations(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("date")
    table = SnapshotTable(spark, work_path(spark, "scd2"))
    table.overwrite(T.scd2_initial(seen.where(F.col("seen") < cut), ["customer_id"], ["priority"], "seen"))
    later = seen.where(F.col("seen") >= cut)
    first = R.latest_by(later.withColumn("_back", -F.datediff("seen", cut)), ["customer_id"], ["_back"]).drop("_back")
    retail.apply_snapshot(table, first, ["customer_id"], ["priority"], "seen")
    return version_columns(table.read())


@query
def apply_changes(spark, sf_dir):
    return T.apply_changes(observations(spark, sf_dir), ["customer_id"], "seen", ["priority"]).select(
        "customer_id", "priority", F.col("__START_AT").alias("start_at"), F.col("__END_AT").alias("end_at")
    )


@query
def point_in_time_lookup(spark, sf_dir):
    """Every customer's version on one day."""
    return version_columns(versions(spark, sf_dir)).where(F.lit("1998-06-15").cast("date").between(F.col("effective_from"), F.col("effective_to")))


def shipped(spark, sf_dir) -> DataFrame:
    """Lines by ship date, with their customer."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_partkey", "l_linenumber", day("l_shipdate").alias("ship_day"), "l_extendedprice")
    head = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), day("o_orderdate").alias("order_day"), F.col("o_orderstatus").alias("order_status")
    )
    return line.join(head, "order_id")


@query
def customer_as_of_join(spark, sf_dir):
    """Lines with the customer version of their ship day."""
    joined = T.interval_join(shipped(spark, sf_dir), version_columns(versions(spark, sf_dir)), ["customer_id"], "ship_day")
    return joined.select("order_id", "l_linenumber", "l_partkey", "l_extendedprice", "customer_id", "ship_day", "priority", "effective_from")


def prices(spark, sf_dir) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_partkey"), day("l_shipdate").alias("since")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


@query
def product_price_asof(spark, sf_dir):
    """Lines with the last price of their product up to the order day."""
    joined = T.asof_join(shipped(spark, sf_dir), prices(spark, sf_dir), ["l_partkey"], "order_day", "since")
    return joined.select("order_id", "l_linenumber", "l_partkey", "l_extendedprice", "ship_day", "order_day", "since", "price")


@query
def fact_sales(spark, sf_dir):
    """Lines, headers, the customer version and the price of the order day."""
    with_customer = T.interval_join(shipped(spark, sf_dir), version_columns(versions(spark, sf_dir)), ["customer_id"], "order_day")
    full = T.asof_join(with_customer, prices(spark, sf_dir), ["l_partkey"], "order_day", "since")
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    return full.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "order_id", "l_linenumber", F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("line_amount"), "customer_id", F.col("order_day").alias("date_key"),
        "order_status", F.col("priority").alias("customer_priority_at_order_time"), "category", "brand", F.col("price").alias("price_at_order_time"),
    )


@query
def scd2_version_keys(spark, sf_dir):
    """Every version with its surrogate key."""
    return versions(spark, sf_dir).select("customer_id", "effective_from", "version_id")


@query
def fact_sales_build(spark, sf_dir):
    """The warehouse's own fact builder, over the given tables in its columns."""
    line = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(12,2)").alias("line_amount"),
    )
    o = read(spark, sf_dir, "orders")
    head = o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("payment_method"),
        F.lit("CA").alias("ship_state"), F.lit("US").alias("ship_country"),
    )
    lines = line.join(o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), day("o_orderdate").alias("order_date")), "order_id")
    place = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    person = read(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"),
        F.col("n_name").alias("address_state"), F.col("r_name").alias("address_country"), F.lower(F.substring("n_name", 1, 2)).alias("preferred_language"),
    )
    customers = versions(spark, sf_dir).withColumnRenamed("priority", "loyalty_tier").join(person, "customer_id")
    part = read(spark, sf_dir, "part").select(*product_columns()).withColumns({"margin_pct": X.margin_pct(F.col("price"), F.col("cost")), "price_band": X.price_band(F.col("price"))})
    products = part.withColumn("last_updated", F.explode(F.array(*[F.lit(d).cast("date") for d in ("1992-06-01", "1996-01-01")])))
    products = products.withColumn("price", F.when(F.year("last_updated") > 1995, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(10,2)"))
    return retail.fact_sales(lines, head, customers, products).select(
        "order_id", "line_number", "product_id", "date_key", "order_status", "ship_country", "customer_first_name", "customer_loyalty_tier_at_order_time",
        "customer_state_at_order_time", "customer_country_at_order_time", "customer_language_at_order_time", "category",
        F.col("price_at_order_time").cast("double").alias("price_at_order_time"),
    )


# Deduplication, validation ------------------------------------------------


def landed_orders(spark, sf_dir) -> DataFrame:
    """Orders with the faults that landed records have, by key: a later copy of
    one in 100 and, of others, null customers, bad totals, no items, the future."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(
        F.when(k % 211 != 3, k).alias("order_id"), F.when(k % 199 != 5, F.col("o_custkey")).alias("customer_id"),
        F.when(k % 97 == 7, F.lit(0.0)).when(k % 89 != 11, F.col("o_totalprice")).cast("decimal(12,2)").alias("total_amount"),
        F.when(k % 83 == 13, F.lit(0)).when(k % 79 != 17, F.lit(1)).alias("item_count"),
        F.when(k % 73 == 19, F.lit("2099-01-01").cast("date")).otherwise(day("o_orderdate")).alias("order_date"), F.lit(1).alias("extract"), k.alias("source_key"),
    )
    return o.unionByName(o.where("source_key % 100 = 0").withColumn("extract", F.lit(2)))


def deduplicated(spark, sf_dir) -> DataFrame:
    return R.latest_by(landed_orders(spark, sf_dir), ["order_id"], ["extract", "source_key"], keep_null_keys=True)


def split_orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return R.split_rejects(deduplicated(spark, sf_dir), retail.order_rules(F.lit(AS_OF).cast("date")))


def split_reasons(spark, sf_dir, extract: int) -> DataFrame:
    """Rejects of one extract alone."""
    one = R.latest_by(landed_orders(spark, sf_dir).where(F.col("extract") == extract), ["order_id"], ["source_key"], keep_null_keys=True)
    return R.split_rejects(one, retail.order_rules(F.lit(AS_OF).cast("date")))[1]


@query
def orders_dedup_latest(spark, sf_dir):
    return deduplicated(spark, sf_dir).select("order_id", "source_key", "extract")


@query
def orders_valid(spark, sf_dir):
    return split_orders(spark, sf_dir)[0].select("order_id", "customer_id", F.col("total_amount").cast("double").alias("total_amount"), "order_date")


@query
def orders_quarantine(spark, sf_dir):
    return split_orders(spark, sf_dir)[1].select("source_key", "extract", F.col("_quarantine_reason").alias("reason"))


@query
def quarantine_summary(spark, sf_dir):
    return orders_quarantine(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("rejects"))


@query
def order_items_exploded(spark, sf_dir):
    """Orders' lines as JSON arrays and back to rows, numbered by product, line
    number and amount."""
    line = read(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").alias("amount"))
    packed = line.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"))
    parsed = packed.select("order_id", F.from_json("items", "array<struct<product_id bigint, n int, quantity int, amount double>>").alias("items"))
    return R.explode_items(parsed, "items", ["order_id"])


@query
def event_props_parsed(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "struct<k: int>").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("parsed"), F.sum("p.k").alias("k_sum"), F.max("p.k").alias("k_max"))


@query
def dup_key_count(spark, sf_dir):
    return R.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def versions_histogram(spark, sf_dir):
    per = versions(spark, sf_dir).groupBy("customer_id").agg(F.count(F.lit(1)).alias("versions"))
    return per.groupBy("versions").agg(F.count(F.lit(1)).alias("customers"))


@query
def multi_version_keys(spark, sf_dir):
    return versions(spark, sf_dir).groupBy("customer_id").agg(F.count(F.lit(1)).alias("versions"), F.count_if("is_current").alias("open_versions")).where("versions > 1")


@query
def orders_ranked(spark, sf_dir):
    """All orders by total, ranked in ranges of some thousand rows."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"))
    return R.global_rank(o, [F.col("total"), F.col("order_id")], "rank", "order_id", range_rows=400)[0]


@query
def price_band_distribution(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select(X.price_band(F.col("l_extendedprice") / F.col("l_quantity") / 5).alias("price_band"), "l_extendedprice")
    g = line.groupBy("price_band").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("r"))
    return g.select("price_band", "lines", F.col("r").cast("double").alias("revenue"))


@query
def price_change_products(spark, sf_dir):
    """Lines of the products with the most prices (a semi join with a top-k)."""
    top = prices(spark, sf_dir).groupBy("l_partkey").agg(F.countDistinct("price").alias("n")).where("n > 1").orderBy(F.desc("n"), "l_partkey").limit(20)
    line = read(spark, sf_dir, "lineitem").join(top, "l_partkey", "left_semi")
    return line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


# Versioned tables ---------------------------------------------------------


def products(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


def changed_products(spark, sf_dir) -> DataFrame:
    """The next snapshot: one in 10 has another price, one in 50 loses its
    brand, and new ones have keys from 10,000,000 on."""
    p, k = products(spark, sf_dir), F.col("p_partkey")
    same = p.withColumns({"p_retailprice": F.when(k % 10 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")), "p_brand": F.when(k % 50 != 7, F.col("p_brand"))})
    return same.unionByName(p.where("p_partkey % 20 = 1").withColumn("p_partkey", k + 10_000_000))


COMPARED = ["p_name", "p_brand", "p_size", "p_retailprice"]


@query
def merge_upsert_conditional(spark, sf_dir):
    table = SnapshotTable(spark, work_path(spark, "upsert"))
    table.overwrite(products(spark, sf_dir))
    table.merge_upsert(changed_products(spark, sf_dir), ["p_partkey"], COMPARED)
    return table.read()


@query
def merge_metrics(spark, sf_dir):
    """What a merge and the same merge again report."""
    table = SnapshotTable(spark, work_path(spark, "metrics"))
    table.overwrite(products(spark, sf_dir))
    found = [table.merge_upsert(changed_products(spark, sf_dir), ["p_partkey"], COMPARED) for _ in range(2)]
    rows = [(k, m["inserted"], m["updated"], len(table.versions())) for k, m in enumerate(found, 1)]
    return spark.createDataFrame(rows, "run int, inserted long, updated long, versions int")


@query
def merge_insert_only(spark, sf_dir):
    table = SnapshotTable(spark, work_path(spark, "insert"))
    table.overwrite(products(spark, sf_dir))
    table.merge_insert_only(changed_products(spark, sf_dir), ["p_partkey"])
    return table.read()


@query
def merge_as_plan(spark, sf_dir):
    from .sources.table import merged

    return merged(products(spark, sf_dir), changed_products(spark, sf_dir), ["p_partkey"], COMPARED)


@query
def change_feed(spark, sf_dir):
    table = SnapshotTable(spark, work_path(spark, "feed"))
    table.overwrite(products(spark, sf_dir))
    table.merge_upsert(changed_products(spark, sf_dir), ["p_partkey"], COMPARED)
    return table.changes(0, 1, ["p_partkey"]).withColumnRenamed("_change", "change")


@query
def constraint_rejects(spark, sf_dir):
    """Whether a table takes good rows and refuses a row that breaks a check."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    table = SnapshotTable(spark, work_path(spark, "check"))
    table.overwrite(orders.where("o_totalprice > 0"))
    table.add_constraint("positive_total", "o_totalprice > 0")
    rows = table.read().count()
    try:
        table.append(orders.withColumn("o_totalprice", -F.col("o_totalprice")))
        refused = False
    except Exception as e:
        refused = "positive_total" in str(e)
    same = table.read().count() == rows
    return spark.createDataFrame([(rows, refused, same)], "rows long, refused boolean, unchanged boolean")


@query
def table_history(spark, sf_dir):
    table = SnapshotTable(spark, work_path(spark, "history"))
    table.overwrite(products(spark, sf_dir), cluster_by=["p_brand"])
    table.merge_upsert(changed_products(spark, sf_dir), ["p_partkey"], COMPARED)
    table.compact(2, cluster_by=["p_partkey"])
    return table.history().select("version", "operation", F.col("metrics")["inserted"].alias("inserted"), F.col("metrics")["updated"].alias("updated"))


# Streams ------------------------------------------------------------------


def staged_events(spark, sf_dir, parts: int = 4) -> str:
    path = work_path(spark, "events")
    files.write_jsonl(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string")).repartition(parts, "event_id"), path)
    return path


@query
def stream_ingest_events(spark, sf_dir):
    """JSON files through an available-now stream into a table."""
    path, base = staged_events(spark, sf_dir), work_path(spark, "ingest")
    table = SnapshotTable(spark, f"{base}/table")
    stream = files.add_lineage(files.file_stream(spark, path, "json", f"{base}/schema").select("*", "_metadata"))
    streaming.ingest(stream, table, f"{base}/checkpoint")
    return table.read().select("event_id", "user_id", "event_type", "value")


@query
def stream_ingest_lineage(spark, sf_dir):
    """Rows by whether their lineage is complete, after two runs: the second
    finds no new file and adds none."""
    path, base = staged_events(spark, sf_dir), work_path(spark, "lineage")
    table = SnapshotTable(spark, f"{base}/table")
    added = []
    for _ in range(2):
        stream = files.add_lineage(files.file_stream(spark, path, "json", f"{base}/schema").select("*", "_metadata"))
        added.append(streaming.ingest(stream, table, f"{base}/checkpoint"))
    whole = F.col("_ingestion_timestamp").isNotNull() & F.col("_source_file").endswith(".json") & F.col("_source_file_modified").isNotNull() & (F.col("_source_file_size") > 0)
    return table.read().groupBy(whole.alias("complete")).agg(F.count(F.lit(1)).alias("rows")).withColumn("second_run", F.lit(added[1]).cast("long"))


@query
def bronze_file_counts(spark, sf_dir):
    """Rows of each landed file, once ingested."""
    path, base = work_path(spark, "landed"), work_path(spark, "bronze")
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for k in range(3):
        files.write_jsonl(e.where(F.col("event_id") % 3 == k).coalesce(1), f"{path}/day{k}")
    table = SnapshotTable(spark, f"{base}/table")
    stream = files.add_lineage(files.file_stream(spark, path, "json", f"{base}/schema").select("*", "_metadata"))
    streaming.ingest(stream, table, f"{base}/checkpoint")
    return files.file_counts(table.read()).select(F.regexp_extract("_source_file", r"/(day\d+)/", 1).alias("landing"), "rows")


@query
def stream_ingest_continuous(spark, sf_dir):
    """Ingestion switched to micro-batches on a timer: what is there is taken in,
    then what lands while the query runs; the caller stops it."""
    path, base = work_path(spark, "landing"), work_path(spark, "continuous")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    files.write_jsonl(e.where("event_id % 2 = 0"), f"{path}/first")
    table = SnapshotTable(spark, f"{base}/table")
    stream = files.file_stream(spark, path, "json", f"{base}/schema")
    running = streaming.ingest(stream, table, f"{base}/checkpoint", continuous=True, every="1 second")
    try:
        running.processAllAvailable()
        files.write_jsonl(e.where("event_id % 2 = 1"), f"{path}/second")
        running.processAllAvailable()
    finally:
        running.stop()
    return table.read().select(*e.columns)


@query
def stream_schema_evolution(spark, sf_dir):
    """Files with a new column in the second half: null in the rows before."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    path, base = work_path(spark, "evolving"), work_path(spark, "evolution")
    table = SnapshotTable(spark, f"{base}/table")
    for k, part in enumerate((e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumn("discount_code", F.concat(F.lit("D"), F.col("event_id"))))):
        files.write_jsonl(part, f"{path}/part{k}")
        streaming.ingest(files.file_stream(spark, path, "json", f"{base}/schema"), table, f"{base}/checkpoint")
    return table.read().select("event_id", "event_type", "value", "discount_code")


def event_stream(spark, sf_dir) -> DataFrame:
    source = work_path(spark, "stream")
    e = read(spark, sf_dir, "events")
    e.write.parquet(source)
    return spark.readStream.schema(e.schema).parquet(source)


@query
def stream_apply_changes(spark, sf_dir):
    """A change stream, in two batches and the later half of the keys first,
    into a table of versions."""
    seen = observations(spark, sf_dir)
    base = work_path(spark, "cdc")
    target, log = SnapshotTable(spark, f"{base}/versions"), SnapshotTable(spark, f"{base}/log")
    for k, part in enumerate((seen.where("month(seen) > 6"), seen.where("month(seen) <= 6"))):
        part.write.parquet(f"{base}/landing/part{k}")
        stream = spark.readStream.schema(seen.schema).option("recursiveFileLookup", "true").parquet(f"{base}/landing")
        streaming.apply_changes_into(stream, target, log, ["customer_id"], "seen", ["priority"], f"{base}/checkpoint").awaitTermination()
    return target.read().select("customer_id", "priority", F.col("__START_AT").alias("start_at"), F.col("__END_AT").alias("end_at"))


@query
def stream_dedup_watermark(spark, sf_dir):
    """Every event twice, once within the watermark."""
    e = event_stream(spark, sf_dir)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    base = work_path(spark, "dedup")
    unique = streaming.dedup_within(twice, "ts", ["event_id"], "40 days").select("event_id", "user_id", "event_type")
    return streaming.collect_stream(unique, SnapshotTable(spark, f"{base}/table"), f"{base}/checkpoint")


@query
def stream_window_counts(spark, sf_dir):
    """Events by day and type, in complete mode."""
    base = work_path(spark, "window")
    counts = streaming.windowed_counts(event_stream(spark, sf_dir), "ts", "1 day", ["event_type"])
    out = streaming.collect_stream(counts, SnapshotTable(spark, f"{base}/table"), f"{base}/checkpoint", "complete")
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


@query
def rescued_records(spark, sf_dir):
    """JSON lines, some cut short: what parses and what is rescued."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    path = work_path(spark, "cut")
    e.select(F.when(F.col("event_id") % 100 == 3, F.substring(line, 1, 15)).otherwise(line).alias("value")).write.text(path)
    rows = files.rescue_json(spark.read.text(path).select("*", "_metadata"), spark.createDataFrame([], "event_id long, event_type string").schema)
    kind = F.when(F.col(files.RESCUED).isNull(), "clean").when(F.col("event_type").isNull(), "malformed").otherwise("extra")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("records"))


# Governance ---------------------------------------------------------------


def contacts(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    country = F.element_at(F.array(*[F.lit(x) for x in ("US", "DE", "FR", "GB", "IT")]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return c.select(
        k.alias("customer_id"), F.when(k % 17 != 0, F.concat(F.col("c_name"), F.lit("@Mail.example.com"))).alias("email"),
        F.when(k % 19 != 0, F.concat(F.lit("+1 (555) "), F.lpad(k.cast("string"), 7, "0"))).alias("phone"),
        F.date_add(F.lit("1950-01-01").cast("date"), (k % 18000).cast("int")).alias("date_of_birth"), F.when(k % 23 != 0, country).alias("country"),
    )


@query
def pii_hash(spark, sf_dir):
    return contacts(spark, sf_dir).select("customer_id", X.email_hash(F.col("email")).alias("email_hash"), X.phone_hash(F.col("phone")).alias("phone_hash"))


@query
def masked_view(spark, sf_dir):
    """What members of no privileged group see."""
    return G.secure_view(contacts(spark, sf_dir), {"analysts", "global"}, {"email": "email", "phone": "phone", "date_of_birth": "dob"}, lambda g: X.region_filter(F.col("country"), g))


@query
def bound_masks_and_filter(spark, sf_dir):
    """What an EU analyst reads from a table whose masks and row filter are
    stored with it; one more mask is bound and dropped again."""
    table = SnapshotTable(spark, work_path(spark, "secured"))
    table.overwrite(contacts(spark, sf_dir))
    for column, mask in (("email", "email"), ("phone", "phone"), ("date_of_birth", "dob")):
        G.bind_mask(table, column, mask)
    G.bind_mask(table, "date_of_birth", None)
    G.bind_row_filter(table, "region", "country")
    return G.read_secured(table, {"analysts", "eu"})


@query
def typed_table(spark, sf_dir):
    """A table created with types, columns that refuse nulls, and comments: its
    columns, and the rows that SQL finds in it after good and bad appends."""
    table = SnapshotTable(spark, work_path(spark, "typed"))
    table.create("customer_id bigint not null, email string not null, phone string", "who is who", {"email": "clear text"})
    people = contacts(spark, sf_dir).select("customer_id", "email", "phone")
    table.append(people.where("email is not null"))
    try:
        table.append(people)
        refused = False
    except Exception as e:
        refused = "email_not_null" in str(e)
    table.register("typed_people")
    rows = spark.sql("SELECT count(*) FROM typed_people").first()[0]
    return table.describe().withColumns({"rows": F.lit(rows), "refused": F.lit(refused)})


@query
def masked_by_sql_functions(spark, sf_dir):
    G.create_mask_functions(spark, {"analysts"})
    return contacts(spark, sf_dir).select("customer_id", F.expr("mask_email(email)").alias("email"), F.expr("mask_phone(phone)").alias("phone"), F.expr("mask_dob(date_of_birth)").alias("date_of_birth"))


@query
def row_filter_region(spark, sf_dir):
    c = contacts(spark, sf_dir)
    views = [G.secure_view(c, {g}, {}, lambda s: X.region_filter(F.col("country"), s)).select(F.lit(g).alias("seen_by"), "country") for g in ("us", "eu", "global", "nobody")]
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out.groupBy("seen_by", "country").agg(F.count(F.lit(1)).alias("customers"))


@query
def expectations_summary(spark, sf_dir):
    """Datasets that read each other, with expectations that drop and warn."""
    reg = Registry(spark)

    @reg.dataset("orders_raw")
    def _raw(r):
        return landed_orders(spark, sf_dir)

    @reg.dataset("orders_clean", drop={"has_customer": "customer_id is not null", "positive_total": "total_amount > 0"}, warn={"recent": f"order_date <= date'{AS_OF}'"})
    def _clean(r):
        return R.latest_by(r.read("orders_raw"), ["order_id"], ["extract", "source_key"])

    reg.read("orders_clean")
    return reg.reports["orders_clean"].select("name", "action", F.col("failed").alias("failed"), "total")


@query
def audit_report(spark, sf_dir):
    bronze, (valid, rejects) = landed_orders(spark, sf_dir), split_orders(spark, sf_dir)
    marked = bronze.select(F.lit(0).alias("v")).unionByName(valid.select(F.lit(1).alias("v")))
    current = versions(spark, sf_dir).where("is_current").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    fact = customer_as_of_join(spark, sf_dir)
    return G.audit([
        G.check(marked, "retention", F.round(F.count_if(F.col("v") == 1) / F.count_if(F.col("v") == 0), 6), 0.95, True),
        G.check(fact, "null_priority_share", F.round(F.count_if(F.col("priority").isNull()) / F.count(F.lit(1)), 6), 0.6, False),
        G.check(R.duplicate_keys(valid, ["order_id"]), "duplicate_orders", F.max("duplicates"), 0, False),
        G.check(current, "open_versions", F.max("n"), 1, False),
        G.check(rejects, "rejects_without_reason", F.count_if(F.col("_quarantine_reason").isNull()), 0, False),
        # The run before had the first extracts only.
        G.no_drop(bronze.where("extract = 1"), bronze, "rows_against_last_run"),
        G.no_surge(split_reasons(spark, sf_dir, 1), rejects, "quarantine_against_last_run"),
        G.same_rows(shipped(spark, sf_dir), fact, "lines_without_fact"),
    ])


@query
def grants_matrix(spark, sf_dir):
    return G.grants_matrix(spark)


@query
def tags_by_layer(spark, sf_dir):
    table = SnapshotTable(spark, work_path(spark, "tags"))
    table.overwrite(contacts(spark, sf_dir))
    table.annotate("customers", {"layer": "silver", "pii": "true"}, {"email": {"pii": "email"}, "phone": {"pii": "phone"}})
    return G.tags({"silver.customers": table}, spark)


@query
def lineage_edges(spark, sf_dir):
    base = work_path(spark, "lineage")
    lines, gold = SnapshotTable(spark, f"{base}/lines"), SnapshotTable(spark, f"{base}/gold")
    lines.overwrite(read(spark, sf_dir, "lineitem"), inputs=["bronze.lineitem"])
    gold.overwrite(category_summary(spark, sf_dir), inputs=["silver.lines", "silver.part"])
    return G.lineage({"silver.lines": lines, "gold.categories": gold}, spark, 7).select("source", "target")


# End to end ---------------------------------------------------------------


@query
def retail_end_to_end(spark, sf_dir):
    """Generated sources through bronze, silver and gold, twice: rows a table has
    and rows that the second run added."""
    w = retail.Warehouse(spark, work_path(spark, "retail"))
    data = (
        generators.products(spark, 0, 1000).unionByName(generators.products(spark, 1, 1000)),
        generators.customers(spark, 0, 10_000).unionByName(generators.customers(spark, 7, 10_000)),
        generators.orders(spark, 8, 1500, customers=10_000, products=1000),
    )
    counts: dict[str, list[int]] = {}

    def run() -> None:
        tasks = [
            Task("products", lambda: w.build_products(data[0]), retries=1), Task("customers", lambda: w.build_customers(data[1]), retries=1),
            Task("orders", lambda: w.build_orders(data[2], F.lit("2026-01-01").cast("timestamp")), retries=1),
            Task("gold", w.build_gold, ("products", "customers", "orders"), retries=1),
        ]
        run_dag(tasks)
        for layer, names in (("silver", ("products", "dim_customers", "fact_orders", "fact_order_items", "fact_orders_quarantine")), ("gold", ("dim_date", "fact_sales", "daily_revenue_by_category", "customer_lifetime_value", "product_performance"))):
            for n in names:
                counts.setdefault(f"{layer}.{n}", []).append(w.table(layer, n).read().count())

    run()
    run()
    return spark.createDataFrame([(k, a, b - a) for k, (a, b) in sorted(counts.items())], "table string, rows long, added_by_second_run long")


@query
def clickstream_profile(spark, sf_dir):
    """Generated click stream with cut lines: records, anonymous and malformed."""
    raw = generators.json_lines(generators.clickstream(spark, 3, 5000), 0.001)
    parsed = raw.select(F.from_json("value", "event_id string, user_id string, event_type string").alias("r"))
    return parsed.groupBy(F.coalesce("r.event_type", F.lit("malformed")).alias("event_type")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("r.user_id").isNull()).alias("anonymous"))


@query
def ordered_versions(spark, sf_dir):
    """Every version with its number and the length of the one before (lag)."""
    w = Window.partitionBy("customer_id").orderBy("effective_from")
    v = version_columns(versions(spark, sf_dir))
    return v.select("customer_id", "effective_from", F.row_number().over(w).alias("version"), F.datediff("effective_from", F.lag("effective_from").over(w)).alias("days_since_last"))
