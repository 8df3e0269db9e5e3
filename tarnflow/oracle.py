"""DuckDB SQL for the query catalogue, written apart from the Spark plans."""

from __future__ import annotations

_SALES = """
SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS line_amount,
  o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS date_key, o_orderpriority AS loyalty_tier, p_name AS product_name, p_type AS category,
  CASE WHEN p_size <= 15 THEN 'SMALL' WHEN p_size <= 35 THEN 'MEDIUM' ELSE 'LARGE' END AS subcategory, p_brand AS brand,
  CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.6 AS DECIMAL(3,1)) AS DECIMAL(12,2)) AS cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
"""

def _per(amount: str, n: str) -> str:
    """Half up to two decimals, in whole cents."""
    return f"CAST((2 * CAST({amount} * 100 AS HUGEINT) + {n}) // nullif(2 * {n}, 0) AS DOUBLE) / 100"


_RFM = f"""
WITH s AS ({_SALES}),
g AS (
  SELECT customer_id, max(date_key) AS last_order_date, min(date_key) AS first_order_date, count(DISTINCT order_id) AS total_orders, sum(line_amount) AS m,
    {_per("sum(line_amount)", "count(line_amount)")} AS avg_line_value, count(DISTINCT date_key) AS distinct_order_days,
    first(loyalty_tier ORDER BY date_key DESC, order_id DESC) AS latest_loyalty_tier,
    CAST(date_diff('day', max(date_key), DATE '2001-12-31') AS INTEGER) AS days_since_last_order,
    CAST(date_diff('day', min(date_key), max(date_key)) AS INTEGER) AS customer_tenure_days
  FROM s WHERE customer_id IS NOT NULL GROUP BY customer_id
),
t AS (
  SELECT customer_id, last_order_date, first_order_date, total_orders, CAST(m AS DOUBLE) AS lifetime_revenue, avg_line_value, distinct_order_days, latest_loyalty_tier,
    days_since_last_order, customer_tenure_days,
    CAST(ntile(5) OVER (ORDER BY days_since_last_order DESC, customer_id) AS INTEGER) AS recency_score,
    CAST(ntile(5) OVER (ORDER BY total_orders, customer_id) AS INTEGER) AS frequency_score,
    CAST(ntile(5) OVER (ORDER BY m, customer_id) AS INTEGER) AS monetary_score
  FROM g
)
SELECT *, CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'CHAMPION' WHEN recency_score >= 4 AND monetary_score >= 4 THEN 'BIG_SPENDER'
  WHEN recency_score >= 4 THEN 'RECENT' WHEN recency_score <= 2 AND frequency_score >= 4 THEN 'AT_RISK' WHEN recency_score <= 1 THEN 'LOST' ELSE 'REGULAR' END AS rfm_segment
FROM t
"""

_SEEN = """
SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS seen, first(o_orderpriority ORDER BY o_orderkey DESC) AS priority FROM orders GROUP BY ALL
"""


def _history(seen: str) -> str:
    return f"""
SELECT customer_id, priority, seen AS effective_from,
  coalesce(CAST(lead(seen) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS effective_to, lead(seen) OVER w IS NULL AS is_current
FROM (
  SELECT *, lag(priority) OVER (PARTITION BY customer_id ORDER BY seen) AS before, row_number() OVER (PARTITION BY customer_id ORDER BY seen) AS n FROM ({seen})
) WHERE n = 1 OR before IS DISTINCT FROM priority WINDOW w AS (PARTITION BY customer_id ORDER BY seen)
"""


_VERSIONS = _history(_SEEN)
_SHIPPED = """
SELECT l_orderkey AS order_id, l_partkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_day, l_extendedprice, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_day,
  o_orderstatus AS order_status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
_PRICES = "SELECT l_partkey, CAST(l_shipdate AS DATE) AS since, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY ALL"
_LANDED = """
SELECT CASE WHEN k % 211 <> 3 THEN k END AS order_id, CASE WHEN k % 199 <> 5 THEN o_custkey END AS customer_id,
  CAST(CASE WHEN k % 97 = 7 THEN 0.0 WHEN k % 89 <> 11 THEN o_totalprice END AS DECIMAL(12,2)) AS total_amount,
  CASE WHEN k % 83 = 13 THEN 0 WHEN k % 79 <> 17 THEN 1 END AS item_count,
  CASE WHEN k % 73 = 19 THEN DATE '2099-01-01' ELSE CAST(o_orderdate AS DATE) END AS order_date, x AS extract, k AS source_key
FROM (SELECT *, o_orderkey AS k, unnest(CASE WHEN o_orderkey % 100 = 0 THEN [1, 2] ELSE [1] END) AS x FROM orders)
"""
_DEDUP = f"""
SELECT * EXCLUDE rn FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY extract DESC, source_key DESC) AS rn FROM ({_LANDED})
) WHERE rn = 1 OR order_id IS NULL
"""
_REASON = f"""
SELECT *, CASE WHEN order_id IS NULL THEN 'NULL_ORDER_ID' WHEN customer_id IS NULL THEN 'NULL_CUSTOMER_ID' WHEN total_amount IS NULL OR total_amount <= 0 THEN 'NON_POSITIVE_TOTAL'
  WHEN coalesce(item_count, 0) <= 0 THEN 'EMPTY_ITEMS' WHEN order_date > DATE '2001-12-31' THEN 'FUTURE_ORDER_DATE' END AS reason
FROM ({_DEDUP})
"""
_PRODUCTS = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"
_CHANGED = """
SELECT p_partkey, p_name, CASE WHEN p_partkey % 50 <> 7 THEN p_brand END AS p_brand, p_size,
  CASE WHEN p_partkey % 10 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part
UNION ALL SELECT p_partkey + 10000000, p_name, p_brand, p_size, p_retailprice FROM part WHERE p_partkey % 20 = 1
"""
_CONTACTS = """
SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 17 <> 0 THEN c_name || '@Mail.example.com' END AS email,
  CASE WHEN c_custkey % 19 <> 0 THEN '+1 (555) ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS phone,
  CAST(DATE '1950-01-01' + CAST(c_custkey % 18000 AS INTEGER) AS DATE) AS date_of_birth,
  CASE WHEN c_custkey % 23 <> 0 THEN (['US', 'DE', 'FR', 'GB', 'IT'])[c_nationkey % 5 + 1] END AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
_MASKED = """
CASE WHEN email IS NOT NULL THEN left(email, 4) || '****@****' END AS email,
CASE WHEN phone IS NOT NULL THEN '***-***-' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) END AS phone,
CAST(date_trunc('year', date_of_birth) AS DATE) AS date_of_birth
"""

ORACLE_SQL: dict[str, str] = {
    "daily_revenue_by_category": f"""
WITH g AS (
  SELECT date_key, category, subcategory, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units_sold, sum(line_amount) AS r, sum(quantity * cost) AS c
  FROM ({_SALES}) WHERE category IS NOT NULL GROUP BY ALL
)
SELECT date_key, category, subcategory, orders, units_sold, CAST(r AS DOUBLE) AS revenue, CAST(c AS DOUBLE) AS total_cost, CAST(r - c AS DOUBLE) AS gross_margin,
  round(CAST(r - c AS DOUBLE) / nullif(CAST(r AS DOUBLE), 0) * 100, 2) AS gross_margin_pct FROM g
""",
    "customer_lifetime_rfm": _RFM,
    "rfm_segment_summary": f"""
SELECT rfm_segment, count(*) AS customers, CAST(sum(CAST(lifetime_revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  round(CAST(sum(total_orders) AS DOUBLE) / count(*), 4) AS avg_orders FROM ({_RFM}) GROUP BY rfm_segment
""",
    "product_performance": f"""
SELECT product_id, min(product_name) AS product_name, min(category) AS category, min(brand) AS brand, count(DISTINCT order_id) AS total_orders,
  count(DISTINCT customer_id) AS unique_customers, CAST(sum(quantity) AS BIGINT) AS total_units_sold, CAST(sum(line_amount) AS DOUBLE) AS total_revenue,
  {_per("sum(line_amount)", "sum(quantity)")} AS avg_selling_price,
  {_per("sum(line_amount)", "count(DISTINCT date_key)")} AS avg_daily_revenue, count(DISTINCT date_key) AS days_with_sales,
  max(date_key) AS last_sale_date,
  CASE WHEN sum(line_amount) > 50000 THEN 'TOP' WHEN sum(line_amount) > 10000 THEN 'MID' WHEN sum(line_amount) > 1000 THEN 'LOW' ELSE 'MINIMAL' END AS performance_tier
FROM ({_SALES}) GROUP BY product_id
""",
    "category_summary": f"""
SELECT category, CAST(sum(line_amount) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS units, round(CAST(sum(line_amount) AS DOUBLE) / count(*), 4) AS avg_line
FROM ({_SALES}) GROUP BY category
""",
    "top_products": f"""
SELECT product_id, product_name, CAST(sum(line_amount) AS DOUBLE) AS revenue FROM ({_SALES}) GROUP BY ALL ORDER BY sum(line_amount) DESC, product_id LIMIT 10
""",
    "dim_date": """
SELECT d AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
  CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
  dayofweek(d) IN (0, 6) AS is_weekend,
  'FY' || year(d) || '-' || CASE WHEN month(d) IN (2, 3, 4) THEN 'Q1' WHEN month(d) IN (5, 6, 7) THEN 'Q2' WHEN month(d) IN (8, 9, 10) THEN 'Q3' ELSE 'Q4' END AS fiscal_quarter,
  day(d) = 1 AS is_month_start, d = last_day(d) AS is_month_end, strftime(d, '%m-%d') IN ('12-25', '07-04', '01-01') AS is_holiday_us, strftime(d, '%Y-%m-%d') AS date_iso
FROM (SELECT CAST(unnest(generate_series(DATE '2020-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
""",
    "scd2_customer_history": _VERSIONS,
    "scd2_incremental": _history(f"""
SELECT customer_id, seen, priority FROM ({_SEEN}) WHERE seen < DATE '1998-01-01'
UNION ALL SELECT customer_id, min(seen), first(priority ORDER BY seen) FROM ({_SEEN}) WHERE seen >= DATE '1998-01-01' GROUP BY customer_id
"""),
    "apply_changes": f"""
SELECT customer_id, priority, effective_from AS start_at, lead(effective_from) OVER (PARTITION BY customer_id ORDER BY effective_from) AS end_at FROM ({_VERSIONS})
""",
    "point_in_time_lookup": f"SELECT * FROM ({_VERSIONS}) WHERE DATE '1998-06-15' BETWEEN effective_from AND effective_to",
    "customer_as_of_join": f"""
SELECT order_id, l_linenumber, l_partkey, l_extendedprice, s.customer_id, ship_day, priority, effective_from
FROM ({_SHIPPED}) s LEFT JOIN ({_VERSIONS}) v ON s.customer_id = v.customer_id AND ship_day BETWEEN effective_from AND effective_to
""",
    "product_price_asof": f"""
SELECT order_id, l_linenumber, s.l_partkey, l_extendedprice, ship_day, order_day, since, price
FROM ({_SHIPPED}) s ASOF LEFT JOIN ({_PRICES}) p ON s.l_partkey = p.l_partkey AND order_day >= since
""",
    "fact_sales": f"""
SELECT order_id, l_linenumber, s.l_partkey AS product_id, l_extendedprice AS line_amount, s.customer_id, order_day AS date_key, order_status,
  priority AS customer_priority_at_order_time, p_type AS category, p_brand AS brand, price AS price_at_order_time
FROM (SELECT x.*, since, price FROM ({_SHIPPED}) x ASOF LEFT JOIN ({_PRICES}) p ON x.l_partkey = p.l_partkey AND order_day >= since) s
LEFT JOIN ({_VERSIONS}) v ON s.customer_id = v.customer_id AND order_day BETWEEN effective_from AND effective_to
LEFT JOIN part ON s.l_partkey = p_partkey
""",
    "scd2_version_keys": f"""
SELECT customer_id, effective_from, sha256(CAST(customer_id AS VARCHAR) || '||' || strftime(effective_from, '%Y-%m-%d')) AS version_id FROM ({_VERSIONS})
""",
    "fact_sales_build": f"""
WITH p AS (
  SELECT p_partkey, p_type, CAST(p_retailprice AS DECIMAL(10,2)) AS price, DATE '1992-06-01' AS since FROM part
  UNION ALL SELECT p_partkey, p_type, CAST(p_retailprice AS DECIMAL(10,2)) + 1, DATE '1996-01-01' FROM part
),
c AS (
  SELECT v.*, c_name, n_name, r_name FROM ({_VERSIONS}) v JOIN customer ON v.customer_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
SELECT s.order_id, l_linenumber AS line_number, s.l_partkey AS product_id, s.order_day AS date_key, order_status, 'US' AS ship_country, c_name AS customer_first_name,
  priority AS customer_loyalty_tier_at_order_time, n_name AS customer_state_at_order_time, r_name AS customer_country_at_order_time,
  lower(left(n_name, 2)) AS customer_language_at_order_time, p_type AS category, CAST(price AS DOUBLE) AS price_at_order_time
FROM ({_SHIPPED}) s LEFT JOIN c ON s.customer_id = c.customer_id AND s.order_day BETWEEN effective_from AND effective_to
ASOF LEFT JOIN p ON s.l_partkey = p.p_partkey AND s.order_day >= p.since
""",
    "orders_dedup_latest": f"SELECT order_id, source_key, extract FROM ({_DEDUP})",
    "orders_valid": f"SELECT order_id, customer_id, CAST(total_amount AS DOUBLE) AS total_amount, order_date FROM ({_REASON}) WHERE reason IS NULL",
    "orders_quarantine": f"SELECT source_key, extract, reason FROM ({_REASON}) WHERE reason IS NOT NULL",
    "quarantine_summary": f"SELECT reason, count(*) AS rejects FROM ({_REASON}) WHERE reason IS NOT NULL GROUP BY reason",
    "order_items_exploded": """
SELECT l_orderkey AS order_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, CAST(l_quantity AS INTEGER), l_extendedprice) AS INTEGER) AS line_number,
  l_partkey AS product_id, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS amount FROM lineitem
""",
    "event_props_parsed": """
SELECT event_type, count(k) AS parsed, CAST(sum(k) AS BIGINT) AS k_sum, max(k) AS k_max
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type
""",
    "dup_key_count": """
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, CAST(sum(n) - count(*) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
""",
    "versions_histogram": f"SELECT versions, count(*) AS customers FROM (SELECT count(*) AS versions FROM ({_VERSIONS}) GROUP BY customer_id) GROUP BY versions",
    "multi_version_keys": f"SELECT customer_id, count(*) AS versions, count(*) FILTER (is_current) AS open_versions FROM ({_VERSIONS}) GROUP BY customer_id HAVING count(*) > 1",
    "orders_ranked": "SELECT o_orderkey AS order_id, o_totalprice AS total, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders",
    "price_band_distribution": """
SELECT CASE WHEN p < 50 THEN 'BUDGET' WHEN p < 200 THEN 'MID' ELSE 'PREMIUM' END AS price_band, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM (SELECT l_extendedprice / l_quantity / 5 AS p, l_extendedprice FROM lineitem) GROUP BY 1
""",
    "price_change_products": f"""
SELECT l_partkey, count(*) AS lines, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem WHERE l_partkey IN (
  SELECT l_partkey FROM ({_PRICES}) GROUP BY l_partkey HAVING count(DISTINCT price) > 1 ORDER BY count(DISTINCT price) DESC, l_partkey LIMIT 20
) GROUP BY l_partkey
""",
    "merge_upsert_conditional": _CHANGED,
    "merge_as_plan": _CHANGED,
    "merge_metrics": f"""
WITH d AS (
  SELECT count(*) FILTER (t.p_partkey IS NULL) AS inserted,
    count(*) FILTER (t.p_partkey IS NOT NULL AND (s.p_brand IS DISTINCT FROM t.p_brand OR s.p_retailprice IS DISTINCT FROM t.p_retailprice)) AS updated
  FROM ({_CHANGED}) s LEFT JOIN ({_PRODUCTS}) t ON s.p_partkey = t.p_partkey
)
SELECT 1 AS run, inserted, updated, 2 AS versions FROM d UNION ALL SELECT 2, 0, 0, 2
""",
    "merge_insert_only": f"{_PRODUCTS} UNION ALL SELECT * FROM ({_CHANGED}) WHERE p_partkey >= 10000000",
    "change_feed": f"""
WITH b AS (
  SELECT t.p_partkey IS NULL AS is_new, s.p_partkey AS k, s AS s, t AS t FROM ({_CHANGED}) s LEFT JOIN ({_PRODUCTS}) t ON s.p_partkey = t.p_partkey
  WHERE t.p_partkey IS NULL OR s.p_brand IS DISTINCT FROM t.p_brand OR s.p_retailprice IS DISTINCT FROM t.p_retailprice
)
SELECT CASE WHEN is_new THEN 'insert' ELSE 'update_after' END AS change, s.* FROM b
UNION ALL SELECT 'update_before', t.* FROM b WHERE NOT is_new
""",
    "constraint_rejects": "SELECT count(*) AS rows, true AS refused, true AS unchanged FROM orders WHERE o_totalprice > 0",
    "table_history": f"""
WITH d AS (
  SELECT count(*) FILTER (t.p_partkey IS NULL) AS i,
    count(*) FILTER (t.p_partkey IS NOT NULL AND (s.p_brand IS DISTINCT FROM t.p_brand OR s.p_retailprice IS DISTINCT FROM t.p_retailprice)) AS u
  FROM ({_CHANGED}) s LEFT JOIN ({_PRODUCTS}) t ON s.p_partkey = t.p_partkey
)
SELECT 0 AS version, 'overwrite' AS operation, NULL AS inserted, NULL AS updated UNION ALL SELECT 1, 'merge', i, u FROM d UNION ALL SELECT 2, 'optimize', NULL, NULL
""",
    "stream_ingest_events": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_ingest_lineage": "SELECT true AS complete, count(*) AS rows, CAST(0 AS BIGINT) AS second_run FROM events",
    "bronze_file_counts": "SELECT 'day' || (event_id % 3) AS landing, count(*) AS rows FROM events GROUP BY ALL",
    "stream_ingest_continuous": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_schema_evolution": "SELECT event_id, event_type, value, CASE WHEN event_id % 2 = 1 THEN 'D' || event_id END AS discount_code FROM events",
    "stream_apply_changes": f"""
SELECT customer_id, priority, effective_from AS start_at, lead(effective_from) OVER (PARTITION BY customer_id ORDER BY effective_from) AS end_at FROM ({_VERSIONS})
""",
    "stream_dedup_watermark": "SELECT event_id, user_id, event_type FROM events",
    "stream_window_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "rescued_records": """
SELECT kind, count(*) AS records FROM (SELECT CASE WHEN event_id % 100 = 3 THEN 'malformed' ELSE 'extra' END AS kind FROM events) GROUP BY kind
""",
    "pii_hash": f"SELECT customer_id, sha256(lower(email)) AS email_hash, sha256(regexp_replace(phone, '[^0-9]', '', 'g')) AS phone_hash FROM ({_CONTACTS})",
    "masked_view": f"SELECT customer_id, {_MASKED}, country FROM ({_CONTACTS})",
    "bound_masks_and_filter": f"""
SELECT customer_id, CASE WHEN email IS NOT NULL THEN left(email, 4) || '****@****' END AS email,
  CASE WHEN phone IS NOT NULL THEN '***-***-' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) END AS phone, date_of_birth, country
FROM ({_CONTACTS}) WHERE country IN ('DE', 'FR', 'IT', 'ES', 'NL', 'BE')
""",
    "typed_table": f"""
SELECT c AS "column", t AS type, n AS nullable, x AS comment, (SELECT count(*) FROM ({_CONTACTS}) WHERE email IS NOT NULL) AS rows, true AS refused
FROM (VALUES ('customer_id', 'bigint', false, NULL), ('email', 'string', false, 'clear text'), ('phone', 'string', true, NULL)) AS v(c, t, n, x)
""",
    "masked_by_sql_functions": f"SELECT customer_id, {_MASKED} FROM ({_CONTACTS})",
    "row_filter_region": f"""
SELECT seen_by, country, count(*) AS customers FROM (
  SELECT 'us' AS seen_by, country FROM ({_CONTACTS}) WHERE country = 'US'
  UNION ALL SELECT 'eu', country FROM ({_CONTACTS}) WHERE country IN ('DE', 'FR', 'IT', 'ES', 'NL', 'BE')
  UNION ALL SELECT 'global', country FROM ({_CONTACTS})
) GROUP BY ALL
""",
    "expectations_summary": f"""
WITH o AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY extract DESC, source_key DESC) AS rn FROM ({_LANDED})) WHERE rn = 1)
SELECT 'has_customer' AS name, 'drop' AS action, count(*) FILTER (customer_id IS NULL) AS failed, count(*) AS total FROM o
UNION ALL SELECT 'positive_total', 'drop', count(*) FILTER (NOT coalesce(total_amount > 0, false)), count(*) FROM o
UNION ALL SELECT 'recent', 'warn', count(*) FILTER (NOT coalesce(order_date <= DATE '2001-12-31', false)), count(*) FROM o
""",
    "audit_report": f"""
WITH c AS (
  SELECT 'retention' AS "check", round(CAST((SELECT count(*) FROM ({_REASON}) WHERE reason IS NULL) AS DOUBLE) / (SELECT count(*) FROM ({_LANDED})), 6) AS value, 0.95 AS threshold, true AS least
  UNION ALL SELECT 'null_priority_share', (SELECT round(CAST(count(*) FILTER (priority IS NULL) AS DOUBLE) / count(*), 6)
    FROM ({_SHIPPED}) s LEFT JOIN ({_VERSIONS}) v ON s.customer_id = v.customer_id AND ship_day BETWEEN effective_from AND effective_to), 0.6, false
  UNION ALL SELECT 'duplicate_orders', (SELECT count(*) - count(DISTINCT order_id) FROM ({_REASON}) WHERE reason IS NULL), 0, false
  UNION ALL SELECT 'open_versions', (SELECT max(n) FROM (SELECT count(*) AS n FROM ({_VERSIONS}) WHERE is_current GROUP BY customer_id)), 1, false
  UNION ALL SELECT 'rejects_without_reason', 0, 0, false
  UNION ALL SELECT 'rows_against_last_run', (SELECT round(CAST(count(*) AS DOUBLE) / count(*) FILTER (extract = 1), 6) FROM ({_LANDED})), 0.8, true
  UNION ALL SELECT 'quarantine_against_last_run', round(CAST((SELECT count(*) FROM ({_REASON}) WHERE reason IS NOT NULL) AS DOUBLE) / greatest(1, (
    SELECT count(*) FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY source_key DESC) AS rn FROM ({_LANDED}) WHERE extract = 1)
    WHERE (rn = 1 OR order_id IS NULL) AND (order_id IS NULL OR customer_id IS NULL OR total_amount IS NULL OR total_amount <= 0 OR coalesce(item_count, 0) <= 0 OR order_date > DATE '2001-12-31')
  )), 6), 10, false
  UNION ALL SELECT 'lines_without_fact', (SELECT abs((SELECT count(*) FROM ({_SHIPPED})) - (SELECT count(*) FROM ({_SHIPPED}) s LEFT JOIN ({_VERSIONS}) v
    ON s.customer_id = v.customer_id AND ship_day BETWEEN effective_from AND effective_to))), 0, false
)
SELECT "check", CAST(value AS DOUBLE) AS value, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN least THEN value >= threshold ELSE value <= threshold END AS passed FROM c
""",
    "grants_matrix": """
SELECT * FROM (VALUES ('analysts', 'bronze', 'NONE'), ('analysts', 'silver', 'SELECT'), ('analysts', 'gold', 'SELECT'), ('engineers', 'bronze', 'ALL'), ('engineers', 'silver', 'ALL'),
  ('engineers', 'gold', 'ALL'), ('executives', 'bronze', 'NONE'), ('executives', 'silver', 'NONE'), ('executives', 'gold', 'SELECT'), ('pii_readers', 'bronze', 'NONE'),
  ('pii_readers', 'silver', 'SELECT'), ('pii_readers', 'gold', 'SELECT')) AS t(role, layer, privilege)
""",
    "tags_by_layer": """
SELECT * FROM (VALUES ('silver.customers', NULL, 'layer', 'silver'), ('silver.customers', NULL, 'pii', 'true'), ('silver.customers', 'email', 'pii', 'email'),
  ('silver.customers', 'phone', 'pii', 'phone')) AS t("table", "column", tag, value)
""",
    "lineage_edges": """
SELECT * FROM (VALUES ('bronze.lineitem', 'silver.lines'), ('silver.lines', 'gold.categories'), ('silver.part', 'gold.categories')) AS t(source, target)
""",
    "ordered_versions": f"""
SELECT customer_id, effective_from, CAST(row_number() OVER w AS INTEGER) AS version, CAST(date_diff('day', lag(effective_from) OVER w, effective_from) AS INTEGER) AS days_since_last
FROM ({_VERSIONS}) WINDOW w AS (PARTITION BY customer_id ORDER BY effective_from)
""",
}
