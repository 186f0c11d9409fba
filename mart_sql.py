"""The registered queries as plain SQL over the test tables, for a second engine to run.

Written from the meaning of each report, in the textbook form (one join of everything, then one GROUP BY),
not from the Spark plans.
"""

from __future__ import annotations

AS_OF = "DATE '2024-01-30'"

# ---------------------------------------------------------------------------------------------- the star

USERS = f"""
users AS (
  SELECT c_custkey AS user_id, c_name AS name, 'c' || c_custkey || '@example.com' AS email,
         n_name || ', ' || r_name AS location,
         CAST({AS_OF} - CAST((c_custkey * 37) % 730 AS INTEGER) AS DATE) AS signup_date,
         CAST(NULL AS VARCHAR) AS social_security_number, r_name AS state, n_name AS city,
         CASE WHEN (c_custkey * 37) % 730 > 365 THEN 'High Value'
              WHEN (c_custkey * 37) % 730 > 90 THEN 'Medium Value' ELSE 'Low Value' END AS user_segment,
         c_mktsegment AS mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

BOOKS = """
books0 AS (
  SELECT *, CAST(CAST(p_retailprice AS DECIMAL(10,2)) - 900 AS DECIMAL(10,2)) AS price,
         CAST(p_size + 1974 AS INTEGER) AS pub_year FROM part),
books AS (
  SELECT p_partkey AS book_id, p_name AS title, p_type AS category, price AS base_price,
         p_brand AS author, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS isbn,
         pub_year AS publication_year, CAST(p_size * 10 AS INTEGER) AS pages,
         'Pub ' || p_brand AS publisher,
         CASE WHEN price < 10 THEN 'Low' WHEN price < 25 THEN 'Medium' ELSE 'High' END AS price_tier,
         CASE WHEN pub_year >= 2019 THEN 'Recent' WHEN pub_year >= 2004 THEN 'Classic' ELSE 'Vintage' END
           AS age_category
  FROM books0)"""


def _date_id(d: str) -> str:
    return f"CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS INTEGER)"


def calendar(days: str) -> str:
    return f"""
dates AS (
  SELECT {_date_id("full_date")} AS date_id, full_date, CAST(year(full_date) AS INTEGER) AS year,
         CAST(month(full_date) AS INTEGER) AS month, CAST(day(full_date) AS INTEGER) AS day,
         CAST(quarter(full_date) AS INTEGER) AS quarter,
         CAST(dayofweek(full_date) AS INTEGER) AS day_of_week, dayname(full_date) AS day_name,
         monthname(full_date) AS month_name, dayofweek(full_date) IN (0, 6) AS is_weekend
  FROM (SELECT CAST(d AS DATE) AS full_date FROM ({days})))"""


EVENT_DAYS = "SELECT unnest(generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2030-12-31', INTERVAL 1 DAY)) AS d"
LINE_DAYS = "SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS d"

EVENT_SALES = f"""
sales AS (
  SELECT event_id AS transaction_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS book_id,
         {_date_id("ts")} AS date_id, CAST(value AS DECIMAL(10,2)) AS amount,
         CAST(1 AS INTEGER) AS quantity, CAST(0 AS DECIMAL(10,2)) AS discount_amount,
         ts AS transaction_timestamp
  FROM events WHERE event_type = 'purchase')"""

LINE_SALES = f"""
sales AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id, o_custkey AS user_id, l_partkey AS book_id,
         {_date_id("o_orderdate")} AS date_id, CAST(l_extendedprice AS DECIMAL(10,2)) AS amount,
         CAST(l_quantity AS INTEGER) AS quantity, CAST(0 AS DECIMAL(10,2)) AS discount_amount,
         o_orderdate AS transaction_timestamp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

EVENT_STAR = ",".join([USERS, BOOKS, calendar(EVENT_DAYS), EVENT_SALES])
LINE_STAR = ",".join([USERS, BOOKS, calendar(LINE_DAYS), LINE_SALES])

# ------------------------------------------------------------------------------------ shared expressions


def total(x: str) -> str:
    return f"CAST(SUM({x}) AS DECIMAL(18,2))"


def mean(x: str) -> str:
    return f"CAST({total(x)} AS DOUBLE) / COUNT({x})"


def cents_mean(x: str) -> str:
    """Average rounded half-up to cents, in whole numbers throughout (amounts are not negative)."""
    cents = f"CAST(SUM(CAST({x} * 100 AS BIGINT)) AS HUGEINT)"
    rounded = f"(({cents} * 2 + COUNT({x})) // (2 * COUNT({x})))"
    return f"CAST(CAST({rounded} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2))"


def spend_case(bands) -> str:
    whens = " ".join(f"WHEN total_spent >= {low} THEN '{label}'" for low, label in bands)
    return f"CASE {whens} ELSE 'New Customer' END"


DAILY_SELECT = f"""
SELECT d.full_date AS date, d.year, d.month, d.day_name, COUNT(f.transaction_id) AS total_transactions,
       {total("f.amount")} AS total_revenue, {mean("f.amount")} AS avg_transaction_value,
       COUNT(DISTINCT f.user_id) AS unique_customers,
       CAST(SUM(f.quantity) AS BIGINT) AS total_books_sold
FROM sales f JOIN dates d ON f.date_id = d.date_id"""

DAILY_GROUP = "GROUP BY d.full_date, d.year, d.month, d.day_name"

LATEST = "(SELECT MAX(d.full_date) FROM sales f JOIN dates d ON f.date_id = d.date_id)"


def trends(days: int) -> str:
    return f"""{DAILY_SELECT}
WHERE d.full_date >= {LATEST} - {days} AND d.full_date <= {LATEST} {DAILY_GROUP}"""


def by_range(start: str, end: str) -> str:
    return f"""{DAILY_SELECT}
WHERE d.full_date >= DATE '{start}' AND d.full_date <= DATE '{end}' {DAILY_GROUP}"""


M01 = f"""
daily AS (
  SELECT date_id, CAST(SUM(amount) AS DECIMAL(15,2)) AS total_revenue,
         COUNT(transaction_id) AS transaction_count, COUNT(DISTINCT user_id) AS unique_users,
         {cents_mean("amount")} AS average_transaction_value,
         CAST(SUM(quantity) AS BIGINT) AS total_quantity
  FROM sales GROUP BY date_id)"""

M02 = f"""
performance AS (
  SELECT book_id, COUNT(transaction_id) AS total_sales,
         CAST(SUM(amount) AS DECIMAL(15,2)) AS total_revenue, {cents_mean("amount")} AS average_price,
         COUNT(DISTINCT user_id) AS unique_customers, MIN(full_date) AS first_sale_date,
         MAX(full_date) AS last_sale_date
  FROM sales JOIN dates USING (date_id) GROUP BY book_id)"""

TOP_BOOKS = f"""
SELECT b.book_id, b.title, b.author, b.category, COUNT(f.transaction_id) AS total_sales,
       {total("f.amount")} AS total_revenue, {mean("f.amount")} AS avg_price,
       COUNT(DISTINCT f.user_id) AS unique_customers,
       MIN(f.transaction_timestamp) AS first_sale_date, MAX(f.transaction_timestamp) AS last_sale_date
FROM sales f JOIN books b ON f.book_id = b.book_id
GROUP BY b.book_id, b.title, b.author, b.category
ORDER BY total_revenue DESC, b.book_id LIMIT 10"""

USER_ANALYTICS = f"""
SELECT u.user_id, u.name, u.location, u.signup_date, COUNT(f.transaction_id) AS total_purchases,
       {total("f.amount")} AS total_spent, {mean("f.amount")} AS avg_purchase_value,
       MIN(f.transaction_timestamp) AS first_purchase_date,
       MAX(f.transaction_timestamp) AS last_purchase_date,
       CAST(date_diff('day', CAST(MIN(f.transaction_timestamp) AS DATE),
                      CAST(MAX(f.transaction_timestamp) AS DATE)) AS BIGINT) AS customer_lifespan_days
FROM users u JOIN sales f ON u.user_id = f.user_id
GROUP BY u.user_id, u.name, u.location, u.signup_date HAVING SUM(f.amount) > 0
ORDER BY total_spent DESC, u.user_id LIMIT 100"""

CATEGORY = f"""
SELECT b.category, COUNT(f.transaction_id) AS total_sales, {total("f.amount")} AS total_revenue,
       {mean("f.amount")} AS avg_price, COUNT(DISTINCT f.user_id) AS unique_customers,
       COUNT(DISTINCT f.book_id) AS unique_books
FROM sales f JOIN books b ON f.book_id = b.book_id GROUP BY b.category"""

SUMMARY = f"""
SELECT COUNT(DISTINCT f.transaction_id) AS total_transactions, {total("f.amount")} AS total_revenue,
       {mean("f.amount")} AS avg_transaction_value, COUNT(DISTINCT f.user_id) AS total_customers,
       COUNT(DISTINCT f.book_id) AS total_books, MIN(f.transaction_timestamp) AS first_sale_date,
       MAX(f.transaction_timestamp) AS last_sale_date, COUNT(DISTINCT d.full_date) AS days_with_sales
FROM sales f JOIN dates d ON f.date_id = d.date_id"""


def monthly(since: str) -> str:
    return f"""
SELECT year, month, month_name, COUNT(DISTINCT d.full_date) AS days_in_month,
       COUNT(f.transaction_id) AS total_transactions, {total("f.amount")} AS total_revenue,
       {mean("f.amount")} AS avg_transaction_value, COUNT(DISTINCT f.user_id) AS unique_customers,
       COUNT(DISTINCT f.book_id) AS unique_books
FROM sales f JOIN dates d ON f.date_id = d.date_id WHERE d.full_date >= {since}
GROUP BY year, month, month_name"""


SPEND_BANDS = ((1000, "High Value"), (500, "Medium Value"), (100, "Low Value"))
LINES_BANDS = ((2000000, "High Value"), (1500000, "Medium Value"), (500000, "Low Value"))

# Spend and purchases come from the sales alone; a user who is not in the dimension does not count.
PER_USER = """
per_user AS (
  SELECT user_id, SUM(amount) AS total_spent, COUNT(transaction_id) AS total_purchases
  FROM sales WHERE user_id IN (SELECT user_id FROM users) GROUP BY user_id)"""


def segments(bands) -> str:
    return f"""
, {PER_USER.strip()}, segments AS (
  SELECT {spend_case(bands)} AS segment, COUNT(*) AS customer_count, {total("total_spent")} AS total_revenue,
         {mean("total_spent")} AS avg_spent,
         CAST(SUM(total_purchases) AS DOUBLE) / COUNT(*) AS avg_purchases
  FROM per_user GROUP BY 1)
SELECT *, ROUND(CAST(customer_count * 100 AS DOUBLE) / CAST(SUM(customer_count) OVER () AS DOUBLE), 2)
            AS percentage
FROM segments"""


def segment_value(bands) -> str:
    return f"""
, {PER_USER.strip()}, {retention("monthly").strip()}, months AS (
  SELECT a.user_id, COUNT(*) AS months, COUNT(b.user_id) AS kept
  FROM active a LEFT JOIN active b ON a.user_id = b.user_id AND b.p = a.p + 1
  WHERE a.p < (SELECT MAX(p) FROM active) GROUP BY a.user_id)
SELECT {spend_case(bands)} AS segment, COUNT(*) AS customer_count, {total("total_spent")} AS total_revenue,
       CAST({total("total_spent")} AS DOUBLE) / CAST(SUM(total_purchases) AS DOUBLE) AS average_order_value,
       CASE WHEN SUM(months) > 0 THEN CAST(SUM(kept) AS DOUBLE) / CAST(SUM(months) AS DOUBLE) END
         AS retention_rate,
       CAST({total("total_spent")} AS DOUBLE) / COUNT(*) AS lifetime_value
FROM per_user LEFT JOIN months USING (user_id) GROUP BY 1"""


AUTHORS = f"""
SELECT b.author, COUNT(DISTINCT b.book_id) AS books_written, COUNT(f.transaction_id) AS total_sales,
       {total("f.amount")} AS total_revenue, {mean("f.amount")} AS avg_price,
       COUNT(DISTINCT f.user_id) AS unique_customers
FROM sales f JOIN books b ON f.book_id = b.book_id
GROUP BY b.author ORDER BY total_revenue DESC, b.author LIMIT 20"""

TABLE_COUNTS = """
SELECT 'fact_sales' AS table_name, COUNT(*) AS row_count FROM sales
UNION ALL SELECT 'dim_date', COUNT(*) FROM dates UNION ALL SELECT 'dim_books', COUNT(*) FROM books
UNION ALL SELECT 'dim_users', COUNT(*) FROM users"""

FACT_RANGE = """
SELECT MIN(full_date) AS earliest_date, MAX(full_date) AS latest_date,
       COUNT(DISTINCT full_date) AS unique_dates
FROM sales JOIN dates USING (date_id)"""

RECENT = f"""
SELECT full_date, COUNT(transaction_id) AS transactions, {total("amount")} AS revenue
FROM sales JOIN dates USING (date_id) WHERE full_date >= {AS_OF} - 30
GROUP BY full_date ORDER BY full_date DESC LIMIT 10"""

STATUS = f"""
, counts AS ({TABLE_COUNTS}), span AS ({FACT_RANGE}), recent AS ({RECENT})
SELECT 'table_counts' AS probe, table_name AS item, CAST(row_count AS VARCHAR) AS value FROM counts
UNION ALL SELECT 'fact_sales_date_range', 'earliest_date', CAST(earliest_date AS VARCHAR) FROM span
UNION ALL SELECT 'fact_sales_date_range', 'latest_date', CAST(latest_date AS VARCHAR) FROM span
UNION ALL SELECT 'fact_sales_date_range', 'unique_dates', CAST(unique_dates AS VARCHAR) FROM span
UNION ALL SELECT 'recent_sales', CAST(full_date AS VARCHAR),
                 CAST(transactions AS VARCHAR) || ' / ' || CAST(revenue AS VARCHAR) FROM recent"""

USER_COLUMNS = (
    "user_id, name, email, location, signup_date, social_security_number, state, city, user_segment"
)
BOOK_COLUMNS = (
    "book_id, title, category, base_price, author, isbn, publication_year, pages, publisher, price_tier, "
    "age_category"
)

OVERVIEW = f"""
SELECT (SELECT COUNT(*) FROM users) AS total_users, (SELECT COUNT(*) FROM sales) AS total_transactions,
       (SELECT {total("amount")} FROM sales) AS total_revenue,
       (SELECT COUNT(*) FROM books) AS total_books,
       (SELECT {mean("amount")} FROM sales) AS average_transaction_value,
       (SELECT category FROM (SELECT category, SUM(amount) AS r FROM sales JOIN books USING (book_id)
                              GROUP BY category ORDER BY r DESC, category LIMIT 1)) AS top_category,
       (SELECT user_id FROM (SELECT user_id, COUNT(*) AS n FROM sales GROUP BY user_id
                             ORDER BY n DESC, user_id LIMIT 1)) AS most_active_user"""

SEGMENT_COUNTS = "SELECT user_segment, COUNT(*) AS user_count FROM users GROUP BY user_segment"
HOURS = """
SELECT hour(transaction_timestamp) AS hour, COUNT(*) AS transaction_count FROM sales GROUP BY 1"""
STATES = """
SELECT state, COUNT(*) AS user_count FROM users WHERE state IS NOT NULL AND state <> ''
GROUP BY state ORDER BY user_count DESC, state LIMIT 10"""


def retention(period: str, suffix: str = "") -> str:
    """CTEs ``activeX`` and ``retainedX``: users of each period, matched with the same users one later."""
    months = {"monthly": 1, "quarterly": 3, "annual": 12}[period]
    return f"""
active{suffix} AS (
  SELECT DISTINCT f.user_id, (d.year * 12 + d.month - 1) // {months} AS p
  FROM sales f JOIN dates d ON f.date_id = d.date_id WHERE f.user_id IS NOT NULL),
retained{suffix} AS (
  SELECT a.p, COUNT(*) AS active_users,
         CASE WHEN a.p < (SELECT MAX(p) FROM active{suffix}) THEN COUNT(b.user_id) END AS retained_users
  FROM active{suffix} a LEFT JOIN active{suffix} b ON a.user_id = b.user_id AND b.p = a.p + 1
  GROUP BY a.p)"""


def retention_select(period: str) -> str:
    months = {"monthly": 1, "quarterly": 3, "annual": 12}[period]
    return f"""
, {retention(period).strip()}
SELECT make_date(p * {months} // 12, p * {months} % 12 + 1, 1) AS period_start, active_users,
       CAST(retained_users AS BIGINT) AS retained_users,
       CAST(retained_users AS DOUBLE) / active_users AS retention_rate
FROM retained"""


_PERIODS = {"monthly": "_m", "quarterly": "_q", "annual": "_a"}
RETENTION_CTES = ",".join(retention(p, s) for p, s in _PERIODS.items())


def retention_rate(suffix: str) -> str:
    return f"""(SELECT CASE WHEN SUM(active_users) > 0
                  THEN CAST(SUM(retained_users) AS DOUBLE) / CAST(SUM(active_users) AS DOUBLE) END
                FROM retained{suffix} WHERE retained_users IS NOT NULL)"""


RETENTION_METRICS = f", {RETENTION_CTES.strip()} " + " UNION ALL ".join(
    f"SELECT '{p}_retention' AS metric, {retention_rate(s)} AS retention_rate" for p, s in _PERIODS.items()
)

BEHAVIOR_ROWS = f"""
, {RETENTION_CTES.strip()}, segs AS ({SEGMENT_COUNTS}), hrs AS ({HOURS}), sts AS ({STATES})
SELECT 'user_segments' AS section, user_segment AS item, CAST(user_count AS DOUBLE) AS value FROM segs
UNION ALL SELECT 'hourly_distribution', CAST(hour AS VARCHAR), CAST(transaction_count AS DOUBLE) FROM hrs
UNION ALL SELECT 'geographic_distribution', state, CAST(user_count AS DOUBLE) FROM sts
""" + "".join(
    f"UNION ALL SELECT 'retention_metrics', '{p}_retention', {retention_rate(s)}\n" for p, s in _PERIODS.items()
)

TOP_CUSTOMERS = f"""
SELECT u.user_id, u.name, u.user_segment, COUNT(f.transaction_id) AS total_transactions,
       {total("f.amount")} AS total_spent, {mean("f.amount")} AS avg_transaction_value,
       COUNT(DISTINCT f.book_id) AS unique_books_purchased
FROM users u JOIN sales f ON u.user_id = f.user_id
GROUP BY u.user_id, u.name, u.user_segment ORDER BY total_spent DESC, u.user_id LIMIT 20"""

_STATS_COLUMNS = {
    "fact_sales": (
        "sales",
        "transaction_id user_id book_id date_id amount quantity discount_amount transaction_timestamp",
    ),
    "dim_users": ("users", USER_COLUMNS.replace(",", "")),
    "dim_books": ("books", BOOK_COLUMNS.replace(",", "")),
    "dim_date": (
        "dates",
        "date_id full_date year month day quarter day_of_week day_name month_name is_weekend",
    ),
}
TABLE_STATS = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, "
    f"COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count FROM {cte}"
    for table, (cte, columns) in _STATS_COLUMNS.items()
    for c in columns.split()
)

V01 = """
SELECT f.transaction_id, f.amount, f.quantity, f.transaction_timestamp, u.name AS user_name,
       u.email AS user_email, u.location AS user_location, u.user_segment, b.title AS book_title,
       b.category AS book_category, b.author AS book_author, b.base_price, d.full_date, d.year, d.month,
       d.quarter, d.day_name
FROM sales f JOIN users u ON f.user_id = u.user_id JOIN books b ON f.book_id = b.book_id
JOIN dates d ON f.date_id = d.date_id"""

V02 = f"""
, {M02.strip()}
SELECT b.book_id, b.title, b.category, b.author, p.total_sales, p.total_revenue, p.average_price,
       p.unique_customers, CAST(RANK() OVER (ORDER BY p.total_revenue DESC) AS BIGINT) AS revenue_rank,
       CAST(RANK() OVER (ORDER BY p.total_sales DESC) AS BIGINT) AS sales_rank
FROM books b JOIN performance p ON b.book_id = p.book_id"""

V03 = f"""
SELECT u.user_id, u.name, u.user_segment, u.signup_date,
       COUNT(DISTINCT f.transaction_id) AS total_transactions, {total("f.amount")} AS total_spent,
       CASE WHEN COUNT(f.amount) > 0 THEN {mean("f.amount")} END AS avg_transaction_value,
       MIN(f.transaction_timestamp) AS first_purchase, MAX(f.transaction_timestamp) AS last_purchase,
       COUNT(DISTINCT f.book_id) AS unique_books_purchased,
       COUNT(DISTINCT b.category) AS unique_categories
FROM users u LEFT JOIN sales f ON u.user_id = f.user_id LEFT JOIN books b ON f.book_id = b.book_id
GROUP BY u.user_id, u.name, u.user_segment, u.signup_date"""

MONTHLY_SUMMARY = f"""
SELECT d.year, d.month, COUNT(f.transaction_id) AS total_transactions,
       {total("f.amount")} AS total_revenue, COUNT(DISTINCT f.user_id) AS unique_customers,
       COUNT(DISTINCT f.book_id) AS unique_books_sold
FROM sales f JOIN dates d ON f.date_id = d.date_id GROUP BY d.year, d.month"""

CATEGORY_SUMMARY = f"""
SELECT b.category, COUNT(f.transaction_id) AS total_sales, {total("f.amount")} AS total_revenue,
       {mean("f.amount")} AS avg_price, COUNT(DISTINCT f.user_id) AS unique_customers
FROM sales f JOIN books b ON f.book_id = b.book_id GROUP BY b.category"""


def sales_by_category(where: str) -> str:
    return f"""
SELECT b.category, COUNT(f.transaction_id) AS total_transactions, {total("f.amount")} AS total_revenue,
       {mean("f.amount")} AS average_transaction_value, COUNT(DISTINCT f.user_id) AS unique_customers
FROM sales f JOIN books b ON f.book_id = b.book_id JOIN dates d ON f.date_id = d.date_id
WHERE {where} GROUP BY b.category"""


def grain(unit: str) -> str:
    return f"""
SELECT CAST(date_trunc('{unit}', d.full_date) AS DATE) AS period_start, {total("f.amount")} AS total_revenue,
       COUNT(f.transaction_id) AS transaction_count, COUNT(DISTINCT f.user_id) AS unique_customers,
       {mean("f.amount")} AS average_transaction_value,
       CAST(SUM(f.quantity) AS BIGINT) AS total_books_sold
FROM sales f JOIN dates d ON f.date_id = d.date_id GROUP BY 1"""


def ranked_books(measure: str, where: str = "TRUE", limit: int = 5) -> str:
    return f"""
, agg AS (
  SELECT b.book_id, b.title, b.author, b.category, {total("f.amount")} AS total_revenue,
         COUNT(f.transaction_id) AS total_sales, {mean("f.amount")} AS average_price,
         COUNT(DISTINCT f.user_id) AS unique_customers, CAST(SUM(f.quantity) AS BIGINT) AS total_quantity
  FROM sales f JOIN books b ON f.book_id = b.book_id JOIN dates d ON f.date_id = d.date_id
  WHERE {where} GROUP BY b.book_id, b.title, b.author, b.category)
SELECT *, CAST(RANK() OVER (ORDER BY {measure} DESC) AS BIGINT) AS rank FROM agg
ORDER BY {measure} DESC, book_id LIMIT {limit}"""


HISTORY_PURCHASES = """
SELECT transaction_id, transaction_timestamp AS transaction_date, title AS book_title,
       category AS book_category, author AS book_author, amount, quantity
FROM sales JOIN books USING (book_id) WHERE user_id = 41
ORDER BY transaction_date DESC, transaction_id DESC LIMIT 100"""

HISTORY_ANALYTICS = f"""
, theirs AS (SELECT * FROM sales WHERE user_id = 41),
favourite AS (
  SELECT category FROM theirs JOIN books USING (book_id) WHERE category IS NOT NULL
  GROUP BY category ORDER BY COUNT(transaction_id) DESC, category LIMIT 1)
SELECT u.user_id, COUNT(t.transaction_id) AS total_transactions, {total("t.amount")} AS total_spent,
       {mean("t.amount")} AS average_transaction_value,
       MIN(t.transaction_timestamp) AS first_purchase_date,
       MAX(t.transaction_timestamp) AS last_purchase_date,
       COUNT(DISTINCT t.book_id) AS unique_books_purchased,
       (SELECT category FROM favourite) AS favorite_category, u.user_segment
FROM users u LEFT JOIN theirs t ON u.user_id = t.user_id WHERE u.user_id = 41
GROUP BY u.user_id, u.user_segment"""


def trend(metric: str) -> str:
    return f"""
, daily AS ({trends(30)}), points AS (
  SELECT date, CAST({metric} AS DOUBLE) AS value FROM daily),
ends AS (
  SELECT arg_min(value, date) AS first, arg_max(value, date) AS last, COUNT(*) AS data_points,
         regr_r2(value, CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE)) AS r2 FROM points),
change AS (SELECT *, round((last - first) * 100 / abs(first), 4) AS percentage_change FROM ends)
SELECT '{metric}' AS metric, 'daily' AS time_range, data_points,
       CASE WHEN percentage_change > 1 THEN 'up' WHEN percentage_change < -1 THEN 'down' ELSE 'stable' END
         AS trend_direction,
       percentage_change, round(coalesce(r2, 0), 6) AS confidence_level
FROM change"""


# ------------------------------------------------------------------------------------- feeds and cleaning

RAW = f"""
raw_users AS (
  SELECT CASE WHEN mktsegment = 'MACHINERY' THEN 'x' || user_id ELSE CAST(user_id AS VARCHAR) END AS id,
         name, email, location,
         CASE WHEN mktsegment = 'BUILDING' THEN strftime(signup_date, '%d/%m/%Y')
              ELSE strftime(signup_date, '%Y-%m-%d') END AS signup_date,
         lpad(CAST(user_id AS VARCHAR), 9, '0') AS social_security_number
  FROM users),
raw_books AS (
  SELECT CAST(book_id AS VARCHAR) AS book_id, title, category, CAST(base_price AS VARCHAR) AS base_price,
         author, isbn,
         CASE WHEN category = 'ECONOMY' THEN 'unknown' ELSE CAST(publication_year AS VARCHAR) END
           AS publication_year,
         CAST(pages AS VARCHAR) AS pages, publisher
  FROM books),
raw_transactions AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
         CASE WHEN event_type = 'view' THEN 'u' || user_id ELSE CAST(user_id AS VARCHAR) END AS user_id,
         CASE WHEN event_type = 'signup' THEN '' ELSE json_extract_string(props, '$.k') || '.0' END AS book_id,
         CASE WHEN event_type = 'error' THEN '-' || value ELSE CAST(value AS VARCHAR) END AS amount,
         CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d')
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp
  FROM events)"""

CLEAN = """
clean_users AS (
  SELECT * FROM (
    SELECT TRY_CAST(id AS BIGINT) AS id, name, email, location,
           CAST(TRY_STRPTIME(signup_date, '%Y-%m-%d') AS DATE) AS signup_date, social_security_number
    FROM raw_users) WHERE id IS NOT NULL AND signup_date IS NOT NULL),
clean_books AS (
  SELECT * FROM (
    SELECT TRY_CAST(book_id AS BIGINT) AS book_id, title, category,
           TRY_CAST(base_price AS DECIMAL(10,2)) AS base_price, author, isbn,
           TRY_CAST(publication_year AS BIGINT) AS publication_year, TRY_CAST(pages AS BIGINT) AS pages,
           publisher
    FROM raw_books) WHERE book_id IS NOT NULL),
clean_transactions AS (
  SELECT transaction_id, user_id, book_id, amount, timestamp FROM (
    SELECT TRY_CAST(transaction_id AS BIGINT) AS transaction_id, TRY_CAST(user_id AS BIGINT) AS user_id,
           CAST(trunc(TRY_CAST(book_id AS DOUBLE)) AS BIGINT) AS book_id,
           CASE WHEN TRY_CAST(amount AS DOUBLE) BETWEEN 0 AND 10000
                THEN CAST(TRY_CAST(amount AS DOUBLE) AS DECIMAL(10,2)) END AS amount,
           TRY_STRPTIME(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp
    FROM raw_transactions)
  WHERE amount IS NOT NULL AND timestamp IS NOT NULL AND book_id IS NOT NULL AND user_id IS NOT NULL),
kept AS (
  SELECT * FROM clean_transactions
  WHERE user_id IN (SELECT id FROM clean_users) AND book_id IN (SELECT book_id FROM clean_books))"""

FEEDS = ",".join([USERS, BOOKS, RAW, CLEAN])
CLEAN_TRANSACTIONS = "transaction_id, user_id, book_id, amount, timestamp"

USERS_FILE = """
SELECT id AS user_id, name, email, location, CAST(strftime(signup_date, '%Y-%m-%d') AS VARCHAR) AS signup_date,
       CAST(NULL AS VARCHAR) AS social_security_number FROM clean_users"""
BOOKS_FILE = """
SELECT book_id, title, author, category, publication_year, pages, base_price FROM clean_books"""
SALES_FILE = f"""
SELECT transaction_id, user_id, book_id, CAST({_date_id("timestamp")} AS BIGINT) AS date_id, amount,
       CAST(1 AS BIGINT) AS quantity, CAST(0 AS DOUBLE) AS discount_amount,
       strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS transaction_timestamp FROM kept"""
FACT = f"""
SELECT transaction_id, user_id, book_id, {_date_id("timestamp")} AS date_id, amount,
       CAST(1 AS INTEGER) AS quantity, CAST(0 AS DECIMAL(10,2)) AS discount_amount,
       timestamp AS transaction_timestamp FROM kept"""
DIM_USERS = f"""
SELECT id AS user_id, name, email, location, signup_date, CAST(NULL AS VARCHAR) AS social_security_number,
       trim(split_part(location, ',', 2)) AS state, trim(split_part(location, ',', 1)) AS city,
       CASE WHEN {AS_OF} - signup_date > 365 THEN 'High Value'
            WHEN {AS_OF} - signup_date > 90 THEN 'Medium Value' ELSE 'Low Value' END AS user_segment
FROM clean_users"""
DIM_BOOKS = """
SELECT book_id, title, category, base_price, author, isbn,
       CAST(publication_year AS INTEGER) AS publication_year, CAST(pages AS INTEGER) AS pages, publisher,
       CASE WHEN base_price < 10 THEN 'Low' WHEN base_price < 25 THEN 'Medium' ELSE 'High' END AS price_tier,
       CASE WHEN publication_year IS NULL THEN NULL WHEN publication_year >= 2019 THEN 'Recent'
            WHEN publication_year >= 2004 THEN 'Classic' ELSE 'Vintage' END AS age_category
FROM clean_books"""

ORDER_DAYS = """SELECT unnest(generate_series((SELECT MIN(o_orderdate) FROM orders),
                (SELECT MAX(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS d"""

FIRST_LINES = """
SELECT transaction_id, user_id, book_id, date_id, amount, quantity, discount_amount, transaction_timestamp
FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
        ORDER BY transaction_timestamp, user_id, book_id, amount, quantity) AS nth FROM sales)
WHERE nth = 1"""


def on_events(body: str) -> str:
    return f"WITH {EVENT_STAR} {body}"


def on_lines(body: str) -> str:
    return f"WITH {LINE_STAR} {body}"


def on_feeds(body: str) -> str:
    return f"WITH {FEEDS} {body}"
