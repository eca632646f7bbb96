from oracle.base import big, cents, days, half_up, pct, quantile, with_ctes

COUNTS = "SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM po GROUP BY 1"
SPEND = """SELECT customer_unique_id, count(DISTINCT order_id) AS n, sum(pc + fc) AS c FROM sale GROUP BY 1"""
PREV = """SELECT customer_unique_id, order_id, ts,
    lag(ts) OVER (PARTITION BY customer_unique_id ORDER BY ts, order_id) AS prev FROM po"""

SQL = {
    "cq01_orders_per_customer": with_ctes("po", """SELECT customer_unique_id, customer_city, customer_state,
        count(DISTINCT order_id) AS order_count, min(ts) AS first_order_date, max(ts) AS last_order_date
        FROM po GROUP BY 1, 2, 3 ORDER BY order_count DESC"""),
    "cq02_repeat_share": with_ctes("po", f"""SELECT customer_type, count(*) AS customer_count,
        {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM (
        SELECT CASE WHEN n = 1 THEN 'One-time customer' ELSE 'Repeat customer' END AS customer_type FROM k)
        GROUP BY 1""", k=COUNTS),
    "cq03_order_frequency": with_ctes("po", f"""SELECT {half_up('100 * sum(n)', 'count(*)')} AS average_orders_per_customer,
        min(n) AS minimum_orders, max(n) AS maximum_orders, {quantile('n', 0.5)} AS median_orders FROM k""", k=COUNTS),
    "cq04_spend_summary": with_ctes("sale", f"""SELECT count(*) AS customers,
        {half_up('sum(c)', 'count(*)')} AS average_customer_spend,
        CAST(round(CAST({quantile('c', 0.5)} / 100 AS DECIMAL(18,4)), 2) AS DOUBLE) AS median_customer_spend,
        {cents('min(c)')} AS minimum_customer_spend, {cents('max(c)')} AS maximum_customer_spend FROM k""", k=SPEND),
    "cq05_top_customers": with_ctes("sale", f"""SELECT customer_unique_id, customer_city, customer_state,
        count(DISTINCT order_id) AS order_count, {cents('sum(pc + fc)')} AS total_spend FROM sale
        GROUP BY 1, 2, 3 ORDER BY sum(pc + fc) DESC, 1, 2 LIMIT 20"""),
    "cq06_average_order_value": with_ctes("sale", f"""SELECT customer_unique_id, n AS order_count,
        {half_up('c', 'n')} AS average_order_value, {cents('c')} AS total_spend FROM k""", k=SPEND),
    "cq07_category_diversity": with_ctes("sale prod", """SELECT customer_unique_id,
        count(DISTINCT product_category_name) AS category_count FROM sale JOIN prod USING (product_id) GROUP BY 1"""),
    "cq08_product_diversity": with_ctes("sale", f"""SELECT customer_unique_id,
        count(DISTINCT product_id) AS unique_products_purchased, {big('count(*)')} AS item_line_count
        FROM sale GROUP BY 1"""),
    "cq09_review_behaviour": with_ctes("po rev", f"""SELECT customer_unique_id, count(review_id) AS review_count,
        {half_up('100 * sum(review_score)', 'count(review_score)')} AS average_review_score,
        count(*) FILTER (WHERE review_score <= 2) AS negative_review_count,
        count(*) FILTER (WHERE review_score >= 4) AS positive_review_count
        FROM po LEFT JOIN rev USING (order_id) GROUP BY 1"""),
    "cq10_favourite_payment": with_ctes("po pay", f"""SELECT customer_unique_id, payment_type AS most_used_payment_type,
        n AS payment_count, {cents('v')} AS payment_value FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, v DESC, payment_type) AS r FROM (
        SELECT customer_unique_id, payment_type, count(*) AS n, sum(vc) AS v FROM po JOIN pay USING (order_id)
        GROUP BY 1, 2)) WHERE r = 1"""),
    "cq11_geography": with_ctes("sale", f"""SELECT customer_state, count(DISTINCT customer_unique_id) AS customer_count,
        count(DISTINCT order_id) AS order_count, {cents('sum(pc + fc)')} AS total_revenue FROM sale GROUP BY 1"""),
    "cq12_monthly_activity": with_ctes("sale", f"""SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS purchase_month,
        count(DISTINCT customer_unique_id) AS active_customers, count(DISTINCT order_id) AS orders,
        {cents('sum(pc + fc)')} AS revenue FROM sale GROUP BY 1 ORDER BY 1"""),
    "cq13_order_intervals": with_ctes("po", f"""SELECT customer_unique_id, order_id, ts AS order_purchase_timestamp,
        prev AS previous_order_timestamp, {days('ts', 'prev')} AS days_since_previous_order
        FROM k WHERE prev IS NOT NULL""", k=PREV),
    "cq14_interval_statistics": with_ctes("po", f"""SELECT count(*) AS repeat_purchase_intervals,
        {half_up('100 * sum(d)', 'count(*) * 86400000000')} AS average_days_between_orders,
        {half_up('200 * ' + quantile('d', 0.5), '2 * 86400000000')} AS median_days_between_orders
        FROM (SELECT epoch_us(ts) - epoch_us(prev) AS d FROM k WHERE prev IS NOT NULL)""", k=PREV),
    "cq15_lifetime_summary": with_ctes("sale", f"""SELECT customer_unique_id, count(DISTINCT order_id) AS order_count,
        {cents('sum(pc + fc)')} AS total_spend, {half_up('100 * (epoch_us(max(ts)) - epoch_us(min(ts)))', '86400000000')} AS customer_active_days,
        min(ts) AS first_purchase, max(ts) AS last_purchase FROM sale GROUP BY 1"""),
    "cq16_spend_deciles": with_ctes("sale", f"""SELECT CAST(t AS INTEGER) AS spend_decile, count(*) AS customer_count,
        {cents('sum(c)')} AS revenue, {half_up('sum(c)', 'count(*)')} AS average_customer_spend FROM (
        SELECT *, ntile(10) OVER (ORDER BY c DESC, customer_unique_id) AS t FROM k) GROUP BY t""", k=SPEND),
    "cq17_revenue_concentration": with_ctes("sale", f"""SELECT customer_unique_id, {cents('c')} AS total_spend,
        {pct('r', 'total')} AS cumulative_revenue_percentage FROM (
        SELECT *, sum(c) OVER (ORDER BY c DESC, customer_unique_id ROWS UNBOUNDED PRECEDING) AS r,
        sum(c) OVER () AS total FROM k) ORDER BY c DESC, customer_unique_id LIMIT 100""", k=SPEND),
    "cq18_scorecard": with_ctes("sale prod po rev", f"""SELECT customer_unique_id, order_count, total_spend,
        unique_products, unique_categories, average_review_score, review_count FROM (
        SELECT customer_unique_id, count(DISTINCT order_id) AS order_count, {cents('sum(pc + fc)')} AS total_spend,
        count(DISTINCT product_id) AS unique_products, count(DISTINCT product_category_name) AS unique_categories
        FROM sale LEFT JOIN prod USING (product_id) GROUP BY 1) LEFT JOIN (
        SELECT customer_unique_id, {half_up('100 * sum(review_score)', 'count(review_score)')} AS average_review_score,
        count(review_id) AS review_count FROM po LEFT JOIN rev USING (order_id) GROUP BY 1)
        USING (customer_unique_id)"""),
}
