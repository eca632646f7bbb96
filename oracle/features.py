from oracle.base import big, cents, days, with_ctes

ORDER_LEVEL = """SELECT customer_unique_id, order_id, order_status, ts, delivered, estimated,
    coalesce(r, 0) AS r, coalesce(f, 0) AS f, coalesce(item_count, 0) AS item_count,
    coalesce(unique_products, 0) AS unique_products, coalesce(score, 0) AS score, coalesce(review_count, 0) AS review_count,
    coalesce(negative, 0) AS negative, coalesce(paid, 0) AS paid, coalesce(pay_rows, 0) AS pay_rows,
    coalesce(pay_types, 0) AS pay_types
    FROM po
    LEFT JOIN (SELECT order_id, sum(pc) AS r, sum(fc) AS f, count(*) AS item_count,
               count(DISTINCT product_id) AS unique_products FROM item GROUP BY 1) USING (order_id)
    LEFT JOIN (SELECT order_id, avg(review_score) AS score, count(review_id) AS review_count,
               count(*) FILTER (WHERE review_score <= 2) AS negative FROM rev GROUP BY 1) USING (order_id)
    LEFT JOIN (SELECT order_id, sum(vc) AS paid, count(*) AS pay_rows, count(DISTINCT payment_type) AS pay_types
               FROM pay GROUP BY 1) USING (order_id)"""


def bin_of(rank: str, q: int) -> str:
    return f"greatest(0, ((({rank}) - 1) * {q} + n - 2) // (n - 1) - 1)"


BASE = f"""SELECT customer_unique_id, count(DISTINCT order_id) AS order_count, {cents('sum(r + f)')} AS total_revenue,
    {cents('sum(r)')} AS total_product_revenue, {cents('sum(f)')} AS total_freight_revenue,
    {big('sum(item_count)')} AS total_items, {big('sum(unique_products)')} AS unique_products_purchased,
    ({cents('sum(r + f)')}) / count(*) AS average_order_value, min(ts) AS first_purchase_date,
    max(ts) AS last_purchase_date, coalesce(avg(CASE WHEN score > 0 THEN score END), 0) AS average_review_score,
    {big('sum(review_count)')} AS total_reviews, {big('sum(negative)')} AS negative_review_count,
    {cents('sum(paid)')} AS total_payment_value, {big('sum(pay_rows)')} AS payment_record_count,
    {big('sum(pay_types)')} AS payment_type_count, {days('(SELECT max(ts) FROM ol)', 'max(ts)')} AS recency_days,
    {days('max(ts)', 'min(ts)')} AS customer_age_days FROM ol GROUP BY 1"""

DELIVERY = """SELECT customer_unique_id, CAST(sum(t) AS DOUBLE) / count(*) / 86400000000.0 AS average_delivery_days,
    median(CAST(t AS DOUBLE)) / 86400000000.0 AS median_delivery_days,
    CAST(sum(l) AS DOUBLE) / count(*) / 86400000000.0 AS average_delivery_vs_estimate_days,
    count(*) FILTER (WHERE l > 0) AS late_delivery_order_count, count(DISTINCT order_id) AS delivered_order_count
    FROM (SELECT customer_unique_id, order_id, epoch_us(delivered) - epoch_us(ts) AS t,
          epoch_us(delivered) - epoch_us(estimated) AS l FROM ol WHERE delivered IS NOT NULL) GROUP BY 1"""

RANKED = """SELECT *, (rank() OVER (ORDER BY total_revenue) + (count(*) OVER (PARTITION BY total_revenue) - 1) / 2.0) / n
        AS spend_percentile,
    (rank() OVER (ORDER BY recency_days) + (count(*) OVER (PARTITION BY recency_days) - 1) / 2.0) / n AS recency_percentile,
    row_number() OVER (ORDER BY recency_days, customer_unique_id) AS rr,
    row_number() OVER (ORDER BY order_count, customer_unique_id) AS fr,
    row_number() OVER (ORDER BY total_revenue, customer_unique_id) AS mr
    FROM (SELECT *, count(*) OVER () AS n FROM base LEFT JOIN delivery USING (customer_unique_id))"""

SCORED = f"""SELECT *, CAST(5 - {bin_of('rr', 5)} AS INTEGER) AS recency_score,
    CAST({bin_of('fr', 5)} + 1 AS INTEGER) AS frequency_score,
    CAST({bin_of('mr', 5)} + 1 AS INTEGER) AS monetary_score FROM ranked"""

FEATURES = """SELECT customer_unique_id, order_count, total_revenue, total_product_revenue, total_freight_revenue,
    total_items, unique_products_purchased, average_order_value, first_purchase_date, last_purchase_date,
    average_review_score, total_reviews, negative_review_count, total_payment_value, payment_record_count,
    payment_type_count, recency_days, customer_age_days,
    coalesce(CAST(total_items AS DOUBLE) / nullif(order_count, 0), 0) AS average_items_per_order,
    coalesce(total_freight_revenue / nullif(order_count, 0), 0) AS average_freight_per_order,
    coalesce(total_product_revenue / nullif(total_items, 0), 0) AS revenue_per_item,
    coalesce(CAST(order_count AS DOUBLE) / nullif(customer_age_days, 0), 0) AS orders_per_active_day,
    CAST(order_count > 1 AS INTEGER) AS is_repeat_customer,
    coalesce(CAST(negative_review_count AS DOUBLE) / nullif(total_reviews, 0), 0) AS negative_review_rate,
    coalesce(average_delivery_days, 0) AS average_delivery_days, coalesce(median_delivery_days, 0) AS median_delivery_days,
    coalesce(average_delivery_vs_estimate_days, 0) AS average_delivery_vs_estimate_days,
    coalesce(late_delivery_order_count, 0) AS late_delivery_order_count,
    coalesce(delivered_order_count, 0) AS delivered_order_count, spend_percentile, recency_percentile, recency_score,
    frequency_score, monetary_score, recency_score + frequency_score + monetary_score AS rfm_score,
    CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions'
         WHEN recency_score >= 4 AND frequency_score >= 3 THEN 'Loyal Active'
         WHEN recency_score <= 2 AND monetary_score >= 4 THEN 'At Risk High Value'
         WHEN frequency_score >= 4 AND monetary_score >= 4 THEN 'High Value' ELSE 'Needs Attention' END AS customer_segment
    FROM scored"""

STEPS = {"ol": ORDER_LEVEL, "base": BASE, "delivery": DELIVERY, "ranked": RANKED, "scored": SCORED, "features": FEATURES}
SOURCES = "po item rev pay"


def over_features(body: str, **more: str) -> str:
    return with_ctes(SOURCES, body, **STEPS, **more)


SQL = {
    "fq01_order_level": with_ctes(SOURCES, f"""SELECT customer_unique_id, order_id, order_status,
        ts AS order_purchase_timestamp, delivered AS order_delivered_customer_date,
        estimated AS order_estimated_delivery_date, {cents('r')} AS product_revenue, {cents('f')} AS freight_revenue,
        item_count, unique_products, score AS average_review_score, review_count, negative AS negative_review_count,
        {cents('paid')} AS payment_value, pay_rows AS payment_record_count, pay_types AS payment_type_count FROM ol""",
        ol=ORDER_LEVEL),
    "k1_customer_features": over_features("SELECT * FROM features"),
}
