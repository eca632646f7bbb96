from oracle import customer, quality
from oracle.base import big, cents, days, half_up, pct, quantile, with_ctes

SPEND = "SELECT customer_unique_id, sum(pc + fc) AS c FROM sale GROUP BY 1"
SPEND_MONEY = f"SELECT customer_unique_id, {cents('sum(pc + fc)')} AS v FROM sale GROUP BY 1"
PRICES = f"SELECT {cents('pc')} AS price, {cents('fc')} AS freight_value FROM item"
DELIVERY = f"""SELECT order_id, ts, delivered, estimated, {days('delivered', 'ts')} AS delivery_days,
    {days('delivered', 'estimated')} AS delivery_vs_estimate_days, epoch_us(delivered) - epoch_us(ts) AS transit,
    epoch_us(delivered) - epoch_us(estimated) AS late FROM ord WHERE delivered IS NOT NULL"""
SELLER = f"""SELECT seller_id, seller_state, count(DISTINCT order_id) AS order_count,
    count(DISTINCT product_id) AS product_count, {cents('sum(pc)')} AS revenue
    FROM item JOIN sell USING (seller_id) GROUP BY 1, 2"""


def profile(source: str, *columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, "
        f"min({v}) AS min, round({quantile(v, 0.25)}, 6) AS p25, round({quantile(v, 0.5)}, 6) AS p50, "
        f"round({quantile(v, 0.75)}, 6) AS p75, max({v}) AS max FROM {source}"
        for c, _, v in ((c.partition('=')[0], 0, c.partition('=')[2] or c) for c in columns)
    )


def bins(source: str, value: str, n: int) -> str:
    return f"""SELECT bin, round(lo + bin * w, 6) AS bin_start, count(*) AS count FROM (
        SELECT lo, w, CAST(least(floor((v - lo) / w), {n - 1}) AS INTEGER) AS bin FROM (
        SELECT {value} AS v, min({value}) OVER () AS lo, (max({value}) OVER () - min({value}) OVER ()) / {n}.0 AS w
        FROM {source})) GROUP BY bin, lo, w ORDER BY bin"""


SQL = {
    "eq01_entity_counts": with_ctes(quality.ALL, " UNION ALL ".join(
        f"SELECT '{n.replace('order_payments', 'payments').replace('order_reviews', 'reviews')}' AS entity, "
        f"count(*) AS row_count FROM {c}" for n, c in quality.NAMES.items())),
    "eq02_status_share": quality.SQL["dq05_status_distribution"],
    "eq03_customer_type": customer.SQL["cq02_repeat_share"],
    "eq04a_spend_rows": with_ctes("sale", "SELECT customer_unique_id, v AS total_spend FROM k", k=SPEND_MONEY),
    "eq04b_spend_profile": with_ctes("sale", profile("k", "total_spend=v"), k=SPEND_MONEY),
    "eq04c_spend_histogram": with_ctes("sale", bins("k", "v", 60), k=SPEND_MONEY),
    "eq04d_spend_log_histogram": with_ctes("sale", bins("k", "ln(1 + v)", 60), k=SPEND_MONEY),
    "eq05_top_states": customer.SQL["cq11_geography"].replace("total_revenue", "revenue") + " ORDER BY revenue DESC, 1 LIMIT 15",
    "eq06_monthly_revenue": customer.SQL["cq12_monthly_activity"],
    "eq07_top_categories": with_ctes("item cat", f"""SELECT category, count(DISTINCT product_id) AS product_count,
        count(DISTINCT order_id) AS order_count, {big('count(*)')} AS item_count, {cents('sum(pc)')} AS revenue,
        {half_up('sum(pc)', 'count(*)')} AS average_price FROM item JOIN cat USING (product_id)
        GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 20"""),
    "eq08a_price_profile": with_ctes("item", profile("k", "price", "freight_value"), k=PRICES),
    "eq08b_price_histogram": with_ctes("item", bins("k", "price", 80), k=PRICES),
    "eq09_score_distribution": with_ctes("rev", f"""SELECT review_score, count(*) AS review_count,
        {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM rev GROUP BY 1"""),
    "eq10_weak_categories": with_ctes("item cat rev", f"""SELECT category, count(DISTINCT review_id) AS review_count,
        {half_up('100 * sum(review_score)', 'count(review_score)')} AS average_review_score
        FROM item JOIN cat USING (product_id) JOIN rev USING (order_id) GROUP BY 1
        HAVING count(DISTINCT review_id) >= 20 ORDER BY 3, 1 LIMIT 20"""),
    "eq11_payment_methods": with_ctes("pay", f"""SELECT payment_type, {big('count(*)')} AS payment_records,
        count(DISTINCT order_id) AS orders, {cents('sum(vc)')} AS payment_value,
        {half_up('sum(vc)', 'count(*)')} AS average_payment FROM pay GROUP BY 1"""),
    "eq12a_delivery_rows": with_ctes("ord", """SELECT order_id, ts AS order_purchase_timestamp,
        delivered AS order_delivered_customer_date, estimated AS order_estimated_delivery_date,
        delivery_days, delivery_vs_estimate_days FROM k""", k=DELIVERY),
    "eq12b_delivery_profile": with_ctes("ord", profile("k", "delivery_days", "delivery_vs_estimate_days"), k=DELIVERY),
    "eq12c_delivery_histogram": with_ctes("ord", bins("k", "delivery_days", 70), k=DELIVERY),
    "eq13_delivery_summary": with_ctes("ord", f"""
        SELECT 'Average delivery days' AS metric, {half_up('100 * sum(transit)', 'count(*) * 86400000000')} AS value FROM k
        UNION ALL SELECT 'Median delivery days', {half_up('200 * ' + quantile('transit', 0.5), '2 * 86400000000')} FROM k
        UNION ALL SELECT 'Average days vs estimate', {half_up('100 * sum(late)', 'count(*) * 86400000000')} FROM k
        UNION ALL SELECT '% delivered before estimate', {pct('count(*) FILTER (WHERE late < 0)', 'count(*)')} FROM k
        UNION ALL SELECT '% delivered after estimate', {pct('count(*) FILTER (WHERE late > 0)', 'count(*)')} FROM k""",
        k=DELIVERY),
    "eq14a_seller_revenue": with_ctes("item sell", "SELECT * FROM k", k=SELLER),
    "eq14b_seller_histogram": with_ctes("item sell", bins("k", "revenue", 60), k=SELLER),
    "eq15_concentration_curve": with_ctes("sale", f"""SELECT customer_unique_id, {cents('c')} AS total_spend,
        100.0::DOUBLE * (({cents('r')})) / ({cents('total')}) AS cumulative_revenue_percentage FROM (
        SELECT *, sum(c) OVER (ORDER BY c DESC, customer_unique_id ROWS UNBOUNDED PRECEDING) AS r,
        sum(c) OVER () AS total FROM k)""", k=SPEND),
    "eq16_summary_metrics": with_ctes("sale cust ord prod sell rev item", f"""
        SELECT 'total_customers' AS metric, CAST(count(*) AS DOUBLE) AS value FROM cust
        UNION ALL SELECT 'total_orders', count(*) FROM ord UNION ALL SELECT 'total_products', count(*) FROM prod
        UNION ALL SELECT 'total_sellers', count(*) FROM sell UNION ALL SELECT 'total_reviews', count(*) FROM rev
        UNION ALL SELECT 'total_order_items', count(*) FROM item
        UNION ALL SELECT 'total_revenue', {cents('sum(c)')} FROM k
        UNION ALL SELECT 'median_customer_spend', round({quantile('c', 0.5)} / 100.0, 6) FROM k
        UNION ALL SELECT 'average_delivery_days', CAST(sum(transit) AS DOUBLE) / count(*) / 86400000000.0 FROM d
        UNION ALL SELECT 'median_delivery_days', {quantile('transit', 0.5)} / 86400000000.0 FROM d""",
        k=SPEND, d=DELIVERY),
}
