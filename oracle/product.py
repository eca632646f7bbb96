from oracle.base import big, cents, half_up, pct, quantile, with_ctes

BY_CATEGORY = "FROM item JOIN cat USING (product_id)"
REVIEWS = f"""count(DISTINCT review_id) AS review_count,
    {half_up('100 * sum(review_score)', 'count(review_score)')} AS average_review_score,
    count(*) FILTER (WHERE review_score <= 2) AS negative_reviews"""
POSITIVE = "count(*) FILTER (WHERE review_score >= 4) AS positive_reviews"


def mean(column: str, alias: str) -> str:
    return f"{half_up(f'100 * sum({column})', f'count({column})')} AS {alias}"


def quartile(p: float, alias: str) -> str:
    return f"CAST(round(CAST({quantile('price', p)} AS DECIMAL(18,4)), 2) AS DOUBLE) AS {alias}"


SQL = {
    "pq01_product_performance": with_ctes("item prod", f"""SELECT product_id, product_category_name,
        count(DISTINCT order_id) AS order_count, count(*) AS item_count, {cents('sum(pc)')} AS product_revenue,
        {half_up('sum(pc)', 'count(*)')} AS average_item_price, {half_up('sum(fc)', 'count(*)')} AS average_freight
        FROM item JOIN prod USING (product_id) GROUP BY 1, 2"""),
    "pq02_top_products": with_ctes("item cat", f"""SELECT product_id, category, count(*) AS item_count,
        count(DISTINCT order_id) AS order_count, {cents('sum(pc)')} AS revenue {BY_CATEGORY}
        GROUP BY 1, 2 ORDER BY sum(pc) DESC, 1 LIMIT 20"""),
    "pq03_category_performance": with_ctes("item cat", f"""SELECT category, count(DISTINCT product_id) AS product_count,
        count(DISTINCT order_id) AS order_count, {big('count(*)')} AS item_count, {cents('sum(pc)')} AS product_revenue,
        {cents('sum(fc)')} AS freight_revenue, {half_up('sum(pc)', 'count(*)')} AS average_item_price
        {BY_CATEGORY} GROUP BY 1"""),
    "pq04_category_revenue_share": with_ctes("item cat", f"""SELECT category, {cents('r')} AS revenue,
        {pct('r', 'sum(r) OVER ()')} AS revenue_share_pct FROM (
        SELECT category, sum(pc) AS r {BY_CATEGORY} GROUP BY 1)"""),
    "pq05_monthly_category_revenue": with_ctes("ord item cat", f"""SELECT
        CAST(date_trunc('month', ts) AS TIMESTAMP) AS purchase_month, category, {cents('sum(pc)')} AS revenue,
        count(DISTINCT order_id) AS orders FROM ord JOIN item USING (order_id) JOIN cat USING (product_id)
        GROUP BY 1, 2"""),
    "pq06_price_distribution": with_ctes("item", f"""SELECT count(*) AS item_rows, {cents('min(pc)')} AS minimum_price,
        {quartile(0.25, 'p25_price')}, {quartile(0.5, 'median_price')}, {quartile(0.75, 'p75_price')},
        {cents('max(pc)')} AS maximum_price, {half_up('sum(pc)', 'count(*)')} AS average_price FROM item"""),
    "pq07_freight_ratio": with_ctes("item cat", f"""SELECT category, {half_up('sum(pc)', 'count(*)')} AS average_price,
        {half_up('sum(fc)', 'count(*)')} AS average_freight, {pct('sum(fc)', 'sum(pc)')} AS freight_to_price_pct
        {BY_CATEGORY} GROUP BY 1"""),
    "pq08_seller_performance": with_ctes("item sell", f"""SELECT seller_id, seller_city, seller_state,
        count(DISTINCT order_id) AS order_count, count(DISTINCT product_id) AS product_count,
        {big('count(*)')} AS item_count, {cents('sum(pc)')} AS product_revenue,
        {half_up('sum(pc)', 'count(*)')} AS average_item_price
        FROM item JOIN sell USING (seller_id) GROUP BY 1, 2, 3"""),
    "pq09_top_sellers": with_ctes("item sell", f"""SELECT seller_id, seller_city, seller_state,
        count(DISTINCT order_id) AS orders, count(DISTINCT product_id) AS products, {cents('sum(pc)')} AS revenue
        FROM item JOIN sell USING (seller_id) GROUP BY 1, 2, 3 ORDER BY sum(pc) DESC, 1 LIMIT 20"""),
    "pq10_seller_reviews": with_ctes("item sell rev", f"""SELECT seller_id, {REVIEWS}, {POSITIVE}
        FROM sell JOIN item USING (seller_id) JOIN rev USING (order_id) GROUP BY 1 HAVING count(review_id) > 0"""),
    "pq11_category_reviews": with_ctes("item cat rev", f"""SELECT category, {REVIEWS}, {POSITIVE}
        {BY_CATEGORY} JOIN rev USING (order_id) GROUP BY 1 HAVING count(review_id) > 0"""),
    "pq12_product_reviews": with_ctes("item cat rev", f"""SELECT product_id, category, {REVIEWS}
        {BY_CATEGORY} JOIN rev USING (order_id) GROUP BY 1, 2 HAVING count(review_id) > 0
        ORDER BY average_review_score, review_count DESC, product_id LIMIT 50"""),
    "pq13_catalogue": with_ctes("cat", f"""SELECT category, count(*) AS products, {mean('name_len', 'avg_name_length')},
        {mean('desc_len', 'avg_description_length')}, {mean('photos', 'avg_photo_count')},
        {mean('weight', 'avg_weight_g')} FROM cat GROUP BY 1"""),
    "pq14_category_item_share": with_ctes("item cat", f"""SELECT category, {big('n')} AS item_count,
        {pct('n', 'sum(n) OVER ()')} AS item_share_pct FROM (SELECT category, count(*) AS n {BY_CATEGORY} GROUP BY 1)"""),
    "pq15_product_rank": with_ctes("item cat", f"""SELECT product_id, category, {cents('r')} AS revenue,
        dense_rank() OVER (PARTITION BY category ORDER BY r DESC) AS category_revenue_rank FROM (
        SELECT product_id, category, sum(pc) AS r {BY_CATEGORY} GROUP BY 1, 2)"""),
    "pq16_seller_rank": with_ctes("item cat", f"""SELECT seller_id, category, {cents('r')} AS revenue,
        dense_rank() OVER (PARTITION BY category ORDER BY r DESC) AS seller_category_rank FROM (
        SELECT seller_id, category, sum(pc) AS r {BY_CATEGORY} GROUP BY 1, 2)"""),
    "pq17_delivery_performance": with_ctes("ord item cat", f"""SELECT category, count(DISTINCT order_id) AS orders,
        {half_up('100 * sum(epoch_us(delivered) - epoch_us(ts))', 'count(*) * 86400000000')} AS avg_purchase_to_delivery_days,
        {half_up('100 * sum(epoch_us(delivered) - epoch_us(estimated))', 'count(*) * 86400000000')}
            AS avg_delivery_vs_estimate_days
        FROM ord JOIN item USING (order_id) JOIN cat USING (product_id) WHERE delivered IS NOT NULL GROUP BY 1"""),
    "pq18_category_scorecard": with_ctes("item cat rev", f"""SELECT * FROM (
        SELECT category, count(DISTINCT product_id) AS product_count, count(DISTINCT order_id) AS order_count,
        {big('count(*)')} AS item_count, {cents('sum(pc)')} AS revenue, {half_up('sum(pc)', 'count(*)')} AS average_price
        {BY_CATEGORY} GROUP BY 1) LEFT JOIN (
        SELECT category, count(DISTINCT review_id) AS review_count,
        {half_up('100 * sum(review_score)', 'count(review_score)')} AS average_review_score
        {BY_CATEGORY} JOIN rev USING (order_id) GROUP BY 1) USING (category)"""),
}
