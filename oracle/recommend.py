from oracle.base import big, cents, cutoff, days, with_ctes

PAIRS = """SELECT a.product_id AS product_a, b.product_id AS product_b, count(DISTINCT a.order_id) AS co_purchase_orders
    FROM item a JOIN item b ON a.order_id = b.order_id AND a.product_id < b.product_id GROUP BY 1, 2"""
PREFERENCE = """SELECT customer_unique_id, category, count(*) AS n, sum(pc) AS c
    FROM sale JOIN cat USING (product_id) GROUP BY 1, 2"""
CUTOFF = cutoff("ord")

SQL = {
    "rq01_product_popularity": with_ctes("ord item", f"""SELECT product_id, {big('count(*)')} AS purchase_count,
        count(DISTINCT order_id) AS order_count, count(DISTINCT customer_id) AS customer_count,
        {cents('sum(pc)')} AS revenue FROM item JOIN ord USING (order_id) GROUP BY 1
        ORDER BY purchase_count DESC, product_id LIMIT 100"""),
    "rq02_category_popularity": with_ctes("ord item cat", """SELECT category, product_id, count(*) AS purchase_count,
        count(DISTINCT customer_id) AS customer_count FROM item JOIN ord USING (order_id) JOIN cat USING (product_id)
        GROUP BY 1, 2"""),
    "rq03_interactions": with_ctes("sale", f"""SELECT customer_unique_id, product_id, count(*) AS purchase_count,
        count(DISTINCT order_id) AS order_count, min(ts) AS first_purchase, max(ts) AS last_purchase,
        {cents('sum(pc)')} AS product_spend FROM sale GROUP BY 1, 2"""),
    "rq04_interaction_recency": with_ctes("sale", f"""SELECT customer_unique_id, product_id, n AS purchase_count,
        last_purchase, {days('e', 'last_purchase')} AS days_since_last_purchase FROM (
        SELECT customer_unique_id, product_id, count(*) AS n, max(ts) AS last_purchase FROM sale GROUP BY 1, 2)
        CROSS JOIN (SELECT max(ts) AS e FROM ord)"""),
    "rq05_category_preferences": with_ctes("sale cat", f"""SELECT customer_unique_id, category, n AS purchase_count,
        {cents('c')} AS category_spend FROM k""", k=PREFERENCE),
    "rq06_preferred_categories": with_ctes("sale cat", f"""SELECT customer_unique_id, category, n AS purchase_count,
        {cents('c')} AS category_spend FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id
        ORDER BY n DESC, c DESC, category) AS r FROM k) WHERE r <= 5""", k=PREFERENCE),
    "rq07_co_purchases": with_ctes("item", """SELECT * FROM k
        ORDER BY co_purchase_orders DESC, product_a, product_b LIMIT 100""", k=PAIRS),
    "rq08_co_purchases_with_categories": with_ctes("item prod", """SELECT product_a, p.product_category_name AS product_a_category,
        product_b, q.product_category_name AS product_b_category, co_purchase_orders
        FROM k JOIN prod p ON product_a = p.product_id JOIN prod q ON product_b = q.product_id
        ORDER BY co_purchase_orders DESC, product_a, product_b LIMIT 100""", k=PAIRS),
    "rq09_purchase_history": with_ctes("sale prod", f"""SELECT customer_unique_id, order_id, ts AS order_purchase_timestamp,
        product_id, product_category_name, {cents('pc')} AS price, {cents('fc')} AS freight_value
        FROM sale JOIN prod USING (product_id)"""),
    "rq10_unpurchased_candidates": with_ctes("sale prod", """SELECT customer_unique_id, product_id
        FROM (SELECT DISTINCT customer_unique_id FROM cust) CROSS JOIN prod
        WHERE (customer_unique_id, product_id) NOT IN (SELECT (customer_unique_id, product_id) FROM sale)
        ORDER BY 1, 2 LIMIT 1000"""),
    "rq11_split_counts": with_ctes("ord", """SELECT CASE WHEN ts <= cutoff THEN 'train' ELSE 'test' END AS split,
        count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers, count(*) AS item_interactions
        FROM ord CROSS JOIN k GROUP BY 1""", k=CUTOFF),
    "rq12_training_interactions": with_ctes("sale", """SELECT customer_unique_id, product_id,
        count(*) AS interaction_strength FROM sale CROSS JOIN k WHERE ts <= cutoff GROUP BY 1, 2""", k=CUTOFF),
    "rq13_future_interactions": with_ctes("sale", """SELECT customer_unique_id, product_id,
        count(*) AS future_interaction_strength FROM sale CROSS JOIN k WHERE ts > cutoff GROUP BY 1, 2""", k=CUTOFF),
    "rq14_training_popularity": with_ctes("ord item", f"""SELECT product_id, count(*) AS training_purchase_count,
        count(DISTINCT customer_id) AS training_customer_count, {cents('sum(pc)')} AS training_revenue
        FROM ord JOIN item USING (order_id) CROSS JOIN k WHERE ts <= cutoff GROUP BY 1
        ORDER BY training_purchase_count DESC, product_id LIMIT 100""", k=CUTOFF),
    "rq15_pair_jaccard": with_ctes("item", """SELECT product_a, product_b, co_purchase_orders, x.n AS product_a_orders,
        y.n AS product_b_orders, round(j, 4) AS jaccard_similarity FROM (
        SELECT k.*, x.n, y.n, x, y, CAST(co_purchase_orders AS DOUBLE) / (x.n + y.n - co_purchase_orders) AS j
        FROM k JOIN f x ON product_a = x.product_id JOIN f y ON product_b = y.product_id)
        ORDER BY j DESC, product_a, product_b LIMIT 100""", k=PAIRS,
        f="SELECT product_id, count(DISTINCT order_id) AS n FROM item GROUP BY 1"),
}
