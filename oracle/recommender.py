from oracle.base import cents, cutoff, with_ctes

STEPS = {
    "act": "SELECT * FROM sale WHERE order_status NOT IN ('canceled', 'unavailable')",
    "cut": cutoff("act"),
    "train": "SELECT act.* FROM act CROSS JOIN cut WHERE ts <= cutoff",
    "test": "SELECT act.* FROM act CROSS JOIN cut WHERE ts > cutoff",
    "pop": f"""SELECT *, row_number() OVER (ORDER BY purchase_count DESC, customer_count DESC, product_id) AS popularity_rank,
        CAST(purchase_count AS DOUBLE) / max(purchase_count) OVER () AS popularity_score FROM (
        SELECT product_id, count(DISTINCT order_id) AS purchase_count, count(DISTINCT customer_unique_id) AS customer_count,
        {cents('sum(pc)')} AS revenue FROM train GROUP BY 1)""",
    "hist": "SELECT DISTINCT customer_unique_id, product_id FROM train",
    "bask": "SELECT DISTINCT order_id, product_id FROM train",
    "sim": """SELECT a AS src, b AS dst, co, CAST(co AS DOUBLE) / (x.purchase_count + y.purchase_count - co) AS j FROM (
        SELECT p.product_id AS a, q.product_id AS b, count(*) AS co FROM bask p JOIN bask q
        ON p.order_id = q.order_id AND p.product_id <> q.product_id GROUP BY 1, 2)
        JOIN pop x ON a = x.product_id JOIN pop y ON b = y.product_id""",
    "near_all": """SELECT customer_unique_id, dst AS product_id, sum(CAST(round(j * 1000000000000) AS BIGINT)) AS score FROM hist
        JOIN sim ON product_id = src WHERE (customer_unique_id, dst) NOT IN
        (SELECT (customer_unique_id, product_id) FROM hist) GROUP BY 1, 2""",
    "near": """SELECT * FROM (SELECT customer_unique_id, product_id, CAST(score AS DOUBLE) / 1000000000000.0 AS score, row_number() OVER
        (PARTITION BY customer_unique_id ORDER BY score DESC, purchase_count DESC, product_id) AS rank
        FROM near_all JOIN pop USING (product_id)) WHERE rank <= 10""",
    "elig": """SELECT DISTINCT customer_unique_id FROM test WHERE customer_unique_id IN
        (SELECT customer_unique_id FROM hist)""",
    "truth": """SELECT DISTINCT customer_unique_id, product_id FROM test WHERE customer_unique_id IN
        (SELECT customer_unique_id FROM elig)""",
    "everyone": "SELECT DISTINCT customer_unique_id FROM cust",
    "unseen": """SELECT customer_unique_id, product_id, rank FROM (
        SELECT customer_unique_id, product_id, row_number() OVER (PARTITION BY customer_unique_id ORDER BY popularity_rank)
        AS rank FROM everyone CROSS JOIN pop WHERE (customer_unique_id, product_id) NOT IN
        (SELECT (customer_unique_id, product_id) FROM hist)) WHERE rank <= 10""",
    "top10": "SELECT product_id, popularity_rank AS rank FROM pop WHERE popularity_rank <= 10",
    "mixed": """SELECT customer_unique_id, product_id, rank FROM near
        UNION ALL SELECT customer_unique_id, product_id, rank FROM everyone CROSS JOIN top10
        WHERE customer_unique_id NOT IN (SELECT customer_unique_id FROM near)""",
}


def over(body: str) -> str:
    return with_ctes("sale cat", body, **STEPS)


def metrics(method: str, recs: str) -> str:
    return f"""SELECT '{method}' AS method, CAST(sum(o) AS DOUBLE) / (count(*) * 10) AS precision_at_k,
        CAST(sum(o) AS DOUBLE) / sum(r) AS recall_at_k, CAST(count(*) FILTER (WHERE o > 0) AS DOUBLE) / count(*) AS hit_rate_at_k,
        count(*) AS customers_evaluated FROM (SELECT t.customer_unique_id, count(*) AS r, count(m.rank) AS o FROM truth t
        LEFT JOIN {recs} m ON t.customer_unique_id = m.customer_unique_id AND t.product_id = m.product_id GROUP BY 1)"""


COMPARISON = f"""{metrics('Popularity Baseline', 'unseen')}
    UNION ALL {metrics('Item-Item Collaborative Filtering', 'mixed')}"""

SQL = {
    "fq04_interactions": over(f"""SELECT customer_unique_id, order_id, ts AS order_purchase_timestamp, product_id,
        {cents('pc')} AS price, {cents('fc')} AS freight_value FROM act"""),
    "fq05_product_categories": with_ctes("cat", "SELECT product_id, category FROM cat"),
    "k5_3_popularity": over("SELECT * FROM pop"),
    "k5_6_item_similarity": over("SELECT src, dst, co AS co_orders, round(j, 12) AS jaccard FROM sim"),
    "k5_8_recommendations_all": over("""SELECT customer_unique_id, product_id, CAST(rank AS INTEGER) AS rank, score,
        'item_item_similarity' AS method FROM near UNION ALL
        SELECT customer_unique_id, product_id, CAST(rank AS INTEGER), 0.0, 'popularity_fallback' FROM unseen
        WHERE customer_unique_id NOT IN (SELECT customer_unique_id FROM near)"""),
    "k5_9_popularity_baseline": over("""SELECT customer_unique_id, product_id, CAST(rank AS INTEGER) AS rank FROM unseen
        WHERE customer_unique_id IN (SELECT customer_unique_id FROM elig)"""),
    "k5_10_method_comparison": over(COMPARISON),
    "k5_11_method_comparison_long": over(f"""UNPIVOT (SELECT method, precision_at_k, recall_at_k, hit_rate_at_k FROM (
        {COMPARISON})) ON precision_at_k, recall_at_k, hit_rate_at_k INTO NAME metric VALUE score"""),
    "k5_12_recommendation_table": over("""SELECT customer_unique_id, product_id, CAST(rank AS INTEGER) AS rank, category
        FROM mixed LEFT JOIN cat USING (product_id) WHERE customer_unique_id IN (SELECT customer_unique_id FROM elig)"""),
}
