from oracle.base import cents, cutoff, days, half_up, pct, quantile, with_ctes
from oracle.explore import bins

STATES = ["delivered", "shipped", "processing", "canceled", "unavailable"]
SPEND = """SELECT customer_unique_id, sum(pc + fc) AS c, count(DISTINCT order_id) AS n FROM sale GROUP BY 1"""
LATE = days("delivered", "estimated")


def spend(body: str) -> str:
    return with_ctes("sale", body, k=SPEND)


SQL = {
    "a3_sql_over_views": with_ctes("ord", "SELECT order_status, count(*) AS orders FROM ord GROUP BY 1 HAVING count(*) > 1"),
    "a4_parameterised_sql": with_ctes("ord", """SELECT order_status, count(*) AS orders FROM ord CROSS JOIN cut
        WHERE ts <= cutoff GROUP BY 1""", cut=cutoff("ord")),
    "b3_predicates": with_ctes("ord rev", """SELECT CASE WHEN review_score <= 2 THEN 'negative' WHEN review_score >= 4
        THEN 'positive' ELSE 'neutral' END AS tone, count(*) FILTER (WHERE review_score NOT BETWEEN 2 AND 4) AS extreme,
        count(*) AS reviews FROM rev JOIN ord USING (order_id)
        WHERE order_status NOT IN ('canceled', 'unavailable') AND approved IS NOT NULL GROUP BY 1"""),
    "b7_rule_labels": with_ctes("item", """SELECT CASE WHEN price >= 50000 THEN 'premium' WHEN price >= 20000 THEN 'standard'
        ELSE 'budget' END AS label, count(*) AS items FROM item GROUP BY 1"""),
    "b9_guarded_ratios": with_ctes("item", f"""SELECT seller_id, {cents('sum(pc + fc)')} AS gross,
        coalesce(({cents('sum(pc)')}) / nullif({cents('sum(fc)')}, 0), 0) AS price_per_freight,
        {half_up('100 * sum(fc)', 'count(*) FILTER (WHERE fc > 0)', 10000)} AS paid_freight FROM item GROUP BY 1"""),
    "b11_coercion": with_ctes("pay", f"""SELECT count(*) AS rows, count(*) FILTER (WHERE payment_type <> 'voucher') AS numbers,
        count(*) FILTER (WHERE payment_type <> 'boleto') AS dates,
        {cents("sum(vc) FILTER (WHERE payment_type <> 'voucher')")} AS total FROM pay"""),
    "b13_median_imputation": with_ctes("prod", """SELECT product_id,
        coalesce(CAST(photos AS DOUBLE), (SELECT median(CAST(photos AS DOUBLE)) FROM prod)) AS photos FROM prod"""),
    "b14_clipping": with_ctes("ord", f"""SELECT order_id, greatest({LATE}, 0) AS days_late, abs({LATE}) AS days_off,
        sqrt(abs({LATE})) AS root FROM ord WHERE delivered IS NOT NULL"""),
    "b15_label_map": with_ctes("pay", """SELECT CASE payment_type WHEN 'credit_card' THEN 'Card' WHEN 'boleto' THEN 'Slip'
        ELSE 'Other' END AS label, count(*) AS payments FROM pay GROUP BY 1"""),
    "b16_scalar_filter": with_ctes("item", f"""SELECT count(*) AS items, {cents('sum(pc)')} AS revenue FROM item
        WHERE price >= (SELECT {quantile('price', 0.9)} FROM item)"""),
    "c11_key_sets": with_ctes("po", """SELECT count(*) FILTER (WHERE early AND late) AS both_periods,
        count(*) FILTER (WHERE early AND NOT late) AS only_early FROM (SELECT customer_unique_id,
        bool_or(ts <= cutoff) AS early, bool_or(ts > cutoff) AS late FROM po CROSS JOIN cut GROUP BY 1)""", cut=cutoff("ord")),
    "d09_share_of_total": with_ctes("cust", f"""SELECT customer_state, count(*) AS accounts,
        {pct('count(*)', 'sum(count(*)) OVER ()')} AS share_pct FROM cust GROUP BY 1"""),
    "d11_positive_means": with_ctes("ord", f"""SELECT order_status, avg(CASE WHEN d > 0 THEN d END)
        AS mean_positive_lateness FROM (SELECT order_status, floor({LATE}) AS d FROM ord) GROUP BY 1"""),
    "d12_group_medians": with_ctes("sale", "SELECT customer_state, round(median(CAST(price AS DOUBLE)), 4) AS median_price FROM sale GROUP BY 1"),
    "d17_repeated_lines": with_ctes("item", """SELECT (SELECT count(*) FROM item) - (SELECT count(*) FROM
        (SELECT DISTINCT order_id, product_id FROM item)) AS duplicate_rows"""),
    "d20_fixed_levels": with_ctes("ord", " UNION ALL ".join(
        f"SELECT '{s}' AS order_status, count(*) FILTER (WHERE order_status = '{s}') AS customers, "
        f"{pct(f'''count(*) FILTER (WHERE order_status = '{s}')''', 'count(*)')} AS percentage FROM ord"
        for s in [*STATES, "invoiced"])),
    "d21_crosstab": with_ctes("po", "SELECT customer_state, " + ", ".join(
        f"{pct(f'''count(*) FILTER (WHERE order_status = '{s}')''', 'count(*)')} AS {s}" for s in STATES)
        + " FROM po GROUP BY 1"),
    "d22_histogram": with_ctes("item", bins("item", f"({cents('fc')})", 25)),
    "d23_sets": with_ctes("item", """SELECT seller_id, string_agg(order_item_id, ',' ORDER BY order_item_id) AS line_numbers,
        bool_or(order_item_id = 7) AS has_line_7 FROM (SELECT DISTINCT seller_id, order_item_id FROM item) GROUP BY 1"""),
    "e04_ntile": spend("""SELECT customer_unique_id, CAST(ntile(7) OVER (ORDER BY c DESC, customer_unique_id) AS INTEGER)
        AS tile FROM k"""),
    "e05_running_sum": spend("""SELECT customer_unique_id, CAST(sum(n) OVER (ORDER BY c, customer_unique_id
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_order_count, CAST(sum(n) OVER () AS BIGINT) AS total_order_count FROM k"""),
    "e08_average_rank_percentile": spend("""SELECT customer_unique_id, n AS order_count,
        (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / count(*) OVER () AS pct FROM k"""),
    "e09_first_rank": spend("""SELECT customer_unique_id, row_number() OVER (ORDER BY n DESC, customer_unique_id) AS rank FROM k"""),
    "e10_quantile_bins": spend("""SELECT customer_unique_id, CAST(greatest(0, ((r - 1) * 5 + m - 2) // (m - 1) - 1) AS INTEGER)
        AS bin FROM (SELECT *, row_number() OVER (ORDER BY n, customer_unique_id) AS r, count(*) OVER () AS m FROM k)"""),
    "f05_top_by_size": with_ctes("ord", f"""SELECT order_id, abs({LATE}) AS days_off FROM ord WHERE delivered IS NOT NULL
        ORDER BY 2 DESC, 1 LIMIT 25"""),
    "f06_arg_max": with_ctes("item", "SELECT seller_id FROM item GROUP BY 1 ORDER BY sum(pc) DESC, 1 LIMIT 1"),
    "h01_scalars": with_ctes("ord", """SELECT order_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month,
        round(CAST(order_id % 100 AS DOUBLE), 6) AS round_trip, starts_with(order_status, 's') AS starts_s,
        ends_with(order_status, 'd') AS ends_d, '{"id":' || order_id || ',"state":"' || order_status || '"}' AS json,
        'order ' || order_id AS text FROM ord"""),
}
