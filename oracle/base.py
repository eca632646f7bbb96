"""Shared CTE prefix of the oracle statements, and exact rounding as SQL text.

Money is kept in integer cents (``pc`` price, ``fc`` freight, ``vc`` payment), so
sums and rounded ratios are integer arithmetic.
"""

from __future__ import annotations

CTES = {
    "cust": """SELECT c_custkey AS customer_id, c_custkey // 2 AS customer_unique_id,
        CAST(c_custkey % 500 AS INTEGER) AS customer_zip_code_prefix, n_name AS customer_city, r_name AS customer_state
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "geo": """SELECT CAST(c_custkey % 500 AS INTEGER) AS geolocation_zip_code_prefix FROM customer""",
    "ord": """SELECT o_orderkey AS order_id, o_custkey AS customer_id,
        CASE WHEN o_orderkey % 97 = 0 THEN 'canceled' WHEN o_orderkey % 89 = 0 THEN 'unavailable'
             WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped'
             WHEN o_orderstatus = 'P' THEN 'processing' END AS order_status,
        o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER)) AS ts,
        CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER))
             + to_days(CAST(o_orderkey % 3 AS INTEGER)) END AS approved,
        first_ship AS carrier, CASE WHEN o_orderstatus <> 'P' THEN last_ship END AS delivered,
        o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER))
             + to_days(CAST(o_orderkey % 40 + 20 AS INTEGER)) AS estimated
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
                               FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "item": """SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
        l_suppkey AS seller_id, l_shipdate AS shipping_limit_date, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
        CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS freight,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS pc,
        CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) * 100 AS BIGINT) AS fc
        FROM lineitem""",
    "pay": """SELECT order_id, CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS payment_sequential,
        CASE flag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' ELSE 'voucher' END AS payment_type,
        installments AS payment_installments, vc FROM (
            SELECT order_id, l_returnflag AS flag, count(*) AS installments, CAST(sum(pc) AS BIGINT) AS vc FROM (
                SELECT l_orderkey AS order_id, l_returnflag,
                       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS pc FROM lineitem)
            GROUP BY ALL)""",
    "rev": """SELECT o_orderkey * 2 + which AS review_id, o_orderkey AS order_id,
        CAST(1 + (o_orderkey * (7 - 4 * which) + o_custkey) % 5 AS INTEGER) AS review_score
        FROM orders JOIN (SELECT 0 AS which UNION ALL SELECT 1) ON which = 0 OR o_orderkey % 17 = 0
        WHERE o_orderkey % 10 <> 0""",
    "prod": """SELECT p_partkey AS product_id, CASE WHEN p_size > 3 THEN p_type END AS product_category_name,
        length(p_name) AS name_len, length(p_name) * 3 + length(p_brand) AS desc_len,
        CASE WHEN p_size % 7 <> 0 THEN p_size % 5 + 1 END AS photos, p_size * 10 AS weight,
        p_size + 5 AS len_cm, p_size * 0.5 AS height_cm, p_size % 9 - 1 AS width_cm FROM part""",
    "sell": """SELECT s_suppkey AS seller_id, n_name AS seller_city, r_name AS seller_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "trans": """SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS english
        FROM part WHERE p_type <> 'PROMO'""",
    "cat": """SELECT prod.*, coalesce(english, prod.product_category_name, 'Unknown') AS category
        FROM prod LEFT JOIN trans ON prod.product_category_name = trans.product_category_name""",
    "po": """SELECT customer_unique_id, customer_city, customer_state, ord.* FROM cust JOIN ord USING (customer_id)""",
    "sale": """SELECT po.*, order_item_id, product_id, seller_id, price, freight, pc, fc FROM po JOIN item USING (order_id)""",
}

NEEDS = {"cat": ["prod", "trans"], "po": ["cust", "ord"], "sale": ["po", "item"]}


def with_ctes(names: str, body: str, **more: str) -> str:
    """Statement text with the named CTEs (and what they need) in front of ``body``."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    parts = [f"{name} AS ({CTES[name]})" for name in wanted] + [f"{name} AS ({text})" for name, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def cents(expr: str) -> str:
    """Integer cents to double money."""
    return f"CAST({expr} AS DOUBLE) / 100.0"


def half_up(top: str, bottom: str, scale: int = 100) -> str:
    """round(top / bottom) half away from zero in integers, divided by ``scale``."""
    t, b = f"CAST({top} AS HUGEINT)", f"CAST({bottom} AS HUGEINT)"
    return f"CAST(sign({t}) * ((2 * abs({t}) + {b}) // (2 * {b})) AS DOUBLE) / {float(scale)}"


def pct(part: str, whole: str) -> str:
    """round(100 * part / whole, 2) for integer operands."""
    return half_up(f"10000 * ({part})", whole)


def days(later: str, earlier: str) -> str:
    return f"(CAST(epoch_us({later}) - epoch_us({earlier}) AS DOUBLE) / 86400000000.0)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def quantile(expr: str, p: float) -> str:
    return f"quantile_cont(CAST({expr} AS DOUBLE), {p})"


def cutoff(source: str, ts: str = "ts") -> str:
    return (
        f"SELECT make_timestamp(CAST(round(quantile_cont(CAST(epoch_us({ts}) AS DOUBLE), 0.8)) AS BIGINT)) AS cutoff "
        f"FROM {source}"
    )
