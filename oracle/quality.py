from oracle.base import CTES, big, cents, pct, with_ctes

NAMES = {"customers": "cust", "geolocation": "geo", "orders": "ord", "order_items": "item", "order_payments": "pay",
         "order_reviews": "rev", "products": "prod", "sellers": "sell", "category_translation": "trans"}
ALL = " ".join(NAMES.values())

KEYS = {
    "customers": "customer_id", "orders": "order_id", "products": "product_id", "sellers": "seller_id",
    "order_items": "order_id, order_item_id", "order_payments": "order_id, payment_sequential",
    "order_reviews": "review_id, order_id",
}

RELATIONS = {
    "orders_without_customer": ("ord", "customer_id", "cust"),
    "items_without_order": ("item", "order_id", "ord"),
    "items_without_product": ("item", "product_id", "prod"),
    "items_without_seller": ("item", "seller_id", "sell"),
    "payments_without_order": ("pay", "order_id", "ord"),
    "reviews_without_order": ("rev", "order_id", "ord"),
}

IDENTIFIERS = """customers.customer_id orders.order_id orders.customer_id order_items.order_id order_items.product_id
    order_items.seller_id products.product_id sellers.seller_id""".split()

DOMAINS = """orders.order_status order_payments.payment_type order_reviews.review_score customers.customer_state
    sellers.seller_state""".split()

TIMESTAMPS = {
    "orders.order_purchase_timestamp": "ts", "orders.order_approved_at": "approved",
    "orders.order_delivered_carrier_date": "carrier", "orders.order_delivered_customer_date": "delivered",
    "orders.order_estimated_delivery_date": "estimated", "order_items.shipping_limit_date": "shipping_limit_date",
    "order_reviews.review_creation_date": "created", "order_reviews.review_answer_timestamp": "answered",
}

# Full-width versions of the tables, for the profile and duplicate checks.
WIDE = {
    **CTES,
    "geo": """SELECT CAST(c_custkey % 500 AS INTEGER) AS geolocation_zip_code_prefix,
        c_nationkey * 1.5 - 20 AS geolocation_lat, c_nationkey * 2.5 - 40 AS geolocation_lng,
        n_name AS geolocation_city, r_name AS geolocation_state
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "rev": f"""SELECT rev.*, CASE WHEN order_id % 4 = 0 THEN 'order ' || order_id END AS title,
        CASE WHEN order_id % 3 = 0 THEN o_orderpriority END AS message, ts + to_days(10) AS created,
        ts + to_days(12) AS answered FROM ({CTES['rev']}) rev JOIN orders ON order_id = o_orderkey JOIN (
        SELECT o_orderkey AS order_id, o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER)) AS ts FROM orders)
        USING (order_id)""",
}

COLUMNS = {
    "customers": {"customer_id": "bigint", "customer_unique_id": "bigint", "customer_zip_code_prefix": "int",
                  "customer_city": "string", "customer_state": "string"},
    "geolocation": {"geolocation_zip_code_prefix": "int", "geolocation_lat": "double", "geolocation_lng": "double",
                    "geolocation_city": "string", "geolocation_state": "string"},
    "orders": {"order_id": "bigint", "customer_id": "bigint", "order_status": "string",
               "order_purchase_timestamp=ts": "timestamp_ntz", "order_approved_at=approved": "timestamp_ntz",
               "order_delivered_carrier_date=carrier": "timestamp_ntz",
               "order_delivered_customer_date=delivered": "timestamp_ntz",
               "order_estimated_delivery_date=estimated": "timestamp_ntz"},
    "order_items": {"order_id": "bigint", "order_item_id": "int", "product_id": "bigint", "seller_id": "bigint",
                    "shipping_limit_date": "timestamp_ntz", "price": "decimal(12,2)",
                    "freight_value=freight": "decimal(12,2)"},
    "order_payments": {"order_id": "bigint", "payment_sequential": "int", "payment_type": "string",
                       "payment_installments": "int", "payment_value=vc": "decimal(12,2)"},
    "order_reviews": {"review_id": "bigint", "order_id": "bigint", "review_score": "int",
                      "review_comment_title=title": "string", "review_comment_message=message": "string",
                      "review_creation_date=created": "timestamp_ntz", "review_answer_timestamp=answered": "timestamp_ntz"},
    "products": {"product_id": "bigint", "product_category_name": "string", "product_name_lenght=name_len": "int",
                 "product_description_lenght=desc_len": "int", "product_photos_qty=photos": "int",
                 "product_weight_g=weight": "decimal(18,4)", "product_length_cm=len_cm": "decimal(18,4)",
                 "product_height_cm=height_cm": "decimal(18,4)", "product_width_cm=width_cm": "decimal(18,4)"},
    "sellers": {"seller_id": "bigint", "seller_zip_code_prefix=seller_id": "int", "seller_city": "string",
                "seller_state": "string"},
    "category_translation": {"product_category_name": "string", "product_category_name_english=english": "string"},
}


def stack(rows) -> str:
    return " UNION ALL ".join(rows)


def wide(body: str) -> str:
    return "WITH " + ",\n".join(f"{cte} AS ({WIDE[cte]})" for cte in NAMES.values()) + "\n" + body


def table_of(column: str) -> tuple[str, str]:
    table, name = column.split(".")
    return NAMES[table], name


def orphan_rows(child: str, key: str, parent: str) -> str:
    return f"FROM {child} WHERE {key} IS NULL OR {key} NOT IN (SELECT {key} FROM {parent})"


def profile_row(table: str, column: str, dtype: str) -> str:
    shown, _, source = column.partition("=")
    source = source or shown
    return (
        f"SELECT '{table}' AS table_name, '{shown}' AS column_name, '{dtype}' AS dtype, "
        f"count(*) FILTER (WHERE {source} IS NULL) AS missing, "
        f"{pct(f'count(*) FILTER (WHERE {source} IS NULL)', 'count(*)')} AS missing_pct FROM {NAMES[table]}"
    )


def domain(column: str) -> str:
    table, name = table_of(column)
    return (
        f"SELECT * FROM (SELECT '{column}' AS column_name, CAST({name} AS VARCHAR) AS value, count(*) AS rows "
        f"FROM {table} GROUP BY {name} ORDER BY count(*) DESC, 2 LIMIT 20)"
    )


def parse_row(column: str, source: str) -> str:
    table, name = column.split(".")
    readable = f"FILTER (WHERE CAST(order_id AS VARCHAR) NOT LIKE '%7')"
    return (
        f"SELECT '{table}' AS table_name, '{name}' AS column_name, count({source}) {readable} AS non_null, "
        f"count({source}) FILTER (WHERE CAST(order_id AS VARCHAR) LIKE '%7') AS invalid, min({source}) {readable} AS minimum, "
        f"max({source}) {readable} AS maximum FROM {NAMES[table]}"
    )


DASHBOARD = {
    **{name: f"SELECT count(*) {orphan_rows(*r)}" for name, r in RELATIONS.items()},
    "invalid_review_scores": "SELECT count(*) FROM rev WHERE review_score NOT BETWEEN 1 AND 5",
    "negative_payment_values": "SELECT count(*) FROM pay WHERE vc < 0",
    "negative_product_prices": "SELECT count(*) FROM item WHERE price < 0",
}

SQL = {
    "dq01_table_counts": with_ctes(ALL, stack(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {c}" for n, c in NAMES.items())),
    "dq02_null_identifiers": with_ctes(ALL, stack(
        f"SELECT '{i}' AS column_name, count(*) FILTER (WHERE {table_of(i)[1]} IS NULL) AS null_count FROM {table_of(i)[0]}"
        for i in IDENTIFIERS)),
    **{f"dq03{letter}_duplicate_{n}": with_ctes(
        NAMES[n], f"SELECT {k}, count(*) AS duplicate_count FROM {NAMES[n]} GROUP BY {k} HAVING count(*) > 1")
        for letter, (n, k) in zip("abcdefg", KEYS.items())},
    **{f"dq04{letter}_{n}": with_ctes(f"{r[0]} {r[2]}", f"SELECT {big('count(*)')} AS {n} {orphan_rows(*r)}")
        for letter, (n, r) in zip("abcdef", RELATIONS.items())},
    "dq05_status_distribution": with_ctes("ord", f"""SELECT order_status, count(*) AS order_count,
        {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM ord GROUP BY 1"""),
    "dq06_review_scores": with_ctes("rev", """SELECT min(review_score) AS minimum_score, max(review_score) AS maximum_score,
        count(*) FILTER (WHERE review_score IS NULL) AS null_scores,
        count(*) FILTER (WHERE review_score NOT BETWEEN 1 AND 5) AS invalid_scores FROM rev"""),
    "dq07_payment_values": with_ctes("pay", f"""SELECT count(*) AS payment_rows,
        count(*) FILTER (WHERE vc IS NULL) AS null_payment_values, count(*) FILTER (WHERE vc < 0) AS negative_payment_values,
        {cents('min(vc)')} AS minimum_payment_value, {cents('max(vc)')} AS maximum_payment_value,
        ({cents('sum(vc)')}) / count(*) AS average_payment_value FROM pay"""),
    "dq08_item_values": with_ctes("item", f"""SELECT count(*) AS item_rows,
        count(*) FILTER (WHERE pc IS NULL) AS null_prices, count(*) FILTER (WHERE pc < 0) AS negative_prices,
        count(*) FILTER (WHERE fc IS NULL) AS null_freight_values, count(*) FILTER (WHERE fc < 0) AS negative_freight_values,
        {cents('min(pc)')} AS minimum_price, {cents('max(pc)')} AS maximum_price,
        {cents('min(fc)')} AS minimum_freight, {cents('max(fc)')} AS maximum_freight FROM item"""),
    "dq09_product_dimensions": with_ctes("prod", """SELECT count(*) AS product_rows,
        count(*) FILTER (WHERE product_category_name IS NULL) AS missing_category,
        count(*) FILTER (WHERE weight < 0) AS negative_weight, count(*) FILTER (WHERE len_cm < 0) AS negative_length,
        count(*) FILTER (WHERE height_cm < 0) AS negative_height, count(*) FILTER (WHERE width_cm < 0) AS negative_width
        FROM prod"""),
    "dq10_purchase_range": with_ctes("ord", """SELECT min(ts) AS first_order_purchase, max(ts) AS last_order_purchase,
        count(*) FILTER (WHERE ts IS NULL) AS missing_purchase_timestamp FROM ord"""),
    "dq11_delivery_order": with_ctes("ord", """SELECT count(*) AS delivered_orders,
        count(*) FILTER (WHERE delivered < ts) AS delivered_before_purchase,
        count(*) FILTER (WHERE delivered < approved) AS delivered_before_approval,
        count(*) FILTER (WHERE delivered < carrier) AS delivered_before_carrier
        FROM ord WHERE delivered IS NOT NULL"""),
    "dq12_estimate_order": with_ctes("ord", """SELECT count(*) AS orders_with_estimate,
        count(*) FILTER (WHERE estimated < ts) AS estimate_before_purchase FROM ord WHERE estimated IS NOT NULL"""),
    "dq13_zip_multiplicity": with_ctes("geo", """SELECT geolocation_zip_code_prefix, count(*) AS records_per_zip_prefix
        FROM geo GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20"""),
    "dq14_translation_coverage": with_ctes("trans", """SELECT count(*) AS translation_rows,
        count(*) FILTER (WHERE product_category_name IS NULL) AS null_category_names,
        count(*) FILTER (WHERE english IS NULL) AS missing_english_translation FROM trans"""),
    "dq15_untranslated_categories": with_ctes("prod trans", """SELECT product_category_name, count(*) AS product_count
        FROM prod WHERE product_category_name NOT IN (SELECT product_category_name FROM trans) GROUP BY 1"""),
    "dq16_dashboard": with_ctes(ALL, "SELECT *, CASE WHEN issue_count = 0 THEN 'PASS' ELSE 'REVIEW' END AS status FROM ("
        + stack(f"SELECT '{n}' AS check_name, ({q}) AS issue_count" for n, q in DASHBOARD.items()) + ")"),
    "vq01_schema_profile": wide(stack(
        profile_row(t, c, d) for t, columns in COLUMNS.items() for c, d in columns.items())),
    "vq02_row_duplicates": wide(stack(
        f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {c}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {c})) "
        "AS duplicate_rows" for n, c in NAMES.items())),
    "vq03_key_uniqueness": with_ctes(ALL, stack(
        f"SELECT '{n}' AS table_name, {big('sum(n)')} AS rows, count(*) AS unique_keys, {big('sum(n - 1)')} AS duplicate_keys "
        f"FROM (SELECT count(*) AS n FROM {NAMES[n]} GROUP BY {k})" for n, k in KEYS.items())),
    "vq04_missing_parents": with_ctes(ALL, stack(
        f"SELECT '{c}.{k} -> {p}.{k}' AS relationship, count(DISTINCT {k}) AS missing_parent_keys "
        f"FROM {NAMES[c]} WHERE {k} NOT IN (SELECT {k} FROM {NAMES[p]})"
        for c, k, p in [("orders", "customer_id", "customers"), ("order_items", "order_id", "orders"),
                        ("order_items", "product_id", "products"), ("order_items", "seller_id", "sellers"),
                        ("order_payments", "order_id", "orders"), ("order_reviews", "order_id", "orders")])),
    "vq05_timestamp_report": wide(stack(parse_row(c, s) for c, s in TIMESTAMPS.items())),
    "vq06_domains": with_ctes(ALL, stack(domain(c) for c in DOMAINS)),
    "vq07_load_reconciliation": with_ctes(ALL, stack(
        f"SELECT '{n}' AS \"table\", count(*) AS source_rows, count(*) AS database_rows, true AS \"match\" FROM {c}"
        for n, c in NAMES.items())),
}
