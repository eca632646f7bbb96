"""Canonical table schemas and keys."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = {
    "customers": (
        "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
        "customer_city string, customer_state string"
    ),
    "geolocation": (
        "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
        "geolocation_city string, geolocation_state string"
    ),
    "orders": (
        "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
        "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"
    ),
    "order_items": (
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "shipping_limit_date timestamp_ntz, price decimal(12,2), freight_value decimal(12,2)"
    ),
    "order_payments": (
        "order_id string, payment_sequential int, payment_type string, payment_installments int, "
        "payment_value decimal(12,2)"
    ),
    "order_reviews": (
        "review_id string, order_id string, review_score int, review_comment_title string, "
        "review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz"
    ),
    "products": (
        "product_id string, product_category_name string, product_name_lenght int, "
        "product_description_lenght int, product_photos_qty int, product_weight_g decimal(18,4), "
        "product_length_cm decimal(18,4), product_height_cm decimal(18,4), product_width_cm decimal(18,4)"
    ),
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string",
    "category_translation": "product_category_name string, product_category_name_english string",
}

# Declared keys.  The plans rely on the single-column ones being unique; the
# data-quality queries check all of them.
KEYS = {
    "customers": ["customer_id"],
    "orders": ["order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["review_id", "order_id"],
}

# (name, child table, child column, parent table, parent column)
RELATIONS = [
    ("orders_without_customer", "orders", "customer_id", "customers", "customer_id"),
    ("items_without_order", "order_items", "order_id", "orders", "order_id"),
    ("items_without_product", "order_items", "product_id", "products", "product_id"),
    ("items_without_seller", "order_items", "seller_id", "sellers", "seller_id"),
    ("payments_without_order", "order_payments", "order_id", "orders", "order_id"),
    ("reviews_without_order", "order_reviews", "order_id", "orders", "order_id"),
]

# File names of the public CSV distribution of the dataset (fixed values).
CSV_FILES = {
    "customers": "olist_customers_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "products": "olist_products_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
}


def struct_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
