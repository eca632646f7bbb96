"""Shared intermediate tables.

Item rows are summed to (order, ...) before they meet a dimension, so the wide
fact table is exchanged once and a hot order is already combined on the map side.
The parents' declared keys make ``count(*)`` over one-row-per-order tables equal
to a distinct count of orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlight.functions.columns import count_where
from martlight.sources.tables import Marketplace


def person_orders(t: Marketplace, *columns: str) -> DataFrame:
    """One row per order with the person who placed it and the named columns of either table."""
    wanted = ["customer_unique_id", "order_id", *columns]
    return t.customers.join(t.orders, "customer_id").select(*wanted)


def order_values(items: DataFrame) -> DataFrame:
    """Items summed per order."""
    return items.groupBy("order_id").agg(
        F.sum("price").alias("product_revenue"),
        F.sum("freight_value").alias("freight_revenue"),
        F.sum(F.col("price") + F.col("freight_value")).alias("order_value"),
        F.count(F.lit(1)).alias("item_count"),
    )


def order_products(items: DataFrame) -> DataFrame:
    """Items summed per (order, product)."""
    return items.groupBy("order_id", "product_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.sum("price").alias("revenue")
    )


def order_review_counts(reviews: DataFrame) -> DataFrame:
    """Reviews summed per order."""
    score = F.col("review_score")
    return reviews.groupBy("order_id").agg(
        F.count("review_id").alias("review_count"),
        F.sum(score.cast("long")).alias("score_sum"),
        F.count(score).alias("score_count"),
        count_where(score <= 2).alias("negative"),
        count_where(score >= 4).alias("positive"),
    )


def category_label(english: Column | str = "product_category_name_english") -> Column:
    """English name, else the source name, else 'Unknown'."""
    english = F.col(english) if isinstance(english, str) else english
    return F.coalesce(english, F.col("product_category_name"), F.lit("Unknown"))


def product_categories(t: Marketplace) -> DataFrame:
    """Products with their display category."""
    return t.products.join(t.category_translation, "product_category_name", "left").withColumn(
        "category", category_label()
    )


def customer_spend(t: Marketplace, *group: str) -> DataFrame:
    """Order count and total spend per person (and further customer columns)."""
    sales = person_orders(t, *group).join(order_values(t.order_items), "order_id")
    return sales.groupBy("customer_unique_id", *group).agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("order_value").alias("total_spend")
    )
