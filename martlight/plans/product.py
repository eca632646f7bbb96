"""Product, category and seller analyses pq01-pq18."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlight.functions.columns import exact_ratio, mean_days, micros_between, money, month_of, share_ratio
from martlight.operators.ordering import dense_rank_in, exact_quantiles, top_k
from martlight.plans.facts import product_categories
from martlight.sources.tables import Marketplace

TS = "order_purchase_timestamp"


def product_sales(items: DataFrame) -> DataFrame:
    """Items summed per product, with the number of different orders."""
    return items.groupBy("product_id").agg(
        F.countDistinct("order_id").alias("order_count"),
        F.count(F.lit(1)).alias("item_count"),
        F.sum("price").alias("revenue"),
        F.sum("freight_value").alias("freight"),
    )


def _product_sums(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("price").alias("revenue"),
        F.sum("freight_value").alias("freight"),
    )


def categories(t: Marketplace) -> DataFrame:
    return product_categories(t).select("product_id", "category")


def category_sums(t: Marketplace) -> DataFrame:
    """Per category: products sold, item rows, revenue and freight (additive over products)."""
    return (
        _product_sums(t.order_items)
        .join(categories(t), "product_id")
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("product_count"),
            F.sum("item_count").alias("item_count"),
            F.sum("revenue").alias("revenue"),
            F.sum("freight").alias("freight"),
        )
    )


def category_orders(t: Marketplace) -> DataFrame:
    """Per category: number of different orders."""
    lines = t.order_items.select("order_id", "product_id").join(categories(t), "product_id")
    return lines.groupBy("category").agg(F.countDistinct("order_id").alias("order_count"))


def product_performance(t: Marketplace) -> DataFrame:
    """pq01"""
    sold = product_sales(t.order_items).join(t.products.select("product_id", "product_category_name"), "product_id")
    return sold.select(
        "product_id",
        "product_category_name",
        "order_count",
        "item_count",
        money("revenue").alias("product_revenue"),
        exact_ratio("revenue", "item_count").alias("average_item_price"),
        exact_ratio("freight", "item_count").alias("average_freight"),
    ).orderBy(F.desc("product_revenue"), "product_id")


def top_products(t: Marketplace) -> DataFrame:
    """pq02"""
    sold = product_sales(t.order_items).join(categories(t), "product_id")
    return top_k(sold, [F.desc("revenue"), F.col("product_id")], 20).select(
        "product_id", "category", "item_count", "order_count", money("revenue").alias("revenue")
    )


def category_performance(t: Marketplace) -> DataFrame:
    """pq03"""
    return (
        category_sums(t)
        .join(category_orders(t), "category")
        .select(
            "category",
            "product_count",
            "order_count",
            "item_count",
            money("revenue").alias("product_revenue"),
            money("freight").alias("freight_revenue"),
            exact_ratio("revenue", "item_count").alias("average_item_price"),
        )
        .orderBy(F.desc("product_revenue"), "category")
    )


def category_revenue_share(t: Marketplace) -> DataFrame:
    """pq04"""
    total = F.sum("revenue").over(Window.partitionBy())
    return (
        category_sums(t)
        .select("category", money("revenue").alias("revenue"), share_ratio("revenue", total).alias("revenue_share_pct"))
        .orderBy(F.desc("revenue"), "category")
    )


def _order_category(t: Marketplace) -> DataFrame:
    """Item rows and revenue per (order, category)."""
    return (
        t.order_items.join(categories(t), "product_id")
        .groupBy("order_id", "category")
        .agg(F.count(F.lit(1)).alias("item_count"), F.sum("price").alias("revenue"))
    )


def monthly_category_revenue(t: Marketplace) -> DataFrame:
    """pq05"""
    sales = _order_category(t).join(t.orders.select("order_id", TS), "order_id")
    return (
        sales.groupBy(month_of(TS).alias("purchase_month"), "category")
        .agg(money(F.sum("revenue")).alias("revenue"), F.count(F.lit(1)).alias("orders"))
        .orderBy("purchase_month", F.desc("revenue"), "category")
    )


def price_distribution(t: Marketplace) -> DataFrame:
    """pq06"""
    items = t.order_items.select("price")
    quartiles = exact_quantiles(items, "price", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    packed = quartiles.select(F.struct("p25", "p50", "p75")).scalar()
    stats = items.agg(
        F.count(F.lit(1)).alias("item_rows"),
        money(F.min("price")).alias("minimum_price"),
        money(F.max("price")).alias("maximum_price"),
        exact_ratio(F.sum("price"), F.count("price")).alias("average_price"),
    ).withColumn("q", packed)

    def quartile(name: str):
        return money(F.col(f"q.{name}").cast("decimal(18,4)"))

    return stats.select(
        "item_rows",
        "minimum_price",
        quartile("p25").alias("p25_price"),
        quartile("p50").alias("median_price"),
        quartile("p75").alias("p75_price"),
        "maximum_price",
        "average_price",
    )


def freight_ratio(t: Marketplace) -> DataFrame:
    """pq07: the ratio of the two means is the ratio of the two sums."""
    return (
        category_sums(t)
        .select(
            "category",
            exact_ratio("revenue", "item_count").alias("average_price"),
            exact_ratio("freight", "item_count").alias("average_freight"),
            share_ratio("freight", "revenue").alias("freight_to_price_pct"),
        )
        .orderBy(F.col("freight_to_price_pct").desc_nulls_last(), "category")
    )


def _seller_sales(t: Marketplace) -> DataFrame:
    """Both distinct counts come from tables keyed by seller, so they meet without another exchange."""
    per_product = t.order_items.groupBy("seller_id", "product_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.sum("price").alias("revenue")
    )
    sums = per_product.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.sum("item_count").alias("item_count"),
        F.sum("revenue").alias("revenue"),
    )
    orders = t.order_items.groupBy("seller_id").agg(F.countDistinct("order_id").alias("order_count"))
    places = t.sellers.select("seller_id", "seller_city", "seller_state")
    return sums.join(orders, "seller_id").join(places, "seller_id")


def seller_performance(t: Marketplace) -> DataFrame:
    """pq08"""
    return (
        _seller_sales(t)
        .select(
            "seller_id",
            "seller_city",
            "seller_state",
            "order_count",
            "product_count",
            "item_count",
            money("revenue").alias("product_revenue"),
            exact_ratio("revenue", "item_count").alias("average_item_price"),
        )
        .orderBy(F.desc("product_revenue"), "seller_id")
    )


def top_sellers(t: Marketplace) -> DataFrame:
    """pq09"""
    return top_k(_seller_sales(t), [F.desc("revenue"), F.col("seller_id")], 20).select(
        "seller_id",
        "seller_city",
        "seller_state",
        F.col("order_count").alias("orders"),
        F.col("product_count").alias("products"),
        money("revenue").alias("revenue"),
    )


def weighted_reviews(lines: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews per group where a review counts once per item row of its order.

    ``lines`` holds ``keys``, ``order_id`` and the number of item rows ``n``.
    """
    score, n = F.col("review_score"), F.col("n")
    return (
        lines.join(reviews.select("order_id", "review_id", "review_score"), "order_id")
        .groupBy(*keys)
        .agg(
            F.countDistinct("review_id").alias("review_count"),
            F.sum(F.when(F.col("review_id").isNotNull(), n)).alias("review_rows"),
            F.sum(score * n).alias("score_sum"),
            F.sum(F.when(score.isNotNull(), n)).alias("score_rows"),
            F.coalesce(F.sum(F.when(score <= 2, n)), F.lit(0)).alias("negative_reviews"),
            F.coalesce(F.sum(F.when(score >= 4, n)), F.lit(0)).alias("positive_reviews"),
        )
        .where(F.col("review_rows") > 0)
        .withColumn("average_review_score", exact_ratio("score_sum", "score_rows"))
    )


REVIEW_COLUMNS = ["review_count", "average_review_score", "negative_reviews", "positive_reviews"]


def seller_reviews(t: Marketplace) -> DataFrame:
    """pq10"""
    lines = t.order_items.groupBy("seller_id", "order_id").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.join(t.sellers.select("seller_id"), "seller_id", "left_semi")
    return (
        weighted_reviews(lines, t.order_reviews, ["seller_id"])
        .select("seller_id", *REVIEW_COLUMNS)
        .orderBy(F.col("average_review_score").desc_nulls_last(), "seller_id")
    )


def _category_reviews(t: Marketplace) -> DataFrame:
    lines = _order_category(t).select("order_id", "category", F.col("item_count").alias("n"))
    return weighted_reviews(lines, t.order_reviews, ["category"])


def category_reviews(t: Marketplace) -> DataFrame:
    """pq11"""
    return (
        _category_reviews(t)
        .select("category", *REVIEW_COLUMNS)
        .orderBy(F.col("average_review_score").desc_nulls_last(), "category")
    )


def product_reviews(t: Marketplace, limit: int = 50) -> DataFrame:
    """pq12: worst products first."""
    lines = t.order_items.groupBy("product_id", "order_id").agg(F.count(F.lit(1)).alias("n"))
    rated = weighted_reviews(lines, t.order_reviews, ["product_id"]).join(categories(t), "product_id")
    order = [F.col("average_review_score").asc_nulls_last(), F.desc("review_count"), F.col("product_id")]
    return top_k(rated, order, limit).select("product_id", "category", *REVIEW_COLUMNS[:3])


def catalogue(t: Marketplace) -> DataFrame:
    """pq13"""

    def mean(column: str, alias: str):
        return exact_ratio(F.sum(column), F.count(column)).alias(alias)

    return (
        product_categories(t)
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("products"),
            mean("product_name_lenght", "avg_name_length"),
            mean("product_description_lenght", "avg_description_length"),
            mean("product_photos_qty", "avg_photo_count"),
            mean("product_weight_g", "avg_weight_g"),
        )
        .orderBy(F.desc("products"), "category")
    )


def category_item_share(t: Marketplace) -> DataFrame:
    """pq14"""
    total = F.sum("item_count").over(Window.partitionBy())
    return (
        category_sums(t)
        .select("category", "item_count", share_ratio("item_count", total).alias("item_share_pct"))
        .orderBy(F.desc("item_count"), "category")
    )


def product_rank(t: Marketplace) -> DataFrame:
    """pq15"""
    sold = _product_sums(t.order_items).join(categories(t), "product_id").select("product_id", "category", "revenue")
    return (
        dense_rank_in(sold, ["category"], "revenue", "category_revenue_rank")
        .select("product_id", "category", money("revenue").alias("revenue"), "category_revenue_rank")
        .orderBy("category", "category_revenue_rank", "product_id")
    )


def seller_rank(t: Marketplace) -> DataFrame:
    """pq16"""
    per_product = t.order_items.groupBy("seller_id", "product_id").agg(F.sum("price").alias("revenue"))
    sold = (
        per_product.join(categories(t), "product_id")
        .groupBy("seller_id", "category")
        .agg(F.sum("revenue").alias("revenue"))
    )
    return (
        dense_rank_in(sold, ["category"], "revenue", "seller_category_rank")
        .select("seller_id", "category", money("revenue").alias("revenue"), "seller_category_rank")
        .orderBy("category", "seller_category_rank", "seller_id")
    )


def delivery_performance(t: Marketplace) -> DataFrame:
    """pq17: means over item rows, from one row per (order, category)."""
    delivered, estimate = "order_delivered_customer_date", "order_estimated_delivery_date"
    orders = t.orders.where(F.col(delivered).isNotNull()).select(
        "order_id",
        micros_between(delivered, TS).cast("decimal(20,0)").alias("transit"),
        micros_between(delivered, estimate).cast("decimal(20,0)").alias("lateness"),
    )
    n = F.col("item_count").cast("decimal(10,0)")

    def mean(column: str):
        weight = F.sum(F.when(F.col(column).isNotNull(), F.col("item_count")))
        return mean_days(F.sum(F.col(column) * n), weight)

    return (
        _order_category(t)
        .join(orders, "order_id")
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            mean("transit").alias("avg_purchase_to_delivery_days"),
            mean("lateness").alias("avg_delivery_vs_estimate_days"),
        )
        .orderBy(F.desc("avg_purchase_to_delivery_days"), "category")
    )


def category_scorecard(t: Marketplace) -> DataFrame:
    """pq18"""
    return (
        category_performance(t)
        .join(_category_reviews(t), "category", "left")
        .select(
            "category",
            "product_count",
            "order_count",
            "item_count",
            F.col("product_revenue").alias("revenue"),
            F.col("average_item_price").alias("average_price"),
            "review_count",
            "average_review_score",
        )
        .orderBy(F.desc("revenue"), "category")
    )


QUERIES = {
    "pq01_product_performance": product_performance,
    "pq02_top_products": top_products,
    "pq03_category_performance": category_performance,
    "pq04_category_revenue_share": category_revenue_share,
    "pq05_monthly_category_revenue": monthly_category_revenue,
    "pq06_price_distribution": price_distribution,
    "pq07_freight_ratio": freight_ratio,
    "pq08_seller_performance": seller_performance,
    "pq09_top_sellers": top_sellers,
    "pq10_seller_reviews": seller_reviews,
    "pq11_category_reviews": category_reviews,
    "pq12_product_reviews": product_reviews,
    "pq13_catalogue": catalogue,
    "pq14_category_item_share": category_item_share,
    "pq15_product_rank": product_rank,
    "pq16_seller_rank": seller_rank,
    "pq17_delivery_performance": delivery_performance,
    "pq18_category_scorecard": category_scorecard,
}
