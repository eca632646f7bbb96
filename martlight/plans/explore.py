"""Exploratory analyses eq01-eq16."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlight.functions.columns import days_between, exact_ratio, mean_days, micros_between, money, share_ratio
from martlight.operators.checks import histogram, label_union, profile_numeric, row_count
from martlight.operators.ordering import exact_quantiles, ordered_prefix, top_k
from martlight.plans import customer, product, quality
from martlight.plans.facts import customer_spend
from martlight.session import stable
from martlight.sources.tables import Marketplace

TS = "order_purchase_timestamp"
DELIVERED = "order_delivered_customer_date"
ESTIMATE = "order_estimated_delivery_date"


def entity_counts(t: Marketplace) -> DataFrame:
    """eq01"""
    short = {"order_payments": "payments", "order_reviews": "reviews"}
    counts = {short.get(name, name): row_count(df) for name, df in t.items().items()}
    return label_union(counts, "entity", "row_count").orderBy("entity")


def spend_rows(t: Marketplace) -> DataFrame:
    """eq04: spend per person."""
    return customer_spend(t).select("customer_unique_id", money("total_spend").alias("total_spend"))


def _described(df: DataFrame, columns: list[str]) -> DataFrame:
    report = profile_numeric(df, columns)
    rounded = {c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")}
    return report.withColumns(rounded)


def _bins(df: DataFrame, column: str, bins: int, log1p: bool = False) -> DataFrame:
    return histogram(df, column, bins, log1p).withColumn("bin_start", F.round("bin_start", 6))


def spend_profile(t: Marketplace) -> DataFrame:
    return _described(stable(spend_rows(t)), ["total_spend"])


def spend_histogram(t: Marketplace) -> DataFrame:
    return _bins(stable(spend_rows(t)), "total_spend", 60)


def spend_log_histogram(t: Marketplace) -> DataFrame:
    return _bins(stable(spend_rows(t)), "total_spend", 60, log1p=True)


def top_states(t: Marketplace) -> DataFrame:
    """eq05"""
    return top_k(customer.geography(t, "revenue"), [F.desc("revenue"), F.col("customer_state")], 15)


def top_categories(t: Marketplace) -> DataFrame:
    """eq07"""
    report = product.category_performance(t).select(
        "category",
        "product_count",
        "order_count",
        "item_count",
        F.col("product_revenue").alias("revenue"),
        F.col("average_item_price").alias("average_price"),
    )
    return top_k(report, [F.desc("revenue"), F.col("category")], 20)


def _prices(t: Marketplace) -> DataFrame:
    return t.order_items.where(F.col("price").isNotNull()).select("price", "freight_value")


def price_profile(t: Marketplace) -> DataFrame:
    """eq08"""
    return _described(_prices(t), ["price", "freight_value"])


def price_histogram(t: Marketplace) -> DataFrame:
    return _bins(_prices(t), "price", 80)


def score_distribution(t: Marketplace) -> DataFrame:
    """eq09"""
    counts = t.order_reviews.groupBy("review_score").agg(F.count(F.lit(1)).alias("review_count"))
    total = F.sum("review_count").over(Window.partitionBy())
    return counts.withColumn("percentage", share_ratio("review_count", total)).orderBy("review_score")


def weak_categories(t: Marketplace) -> DataFrame:
    """eq10: categories with at least 20 different reviews, the 20 lowest first."""
    report = product.category_reviews(t).where(F.col("review_count") >= 20)
    report = report.select("category", "review_count", "average_review_score")
    return top_k(report, [F.col("average_review_score"), F.col("category")], 20)


def payment_methods(t: Marketplace) -> DataFrame:
    """eq11: payments are summed per order first, so orders are counted without a distinct pass."""
    per_order = t.order_payments.groupBy("payment_type", "order_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payment_value").alias("value")
    )
    return (
        per_order.groupBy("payment_type")
        .agg(
            F.sum("n").alias("payment_records"),
            F.count(F.lit(1)).alias("orders"),
            money(F.sum("value")).alias("payment_value"),
            exact_ratio(F.sum("value"), F.sum("n")).alias("average_payment"),
        )
        .orderBy(F.desc("payment_value"), "payment_type")
    )


def delivery_rows(t: Marketplace) -> DataFrame:
    """eq12"""
    return t.orders.where(F.col(DELIVERED).isNotNull()).select(
        "order_id",
        TS,
        DELIVERED,
        ESTIMATE,
        days_between(DELIVERED, TS).alias("delivery_days"),
        days_between(DELIVERED, ESTIMATE).alias("delivery_vs_estimate_days"),
    )


def delivery_profile(t: Marketplace) -> DataFrame:
    return _described(stable(delivery_rows(t)), ["delivery_days", "delivery_vs_estimate_days"])


def delivery_histogram(t: Marketplace) -> DataFrame:
    return _bins(delivery_rows(t), "delivery_days", 70)


def _delivery_micros(t: Marketplace) -> DataFrame:
    return t.orders.where(F.col(DELIVERED).isNotNull()).select(
        micros_between(DELIVERED, TS).alias("transit"), micros_between(DELIVERED, ESTIMATE).alias("lateness")
    )


def delivery_summary(t: Marketplace) -> DataFrame:
    """eq13"""
    rows = _delivery_micros(t)
    median = exact_quantiles(rows, "transit", {"m": 0.5})

    def mean(column: str):
        return mean_days(F.sum(F.col(column).cast("decimal(20,0)")), F.count(column))

    stats = rows.agg(
        mean("transit").alias("Average delivery days"),
        mean("lateness").alias("Average days vs estimate"),
        share_ratio(F.count_if(F.col("lateness") < 0), F.count(F.lit(1))).alias("% delivered before estimate"),
        share_ratio(F.count_if(F.col("lateness") > 0), F.count(F.lit(1))).alias("% delivered after estimate"),
    ).withColumn("Median delivery days", mean_days(median.scalar()))
    return stats.unpivot([], [f"`{c}`" for c in stats.columns], "metric", "value")


def seller_revenue(t: Marketplace) -> DataFrame:
    """eq14"""
    return product.seller_performance(t).select(
        "seller_id", "seller_state", "order_count", "product_count", F.col("product_revenue").alias("revenue")
    )


def seller_histogram(t: Marketplace) -> DataFrame:
    return _bins(stable(seller_revenue(t)), "revenue", 60)


def concentration_curve(t: Marketplace) -> DataFrame:
    """eq15: the whole curve, ordered over range partitions."""
    spend = customer_spend(t).select("customer_unique_id", "total_spend")
    order = [F.desc("total_spend"), F.col("customer_unique_id")]
    curve = ordered_prefix(spend, order, ["total_spend"])
    running, total = F.col("running_total_spend").cast("double"), F.col("total_total_spend").cast("double")
    return curve.orderBy("position").select(
        "customer_unique_id",
        money("total_spend").alias("total_spend"),
        (F.lit(100.0) * running / total).alias("cumulative_revenue_percentage"),
    )


def summary_metrics(t: Marketplace) -> DataFrame:
    """eq16"""
    counts = {
        "total_customers": t.customers,
        "total_orders": t.orders,
        "total_products": t.products,
        "total_sellers": t.sellers,
        "total_reviews": t.order_reviews,
        "total_order_items": t.order_items,
    }
    numbers = {name: row_count(df).select(F.col("n").cast("double")) for name, df in counts.items()}
    spend, transit = stable(customer_spend(t).select("total_spend")), _delivery_micros(t)
    day = F.lit(86400e6)
    numbers["total_revenue"] = spend.agg(F.sum("total_spend").cast("double"))
    numbers["median_customer_spend"] = exact_quantiles(spend, "total_spend", {"m": 0.5}).select(F.round("m", 6))
    mean = F.sum(F.col("transit").cast("decimal(20,0)")).cast("double") / F.count("transit") / day
    numbers["average_delivery_days"] = transit.agg(mean)
    numbers["median_delivery_days"] = exact_quantiles(transit, "transit", {"m": 0.5}).select(F.col("m") / day)
    return label_union(numbers, "metric", "value")


QUERIES = {
    "eq01_entity_counts": entity_counts,
    "eq02_status_share": quality.status_distribution,
    "eq03_customer_type": customer.repeat_share,
    "eq04a_spend_rows": spend_rows,
    "eq04b_spend_profile": spend_profile,
    "eq04c_spend_histogram": spend_histogram,
    "eq04d_spend_log_histogram": spend_log_histogram,
    "eq05_top_states": top_states,
    "eq06_monthly_revenue": customer.monthly_activity,
    "eq07_top_categories": top_categories,
    "eq08a_price_profile": price_profile,
    "eq08b_price_histogram": price_histogram,
    "eq09_score_distribution": score_distribution,
    "eq10_weak_categories": weak_categories,
    "eq11_payment_methods": payment_methods,
    "eq12a_delivery_rows": delivery_rows,
    "eq12b_delivery_profile": delivery_profile,
    "eq12c_delivery_histogram": delivery_histogram,
    "eq13_delivery_summary": delivery_summary,
    "eq14a_seller_revenue": seller_revenue,
    "eq14b_seller_histogram": seller_histogram,
    "eq15_concentration_curve": concentration_curve,
    "eq16_summary_metrics": summary_metrics,
}
