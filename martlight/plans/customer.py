"""Customer analyses cq01-cq18.  Every ranked result ends in a key so that ties are settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlight.functions.columns import (
    days_between,
    exact_ratio,
    mean_days,
    micros_between,
    money,
    month_of,
    share_ratio,
)
from martlight.operators.ordering import exact_quantiles, ntile_global, prev_value, top_k
from martlight.plans.facts import (
    customer_spend,
    order_review_counts,
    order_values,
    person_orders,
)
from martlight.session import stable
from martlight.sources.tables import Marketplace

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"


def orders_per_customer(t: Marketplace) -> DataFrame:
    """cq01: a person who moved appears once per address."""
    per_account = t.orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(TS).alias("first"), F.max(TS).alias("last")
    )
    return (
        t.customers.join(per_account, "customer_id")
        .groupBy(PERSON, "customer_city", "customer_state")
        .agg(
            F.sum("n").alias("order_count"),
            F.min("first").alias("first_order_date"),
            F.max("last").alias("last_order_date"),
        )
        .orderBy(F.desc("order_count"), PERSON, "customer_city")
    )


def order_counts(t: Marketplace) -> DataFrame:
    per_account = t.orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return t.customers.join(per_account, "customer_id").groupBy(PERSON).agg(F.sum("n").alias("order_count"))


def repeat_share(t: Marketplace) -> DataFrame:
    """cq02, eq03"""
    label = F.when(F.col("order_count") == 1, "One-time customer").otherwise("Repeat customer")
    counts = order_counts(t).groupBy(label.alias("customer_type")).agg(F.count(F.lit(1)).alias("customer_count"))
    total = F.sum("customer_count").over(Window.partitionBy())
    return counts.withColumn("percentage", share_ratio("customer_count", total)).orderBy(F.desc("customer_count"))


def order_frequency(t: Marketplace) -> DataFrame:
    """cq03"""
    counts = stable(order_counts(t))
    stats = counts.agg(
        exact_ratio(F.sum("order_count"), F.count(F.lit(1))).alias("average_orders_per_customer"),
        F.min("order_count").alias("minimum_orders"),
        F.max("order_count").alias("maximum_orders"),
    )
    median = exact_quantiles(counts, "order_count", {"median_orders": 0.5})
    return stats.withColumn("median_orders", median.scalar())


def spend_summary(t: Marketplace) -> DataFrame:
    """cq04"""
    spend = stable(customer_spend(t).select("total_spend"))
    stats = spend.agg(
        F.count(F.lit(1)).alias("customers"),
        exact_ratio(F.sum("total_spend"), F.count(F.lit(1))).alias("average_customer_spend"),
        money(F.min("total_spend")).alias("minimum_customer_spend"),
        money(F.max("total_spend")).alias("maximum_customer_spend"),
    )
    median = exact_quantiles(spend, "total_spend", {"m": 0.5})
    return stats.withColumn("median_customer_spend", money(median.scalar().cast("decimal(18,4)")))


def top_customers(t: Marketplace) -> DataFrame:
    """cq05"""
    spend = customer_spend(t, "customer_city", "customer_state")
    top = top_k(spend, [F.desc("total_spend"), F.col(PERSON), F.col("customer_city")], 20)
    return top.withColumn("total_spend", money("total_spend"))


def average_order_value(t: Marketplace) -> DataFrame:
    """cq06"""
    return (
        customer_spend(t)
        .select(
            PERSON,
            "order_count",
            exact_ratio("total_spend", "order_count").alias("average_order_value"),
            money("total_spend").alias("total_spend"),
        )
        .orderBy(F.desc("total_spend"), PERSON)
    )


def person_products(t: Marketplace) -> DataFrame:
    """Item lines per (person, product)."""
    lines = person_orders(t).join(t.order_items.select("order_id", "product_id"), "order_id")
    return lines.groupBy(PERSON, "product_id").agg(F.count(F.lit(1)).alias("item_line_count"))


def category_diversity(t: Marketplace) -> DataFrame:
    """cq07"""
    bought = person_products(t).join(t.products.select("product_id", "product_category_name"), "product_id")
    return (
        bought.groupBy(PERSON)
        .agg(F.countDistinct("product_category_name").alias("category_count"))
        .orderBy(F.desc("category_count"), PERSON)
    )


def product_diversity(t: Marketplace) -> DataFrame:
    """cq08"""
    return (
        person_products(t)
        .groupBy(PERSON)
        .agg(
            F.count("product_id").alias("unique_products_purchased"),
            F.sum("item_line_count").alias("item_line_count"),
        )
        .orderBy(F.desc("unique_products_purchased"), PERSON)
    )


def _person_reviews(t: Marketplace) -> DataFrame:
    reviewed = person_orders(t).join(order_review_counts(t.order_reviews), "order_id", "left")
    return reviewed.groupBy(PERSON).agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("review_count", "score_sum", "score_count", "negative", "positive")
        ]
    )


def review_behaviour(t: Marketplace) -> DataFrame:
    """cq09"""
    return (
        _person_reviews(t)
        .select(
            PERSON,
            "review_count",
            exact_ratio("score_sum", "score_count").alias("average_review_score"),
            F.col("negative").alias("negative_review_count"),
            F.col("positive").alias("positive_review_count"),
        )
        .orderBy(F.col("average_review_score").desc_nulls_last(), PERSON)
    )


def favourite_payment(t: Marketplace) -> DataFrame:
    """cq10: the best row is a min over (-count, -value, type), so no window is needed."""
    per_order = t.order_payments.groupBy("order_id", "payment_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payment_value").alias("value")
    )
    per_person = (
        person_orders(t)
        .join(per_order, "order_id")
        .groupBy(PERSON, "payment_type")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("value")).alias("value"), "payment_type"))
    return (
        per_person.groupBy(PERSON)
        .agg(best.alias("best"))
        .select(
            PERSON,
            F.col("best.payment_type").alias("most_used_payment_type"),
            (-F.col("best.n")).alias("payment_count"),
            money(-F.col("best.value")).alias("payment_value"),
        )
        .orderBy(F.desc("payment_count"), PERSON)
    )


def geography(t: Marketplace, revenue: str = "total_revenue") -> DataFrame:
    """cq11, eq05"""
    sales = person_orders(t, "customer_state").join(order_values(t.order_items), "order_id")
    return (
        sales.groupBy("customer_state")
        .agg(
            F.countDistinct(PERSON).alias("customer_count"),
            F.count(F.lit(1)).alias("order_count"),
            money(F.sum("order_value")).alias(revenue),
        )
        .orderBy(F.desc(revenue), "customer_state")
    )


def monthly_activity(t: Marketplace) -> DataFrame:
    """cq12, eq06"""
    sales = person_orders(t, TS).join(order_values(t.order_items), "order_id")
    return (
        sales.groupBy(month_of(TS).alias("purchase_month"))
        .agg(
            F.countDistinct(PERSON).alias("active_customers"),
            F.count(F.lit(1)).alias("orders"),
            money(F.sum("order_value")).alias("revenue"),
        )
        .orderBy("purchase_month")
    )


def _with_previous(t: Marketplace) -> DataFrame:
    history = prev_value(person_orders(t, TS), PERSON, [TS, "order_id"], TS, "previous_order_timestamp")
    return history.where(F.col("previous_order_timestamp").isNotNull())


def order_intervals(t: Marketplace) -> DataFrame:
    """cq13"""
    gap = days_between(TS, "previous_order_timestamp")
    return (
        _with_previous(t)
        .select(PERSON, "order_id", TS, "previous_order_timestamp", gap.alias("days_since_previous_order"))
        .orderBy(PERSON, TS, "order_id")
    )


def interval_statistics(t: Marketplace) -> DataFrame:
    """cq14"""
    gaps = stable(_with_previous(t).select(micros_between(TS, "previous_order_timestamp").alias("us")))
    stats = gaps.agg(
        F.count(F.lit(1)).alias("repeat_purchase_intervals"),
        mean_days(F.sum(F.col("us").cast("decimal(20,0)")), F.count(F.lit(1))).alias("average_days_between_orders"),
    )
    median = exact_quantiles(gaps, "us", {"m": 0.5}).scalar()
    return stats.withColumn("median_days_between_orders", mean_days(median))


def lifetime_summary(t: Marketplace) -> DataFrame:
    """cq15"""
    sales = person_orders(t, TS).join(order_values(t.order_items), "order_id")
    summary = sales.groupBy(PERSON).agg(
        F.min(TS).alias("first_purchase"),
        F.max(TS).alias("last_purchase"),
        F.count(F.lit(1)).alias("order_count"),
        F.sum("order_value").alias("total_spend"),
    )
    return summary.select(
        PERSON,
        "order_count",
        money("total_spend").alias("total_spend"),
        mean_days(micros_between("last_purchase", "first_purchase")).alias("customer_active_days"),
        "first_purchase",
        "last_purchase",
    ).orderBy(F.desc("total_spend"), PERSON)


def spend_deciles(t: Marketplace) -> DataFrame:
    """cq16"""
    spend = customer_spend(t).select(PERSON, "total_spend")
    ranked = ntile_global(spend, [F.desc("total_spend"), F.col(PERSON)], 10, "spend_decile")
    return (
        ranked.groupBy("spend_decile")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            money(F.sum("total_spend")).alias("revenue"),
            exact_ratio(F.sum("total_spend"), F.count(F.lit(1))).alias("average_customer_spend"),
        )
        .orderBy("spend_decile")
    )


def revenue_concentration(t: Marketplace, limit: int = 100) -> DataFrame:
    """cq17: only the listed rows are ordered; the total is a plain aggregate."""
    spend = stable(customer_spend(t).select(PERSON, "total_spend"))
    order = [F.desc("total_spend"), F.col(PERSON)]
    top = top_k(spend, order, limit)
    running = F.sum("total_spend").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    total = spend.agg(F.sum("total_spend")).scalar()
    return (
        top.withColumn("running", running)
        .withColumn("cumulative_revenue_percentage", share_ratio("running", total))
        .select(PERSON, money("total_spend").alias("total_spend"), "cumulative_revenue_percentage")
        .orderBy(F.desc("total_spend"), PERSON)
    )


def scorecard(t: Marketplace) -> DataFrame:
    """cq18"""
    bought = person_products(t).join(
        t.products.select("product_id", "product_category_name"), "product_id", "left"
    )
    diversity = bought.groupBy(PERSON).agg(
        F.count("product_id").alias("unique_products"),
        F.countDistinct("product_category_name").alias("unique_categories"),
    )
    return (
        customer_spend(t)
        .join(diversity, PERSON)
        .join(_person_reviews(t), PERSON, "left")
        .select(
            PERSON,
            "order_count",
            money("total_spend").alias("total_spend"),
            "unique_products",
            "unique_categories",
            exact_ratio("score_sum", "score_count").alias("average_review_score"),
            "review_count",
        )
        .orderBy(F.desc("total_spend"), PERSON)
    )


QUERIES = {
    "cq01_orders_per_customer": orders_per_customer,
    "cq02_repeat_share": repeat_share,
    "cq03_order_frequency": order_frequency,
    "cq04_spend_summary": spend_summary,
    "cq05_top_customers": top_customers,
    "cq06_average_order_value": average_order_value,
    "cq07_category_diversity": category_diversity,
    "cq08_product_diversity": product_diversity,
    "cq09_review_behaviour": review_behaviour,
    "cq10_favourite_payment": favourite_payment,
    "cq11_geography": geography,
    "cq12_monthly_activity": monthly_activity,
    "cq13_order_intervals": order_intervals,
    "cq14_interval_statistics": interval_statistics,
    "cq15_lifetime_summary": lifetime_summary,
    "cq16_spend_deciles": spend_deciles,
    "cq17_revenue_concentration": revenue_concentration,
    "cq18_scorecard": scorecard,
}
