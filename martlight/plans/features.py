"""Customer features: order level, one row per person, recency/frequency/monetary scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlight.functions.columns import (
    count_where,
    days_between,
    micros_between,
    rule_case,
    safe_ratio,
    to_number,
)
from martlight.operators.ordering import bin_of_rank, column_ranks, grouped_quantile
from martlight.plans.facts import person_orders
from martlight.session import stable
from martlight.sources.tables import Marketplace, write_table

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"
DELIVERED = "order_delivered_customer_date"
ESTIMATE = "order_estimated_delivery_date"
MICROS_PER_DAY = 86400e6

NUMERIC = [
    "product_revenue",
    "freight_revenue",
    "item_count",
    "unique_products",
    "average_review_score",
    "review_count",
    "negative_review_count",
    "payment_value",
    "payment_record_count",
    "payment_type_count",
]


def order_base(t: Marketplace) -> DataFrame:
    """Orders of every status with the person who placed them."""
    return person_orders(t, "order_status", TS, DELIVERED, ESTIMATE)


def order_aggregates(t: Marketplace) -> list[DataFrame]:
    """Items, reviews and payments, each one row per order."""
    items = t.order_items.groupBy("order_id").agg(
        F.sum("price").alias("product_revenue"),
        F.sum("freight_value").alias("freight_revenue"),
        F.count(F.lit(1)).alias("item_count"),
        F.countDistinct("product_id").alias("unique_products"),
    )
    score = F.col("review_score")
    reviews = t.order_reviews.groupBy("order_id").agg(
        F.avg(score).alias("average_review_score"),
        F.count("review_id").alias("review_count"),
        count_where(score <= 2).alias("negative_review_count"),
    )
    payments = t.order_payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_value"),
        F.count(F.lit(1)).alias("payment_record_count"),
        F.countDistinct("payment_type").alias("payment_type_count"),
    )
    return [items, reviews, payments]


def order_level(t: Marketplace) -> DataFrame:
    """One row per order with its item, review and payment sums; missing parts count as 0."""
    joined = reduce(lambda df, part: df.join(part, "order_id", "left"), order_aggregates(t), order_base(t))
    return joined.fillna(0, NUMERIC)


def _coerced(df: DataFrame) -> DataFrame:
    """Text dates and numbers are parsed; what does not parse is null, then 0 for numbers."""
    types = dict(df.dtypes)
    dates = {
        c: F.col(c).try_cast("timestamp_ntz") for c in (TS, DELIVERED, ESTIMATE) if types[c] != "timestamp_ntz"
    }
    numbers = {c: to_number(c) for c in NUMERIC if types[c] in ("string", "double", "float", "void")}
    return df.withColumns({**dates, **numbers}).fillna(0, NUMERIC)


def observation_date(df: DataFrame):
    """Latest purchase over all orders."""
    latest = df.agg(F.max(TS)).head()[0]
    if latest is None:
        # fixed value: wording that callers match
        raise ValueError("No valid order_purchase_timestamp values were found.")
    return latest


def _delivery_micros(orders: DataFrame) -> DataFrame:
    """Orders with transit time and lateness in microseconds, null unless delivered and dated."""
    done = F.col(DELIVERED).isNotNull() & F.col(TS).isNotNull()
    return orders.withColumns(
        {
            "transit": F.when(done, micros_between(DELIVERED, TS)),
            "lateness": F.when(done, micros_between(DELIVERED, ESTIMATE)),
        }
    )


def median_delivery(orders: DataFrame) -> DataFrame:
    """Exact median transit days per person with a delivered order."""
    median = grouped_quantile(_delivery_micros(orders).select(PERSON, "transit"), [PERSON], "transit", 0.5, "m")
    return median.select(PERSON, (F.col("m") / F.lit(MICROS_PER_DAY)).alias("median_delivery_days"))


def _order_sums(orders: DataFrame) -> DataFrame:
    """One row per (person, order), so that orders are counted without a distinct pass."""
    score = F.when(F.col("average_review_score") > 0, F.col("average_review_score"))
    sums = [F.sum(c).alias(c) for c in NUMERIC if c != "average_review_score"]
    return _delivery_micros(orders).groupBy(PERSON, "order_id").agg(
        *sums,
        F.count(F.lit(1)).alias("order_rows"),
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
        F.sum(score).alias("score_sum"),
        F.count(score).alias("score_count"),
        F.sum(F.col("transit").cast("decimal(20,0)")).alias("transit"),
        F.count("transit").alias("transit_count"),
        F.sum(F.col("lateness").cast("decimal(20,0)")).alias("lateness"),
        F.count("lateness").alias("lateness_count"),
        count_where(F.col("lateness") > 0).alias("late"),
    )


def customer_features(orders: DataFrame) -> DataFrame:
    """One row per person from an order-level table (36 columns)."""
    orders = _coerced(orders)
    observed = F.lit(observation_date(orders)).cast("timestamp_ntz")

    def total(column: str, out: str) -> Column:
        return F.sum(column).alias(out)

    def money(column: Column, out: str) -> Column:
        return F.sum(column).cast("double").alias(out)

    def mean_days(column: str, out: str) -> Column:
        mean = F.sum(column).cast("double") / F.nullif(F.sum(f"{column}_count"), F.lit(0).cast("long"))
        return F.coalesce(mean / F.lit(MICROS_PER_DAY), F.lit(0.0)).alias(out)

    product, freight = F.col("product_revenue"), F.col("freight_revenue")
    base = (
        _order_sums(orders)
        .groupBy(PERSON)
        .agg(
            F.count("order_id").alias("order_count"),
            money(product + freight, "total_revenue"),
            money(product, "total_product_revenue"),
            money(freight, "total_freight_revenue"),
            total("item_count", "total_items"),
            total("unique_products", "unique_products_purchased"),
            total("order_rows", "order_rows"),
            F.min("first_ts").alias("first_purchase_date"),
            F.max("last_ts").alias("last_purchase_date"),
            safe_ratio(F.sum("score_sum"), F.sum("score_count")).alias("average_review_score"),
            total("review_count", "total_reviews"),
            total("negative_review_count", "negative_review_count"),
            money(F.col("payment_value"), "total_payment_value"),
            total("payment_record_count", "payment_record_count"),
            total("payment_type_count", "payment_type_count"),
            mean_days("transit", "average_delivery_days"),
            mean_days("lateness", "average_delivery_vs_estimate_days"),
            total("late", "late_delivery_order_count"),
            count_where(F.col("transit_count") > 0).alias("delivered_order_count"),
        )
    )
    age = F.greatest(days_between("last_purchase_date", "first_purchase_date"), F.lit(0.0))
    base = (
        base.withColumns(
            {
                "average_order_value": F.col("total_revenue") / F.col("order_rows"),
                "recency_days": days_between(observed, "last_purchase_date"),
                "customer_age_days": age,
                "average_items_per_order": safe_ratio("total_items", "order_count"),
                "average_freight_per_order": safe_ratio("total_freight_revenue", "order_count"),
                "revenue_per_item": safe_ratio("total_product_revenue", "total_items"),
                "is_repeat_customer": (F.col("order_count") > 1).cast("int"),
                "negative_review_rate": safe_ratio("negative_review_count", "total_reviews"),
            }
        )
        .withColumn("orders_per_active_day", safe_ratio("order_count", "customer_age_days"))
        .drop("order_rows")
        .join(median_delivery(orders), PERSON, "left")
        .fillna(0, ["median_delivery_days"])
    )
    return rfm_scores(stable(base))


def rfm_scores(base: DataFrame) -> DataFrame:
    """Percentiles, quintile scores and the rule segment.

    The three ranked columns share one ordering pass over (column, value, person).
    """
    ranks = column_ranks(base, PERSON, ["recency_days", "order_count", "total_revenue"])

    def percentile(column: str) -> Column:
        return F.col(f"average_{column}") / F.col(f"size_{column}")

    def quintile(column: str) -> Column:
        return bin_of_rank(f"first_{column}", f"size_{column}", 5)

    scores = ranks.select(
        PERSON,
        percentile("total_revenue").alias("spend_percentile"),
        percentile("recency_days").alias("recency_percentile"),
        (5 - quintile("recency_days")).alias("recency_score"),
        (quintile("order_count") + 1).alias("frequency_score"),
        (quintile("total_revenue") + 1).alias("monetary_score"),
    )
    total = F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")
    scored = base.join(scores, PERSON).withColumn("rfm_score", total)
    return scored.withColumn("customer_segment", rfm_segment())


def rfm_segment() -> Column:
    """First rule that holds."""
    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    return rule_case(
        [
            ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
            ((r >= 4) & (f >= 3), "Loyal Active"),
            ((r <= 2) & (m >= 4), "At Risk High Value"),
            ((f >= 4) & (m >= 4), "High Value"),
        ],
        "Needs Attention",
    )


def export_features(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Written in order of business value."""
    ordered = features.orderBy(F.desc("total_revenue"), F.desc("order_count"), PERSON)
    write_table(ordered, path, fmt)


# ---- registered queries -----------------------------------------------------

MONEY = ["product_revenue", "freight_revenue", "payment_value"]


def order_level_table(t: Marketplace) -> DataFrame:
    """fq01"""
    return order_level(t).withColumns({c: F.col(c).cast("double") for c in MONEY})


def features_table(t: Marketplace) -> DataFrame:
    """k1"""
    return customer_features(order_level(t))



QUERIES = {"fq01_order_level": order_level_table, "k1_customer_features": features_table}
