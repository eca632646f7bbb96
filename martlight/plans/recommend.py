"""Recommendation analyses rq01-rq15."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlight.functions.columns import days_between, money
from martlight.operators.ordering import ordered_prefix, rank_first, top_k, top_n_per, ts_quantile
from martlight.operators.pairs import baskets, nth_unseen, top_pairs
from martlight.plans.facts import order_products, person_orders
from martlight.plans.product import categories
from martlight.session import stable
from martlight.sources.tables import Marketplace

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"


def _popularity(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Per product: item rows, orders, accounts and revenue."""
    return (
        lines.join(orders, "order_id")
        .groupBy("product_id")
        .agg(
            F.sum("item_count").alias("purchase_count"),
            F.count(F.lit(1)).alias("order_count"),
            F.countDistinct("customer_id").alias("customer_count"),
            F.sum("revenue").alias("revenue"),
        )
    )


def product_popularity(t: Marketplace, limit: int = 100) -> DataFrame:
    """rq01: counts accounts, not persons."""
    popular = _popularity(order_products(t.order_items), t.orders.select("order_id", "customer_id"))
    return top_k(popular, [F.desc("purchase_count"), F.col("product_id")], limit).withColumn(
        "revenue", money("revenue")
    )


def category_popularity(t: Marketplace) -> DataFrame:
    """rq02"""
    popular = _popularity(order_products(t.order_items), t.orders.select("order_id", "customer_id"))
    return (
        popular.join(categories(t), "product_id")
        .select("category", "product_id", "purchase_count", "customer_count")
        .orderBy("category", F.desc("purchase_count"), "product_id")
    )


def person_product_purchases(t: Marketplace) -> DataFrame:
    """Per (person, product): item rows, orders, first and last purchase, spend."""
    return (
        person_orders(t, TS)
        .join(order_products(t.order_items), "order_id")
        .groupBy(PERSON, "product_id")
        .agg(
            F.sum("item_count").alias("purchase_count"),
            F.count(F.lit(1)).alias("order_count"),
            F.min(TS).alias("first_purchase"),
            F.max(TS).alias("last_purchase"),
            F.sum("revenue").alias("product_spend"),
        )
    )


def interactions(t: Marketplace) -> DataFrame:
    """rq03"""
    return person_product_purchases(t).withColumn("product_spend", money("product_spend"))


def interaction_recency(t: Marketplace) -> DataFrame:
    """rq04"""
    end = t.orders.agg(F.max(TS)).scalar()
    return (
        person_product_purchases(t)
        .select(
            PERSON,
            "product_id",
            "purchase_count",
            "last_purchase",
            days_between(end, "last_purchase").alias("days_since_last_purchase"),
        )
        .orderBy(PERSON, F.desc("last_purchase"), "product_id")
    )


def _person_categories(t: Marketplace) -> DataFrame:
    return (
        person_product_purchases(t)
        .join(categories(t), "product_id")
        .groupBy(PERSON, "category")
        .agg(F.sum("purchase_count").alias("purchase_count"), F.sum("product_spend").alias("category_spend"))
    )


def category_preferences(t: Marketplace) -> DataFrame:
    """rq05"""
    return (
        _person_categories(t)
        .withColumn("category_spend", money("category_spend"))
        .orderBy(PERSON, F.desc("purchase_count"), "category")
    )


def preferred_categories(t: Marketplace, n: int = 5) -> DataFrame:
    """rq06"""
    order = [F.desc("purchase_count"), F.desc("category_spend"), F.col("category")]
    top = top_n_per(_person_categories(t), [PERSON], order, n, "category_rank")
    return top.orderBy(PERSON, "category_rank").select(
        PERSON, "category", "purchase_count", money("category_spend").alias("category_spend")
    )


def co_purchases(t: Marketplace, limit: int = 100) -> DataFrame:
    """rq07"""
    return top_pairs(stable(baskets(t.order_items)), limit).select("product_a", "product_b", "co_purchase_orders")


def co_purchases_with_categories(t: Marketplace, limit: int = 100) -> DataFrame:
    """rq08: items of unknown products are left out before ranking, as the joins would."""
    known = t.order_items.join(t.products.select("product_id"), "product_id", "left_semi")
    top = top_pairs(stable(baskets(known)), limit)
    names = t.products.select("product_id", "product_category_name")
    first = names.toDF("product_a", "product_a_category")
    second = names.toDF("product_b", "product_b_category")
    return (
        top.join(first, "product_a")
        .join(second, "product_b")
        .select("product_a", "product_a_category", "product_b", "product_b_category", "co_purchase_orders")
        .orderBy(F.desc("co_purchase_orders"), "product_a", "product_b")
    )


def purchase_history(t: Marketplace) -> DataFrame:
    """rq09"""
    items = t.order_items.select("order_id", "product_id", "price", "freight_value")
    return (
        person_orders(t, TS)
        .join(items, "order_id")
        .join(t.products.select("product_id", "product_category_name"), "product_id")
        .select(
            PERSON,
            "order_id",
            TS,
            "product_id",
            "product_category_name",
            F.col("price").cast("double").alias("price"),
            F.col("freight_value").cast("double").alias("freight_value"),
        )
        .orderBy(PERSON, F.desc(TS), "order_id", "product_id")
    )


def unpurchased_candidates(t: Marketplace, limit: int = 1000) -> DataFrame:
    """rq10: the first ``limit`` (person, product) combinations without a purchase, by ids.

    Each person's share of the list is known from counts alone; the products are
    then looked up by place, so the persons x products table is never built.
    """
    catalogue = t.products.select("product_id")
    bought = person_product_purchases(t).select(PERSON, "product_id").join(catalogue, "product_id", "left_semi")
    size = catalogue.agg(F.count(F.lit(1))).scalar()
    counts = bought.groupBy(PERSON).agg(F.count(F.lit(1)).alias("seen"))
    persons = (
        t.customers.select(PERSON)
        .distinct()
        .join(counts, PERSON, "left")
        .select(PERSON, (size - F.coalesce("seen", F.lit(0))).alias("unseen"))
    )
    # Every person listed adds at least one row, so the first ``limit`` of them are enough.
    persons = top_k(persons.where("unseen > 0"), [F.col(PERSON)], limit)
    before = F.col("running_unseen") - F.col("unseen")
    take = F.least(F.col("unseen"), F.lit(limit) - before)
    shares = ordered_prefix(persons, [F.col(PERSON)], ["unseen"]).where(before < limit)
    wanted = shares.select(PERSON, F.explode(F.sequence(F.lit(1).cast("long"), take)).alias("slot"))
    ranking = rank_first(catalogue, [F.col("product_id")], "place")
    history = bought.join(shares.select(PERSON), PERSON, "left_semi")
    return nth_unseen(wanted, history, ranking, [PERSON], "product_id").select(PERSON, "product_id")


def order_cutoff(t: Marketplace, p: float = 0.8) -> DataFrame:
    """80th percentile of purchase time over orders (fq02)."""
    return ts_quantile(t.orders, TS, p)


def split_counts(t: Marketplace) -> DataFrame:
    """rq11: ``item_interactions`` counts orders, items are not joined."""
    split = F.when(F.col(TS) <= order_cutoff(t).scalar(), "train").otherwise("test")
    return (
        t.orders.select("customer_id", split.alias("split"))
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.countDistinct("customer_id").alias("customers"),
            F.count(F.lit(1)).alias("item_interactions"),
        )
        .orderBy("split")
    )


def _strength(t: Marketplace, future: bool, out: str) -> DataFrame:
    cutoff = order_cutoff(t).scalar()
    orders = person_orders(t, TS).where(F.col(TS) > cutoff if future else F.col(TS) <= cutoff)
    return (
        orders.join(order_products(t.order_items), "order_id")
        .groupBy(PERSON, "product_id")
        .agg(F.sum("item_count").alias(out))
    )


def training_interactions(t: Marketplace) -> DataFrame:
    """rq12"""
    return _strength(t, False, "interaction_strength")


def future_interactions(t: Marketplace) -> DataFrame:
    """rq13"""
    return _strength(t, True, "future_interaction_strength")


def training_popularity(t: Marketplace, limit: int = 100) -> DataFrame:
    """rq14"""
    orders = t.orders.where(F.col(TS) <= order_cutoff(t).scalar()).select("order_id", "customer_id")
    popular = _popularity(order_products(t.order_items), orders)
    return top_k(popular, [F.desc("purchase_count"), F.col("product_id")], limit).select(
        "product_id",
        F.col("purchase_count").alias("training_purchase_count"),
        F.col("customer_count").alias("training_customer_count"),
        money("revenue").alias("training_revenue"),
    )


def pair_jaccard(t: Marketplace, limit: int = 100) -> DataFrame:
    """rq15: ranked by the unrounded similarity."""
    top = top_pairs(stable(baskets(t.order_items)), limit, "similarity")
    return top.select(
        "product_a",
        "product_b",
        "co_purchase_orders",
        "product_a_orders",
        "product_b_orders",
        F.round("similarity", 4).alias("jaccard_similarity"),
    )


QUERIES = {
    "rq01_product_popularity": product_popularity,
    "rq02_category_popularity": category_popularity,
    "rq03_interactions": interactions,
    "rq04_interaction_recency": interaction_recency,
    "rq05_category_preferences": category_preferences,
    "rq06_preferred_categories": preferred_categories,
    "rq07_co_purchases": co_purchases,
    "rq08_co_purchases_with_categories": co_purchases_with_categories,
    "rq09_purchase_history": purchase_history,
    "rq10_unpurchased_candidates": unpurchased_candidates,
    "rq11_split_counts": split_counts,
    "rq12_training_interactions": training_interactions,
    "rq13_future_interactions": future_interactions,
    "rq14_training_popularity": training_popularity,
    "rq15_pair_jaccard": pair_jaccard,
}
