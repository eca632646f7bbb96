"""Data-quality analyses dq01-dq16 and the load-time checks vq01-vq07."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlight.functions.columns import count_where, parse_timestamp, share_ratio
from martlight.operators.checks import (
    duplicate_keys,
    duplicate_rows,
    key_report,
    label_union,
    missing_parent_keys,
    orphan_count,
    profile_nulls,
    row_count,
    value_counts,
)
from martlight.session import shared_folder
from martlight.sources.schema import KEYS, RELATIONS
from martlight.sources.tables import Marketplace, reload_report

# fixed values: timestamp columns per table that the load checks parse
TIMESTAMP_COLUMNS = {
    "orders": [
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ],
    "order_items": ["shipping_limit_date"],
    "order_reviews": ["review_creation_date", "review_answer_timestamp"],
}

# fixed values: columns whose domains are listed
DOMAIN_COLUMNS = [
    ("orders", "order_status"),
    ("order_payments", "payment_type"),
    ("order_reviews", "review_score"),
    ("customers", "customer_state"),
    ("sellers", "seller_state"),
]

IDENTIFIERS = [
    ("customers", "customer_id"),
    ("orders", "order_id"),
    ("orders", "customer_id"),
    ("order_items", "order_id"),
    ("order_items", "product_id"),
    ("order_items", "seller_id"),
    ("products", "product_id"),
    ("sellers", "seller_id"),
]


def table_counts(t: Marketplace) -> DataFrame:
    """dq01"""
    counts = {name: row_count(df) for name, df in t.items().items()}
    return label_union(counts, "table_name", "row_count").orderBy("table_name")


def null_identifiers(t: Marketplace) -> DataFrame:
    """dq02: one pass per table, however many of its columns are checked."""
    tables = t.items()
    reports = []
    for name in dict.fromkeys(table for table, _ in IDENTIFIERS):
        columns = [column for table, column in IDENTIFIERS if table == name]
        nulls = tables[name].agg(*[count_where(F.col(c).isNull()).alias(f"{name}.{c}") for c in columns])
        reports.append(nulls.unpivot([], [f"`{c}`" for c in nulls.columns], "column_name", "null_count"))
    return reduce(DataFrame.unionByName, reports).orderBy("column_name")


def duplicates_of(table: str, t: Marketplace) -> DataFrame:
    """dq03"""
    keys = KEYS[table]
    return duplicate_keys(t.items()[table], keys).orderBy(F.desc("duplicate_count"), *keys)


def orphans_of(relation: tuple, t: Marketplace) -> DataFrame:
    """dq04"""
    name, child, key, parent, parent_key = relation
    tables = t.items()
    return orphan_count(tables[child], key, tables[parent], parent_key, name)


def status_distribution(t: Marketplace) -> DataFrame:
    """dq05, eq02"""
    counts = t.orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("order_count"))
    total = F.sum("order_count").over(Window.partitionBy())
    return counts.withColumn("percentage", share_ratio("order_count", total)).orderBy(
        F.desc("order_count"), "order_status"
    )


def review_scores(t: Marketplace) -> DataFrame:
    """dq06"""
    score = F.col("review_score")
    return t.order_reviews.agg(
        F.min(score).alias("minimum_score"),
        F.max(score).alias("maximum_score"),
        count_where(score.isNull()).alias("null_scores"),
        count_where(~score.between(1, 5)).alias("invalid_scores"),
    )


def payment_values(t: Marketplace) -> DataFrame:
    """dq07"""
    value = F.col("payment_value")
    return t.order_payments.agg(
        F.count(F.lit(1)).alias("payment_rows"),
        count_where(value.isNull()).alias("null_payment_values"),
        count_where(value < 0).alias("negative_payment_values"),
        F.min(value).cast("double").alias("minimum_payment_value"),
        F.max(value).cast("double").alias("maximum_payment_value"),
        (F.sum(value).cast("double") / F.count(value)).alias("average_payment_value"),
    )


def item_values(t: Marketplace) -> DataFrame:
    """dq08"""
    price, freight = F.col("price"), F.col("freight_value")
    return t.order_items.agg(
        F.count(F.lit(1)).alias("item_rows"),
        count_where(price.isNull()).alias("null_prices"),
        count_where(price < 0).alias("negative_prices"),
        count_where(freight.isNull()).alias("null_freight_values"),
        count_where(freight < 0).alias("negative_freight_values"),
        F.min(price).cast("double").alias("minimum_price"),
        F.max(price).cast("double").alias("maximum_price"),
        F.min(freight).cast("double").alias("minimum_freight"),
        F.max(freight).cast("double").alias("maximum_freight"),
    )


def product_dimensions(t: Marketplace) -> DataFrame:
    """dq09"""
    return t.products.agg(
        F.count(F.lit(1)).alias("product_rows"),
        count_where(F.col("product_category_name").isNull()).alias("missing_category"),
        count_where(F.col("product_weight_g") < 0).alias("negative_weight"),
        count_where(F.col("product_length_cm") < 0).alias("negative_length"),
        count_where(F.col("product_height_cm") < 0).alias("negative_height"),
        count_where(F.col("product_width_cm") < 0).alias("negative_width"),
    )


def purchase_range(t: Marketplace) -> DataFrame:
    """dq10"""
    ts = F.col("order_purchase_timestamp")
    return t.orders.agg(
        F.min(ts).alias("first_order_purchase"),
        F.max(ts).alias("last_order_purchase"),
        count_where(ts.isNull()).alias("missing_purchase_timestamp"),
    )


def delivery_order(t: Marketplace) -> DataFrame:
    """dq11"""
    delivered = F.col("order_delivered_customer_date")
    return t.orders.where(delivered.isNotNull()).agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        count_where(delivered < F.col("order_purchase_timestamp")).alias("delivered_before_purchase"),
        count_where(delivered < F.col("order_approved_at")).alias("delivered_before_approval"),
        count_where(delivered < F.col("order_delivered_carrier_date")).alias("delivered_before_carrier"),
    )


def estimate_order(t: Marketplace) -> DataFrame:
    """dq12"""
    estimate = F.col("order_estimated_delivery_date")
    return t.orders.where(estimate.isNotNull()).agg(
        F.count(F.lit(1)).alias("orders_with_estimate"),
        count_where(estimate < F.col("order_purchase_timestamp")).alias("estimate_before_purchase"),
    )


def zip_multiplicity(t: Marketplace) -> DataFrame:
    """dq13"""
    zips = duplicate_keys(t.geolocation, ["geolocation_zip_code_prefix"], "records_per_zip_prefix")
    return zips.orderBy(F.desc("records_per_zip_prefix"), "geolocation_zip_code_prefix").limit(20)


def translation_coverage(t: Marketplace) -> DataFrame:
    """dq14"""
    return t.category_translation.agg(
        F.count(F.lit(1)).alias("translation_rows"),
        count_where(F.col("product_category_name").isNull()).alias("null_category_names"),
        count_where(F.col("product_category_name_english").isNull()).alias("missing_english_translation"),
    )


def untranslated_categories(t: Marketplace) -> DataFrame:
    """dq15"""
    named = t.products.where(F.col("product_category_name").isNotNull())
    counts = named.groupBy("product_category_name").agg(F.count(F.lit(1)).alias("product_count"))
    known = t.category_translation.select("product_category_name")
    return counts.join(known, "product_category_name", "left_anti").orderBy(
        F.desc("product_count"), "product_category_name"
    )


def dashboard(t: Marketplace) -> DataFrame:
    """dq16: failures first."""
    checks = {relation[0]: orphans_of(relation, t) for relation in RELATIONS}
    checks["invalid_review_scores"] = t.order_reviews.agg(count_where(~F.col("review_score").between(1, 5)))
    checks["negative_payment_values"] = t.order_payments.agg(count_where(F.col("payment_value") < 0))
    checks["negative_product_prices"] = t.order_items.agg(count_where(F.col("price") < 0))
    passed = F.col("issue_count") == 0
    return (
        label_union(checks, "check_name", "issue_count")
        .withColumn("status", F.when(passed, "PASS").otherwise("REVIEW"))
        .orderBy(F.when(passed, 1).otherwise(0), "check_name")
    )


def schema_profile(t: Marketplace) -> DataFrame:
    """vq01"""
    reports = [profile_nulls(df).select(F.lit(name).alias("table_name"), "*") for name, df in t.items().items()]
    return reduce(DataFrame.unionByName, reports).orderBy("table_name", "column_name")


def row_duplicates(t: Marketplace) -> DataFrame:
    """vq02"""
    counts = {name: duplicate_rows(df) for name, df in t.items().items()}
    return label_union(counts, "table_name", "duplicate_rows").orderBy("table_name")


def key_uniqueness(t: Marketplace) -> DataFrame:
    """vq03"""
    tables = t.items()
    reports = [key_report(tables[n], k).select(F.lit(n).alias("table_name"), "*") for n, k in KEYS.items()]
    return reduce(DataFrame.unionByName, reports).orderBy("table_name")


def missing_parents(t: Marketplace) -> DataFrame:
    """vq04: distinct keys, where dq04 counts rows."""
    tables = t.items()
    counts = {
        f"{child}.{key} -> {parent}.{parent_key}": missing_parent_keys(tables[child], key, tables[parent], parent_key)
        for _, child, key, parent, parent_key in RELATIONS
    }
    return label_union(counts, "relationship", "missing_parent_keys").orderBy("relationship")


def timestamp_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Readable and unreadable timestamps per column of raw tables, whose columns may still be text."""
    reports = []
    for table, columns in TIMESTAMP_COLUMNS.items():
        packed = []
        for column in columns:
            text = F.col(column).cast("string")
            parsed = parse_timestamp(text)
            packed.append(
                F.struct(
                    F.count(parsed).alias("non_null"),
                    count_where(text.isNotNull() & parsed.isNull()).alias("invalid"),
                    F.min(parsed).alias("minimum"),
                    F.max(parsed).alias("maximum"),
                ).alias(column)
            )
        wide = tables[table].agg(*packed).unpivot([], columns, "column_name", "stats")
        reports.append(wide.select(F.lit(table).alias("table_name"), "column_name", "stats.*"))
    return reduce(DataFrame.unionByName, reports).orderBy("table_name", "column_name")


def as_raw_text(t: Marketplace) -> dict[str, DataFrame]:
    """The timestamps as a raw file might have them: text, and unreadable in rows of orders whose id ends in 7."""
    tables = t.items()
    mark = F.when(F.col("order_id").cast("string").endswith("7"), "?").otherwise("")
    return {
        table: tables[table].select(*(F.concat(mark, F.col(c).cast("string")).alias(c) for c in columns))
        for table, columns in TIMESTAMP_COLUMNS.items()
    }


def raw_timestamps(t: Marketplace) -> DataFrame:
    """vq05"""
    return timestamp_report(as_raw_text(t))


def domains(t: Marketplace) -> DataFrame:
    """vq06"""
    tables = t.items()
    reports = [
        value_counts(tables[table], column).select(
            F.lit(f"{table}.{column}").alias("column_name"), F.col("value"), F.col("count").alias("rows")
        )
        for table, column in DOMAIN_COLUMNS
    ]
    return reduce(DataFrame.unionByName, reports)


def load_reconciliation(t: Marketplace) -> DataFrame:
    """vq07: every table is written, read back and counted."""
    spark = t.orders.sparkSession
    return reload_report(t.items(), f"{shared_folder(spark)}/load-{uuid.uuid4().hex}").orderBy("table")


QUERIES = {
    "dq01_table_counts": table_counts,
    "dq02_null_identifiers": null_identifiers,
    **{f"dq03{c}_duplicate_{n}": partial(duplicates_of, n) for c, n in zip("abcdefg", KEYS)},
    **{f"dq04{c}_{r[0]}": partial(orphans_of, r) for c, r in zip("abcdef", RELATIONS)},
    "dq05_status_distribution": status_distribution,
    "dq06_review_scores": review_scores,
    "dq07_payment_values": payment_values,
    "dq08_item_values": item_values,
    "dq09_product_dimensions": product_dimensions,
    "dq10_purchase_range": purchase_range,
    "dq11_delivery_order": delivery_order,
    "dq12_estimate_order": estimate_order,
    "dq13_zip_multiplicity": zip_multiplicity,
    "dq14_translation_coverage": translation_coverage,
    "dq15_untranslated_categories": untranslated_categories,
    "dq16_dashboard": dashboard,
    "vq01_schema_profile": schema_profile,
    "vq02_row_duplicates": row_duplicates,
    "vq03_key_uniqueness": key_uniqueness,
    "vq04_missing_parents": missing_parents,
    "vq05_timestamp_report": raw_timestamps,
    "vq06_domains": domains,
    "vq07_load_reconciliation": load_reconciliation,
}
