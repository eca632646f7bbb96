"""The reusable column and table operators, each run over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlight.functions.columns import (
    as_json,
    avg_positive,
    clip_zero,
    count_where,
    days_between,
    exact_ratio,
    label_map,
    money,
    month_of,
    parse_timestamp,
    rule_case,
    safe_ratio,
    to_number,
)
from martlight.operators.checks import (
    crosstab_pct,
    duplicate_rows,
    histogram,
    key_common,
    key_diff,
    share_of_total,
    value_counts_fixed,
)
from martlight.operators.impute import impute_median
from martlight.operators.ordering import (
    arg_max,
    exact_quantiles,
    grouped_quantile,
    ntile_global,
    pct_rank_avg,
    quantile_bin,
    rank_first,
    running_sum,
    top_k,
    ts_quantile,
)
from martlight.plans.facts import customer_spend, person_orders
from martlight.plans.recommender import history_sets
from martlight.plans.report import prompt_text
from martlight.session import stable
from martlight.sources.tables import Marketplace, sql_source

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"
DELIVERED = "order_delivered_customer_date"
STATES = ["delivered", "shipped", "processing", "canceled", "unavailable"]


def sql_over_views(t: Marketplace) -> DataFrame:
    """a3: a query over the registered tables."""
    t.register()
    return sql_source(
        t.orders.sparkSession,
        "SELECT order_status, count(*) AS orders FROM orders GROUP BY order_status HAVING count(*) > 1",
    )


def parameterised_sql(t: Marketplace) -> DataFrame:
    """a4: the cutoff is bound as a parameter."""
    t.register()
    cutoff = ts_quantile(t.orders, TS, 0.8).head()[0]
    return sql_source(
        t.orders.sparkSession,
        "SELECT order_status, count(*) AS orders FROM orders "
        "WHERE order_purchase_timestamp <= CAST(:cutoff AS timestamp_ntz) GROUP BY order_status",
        cutoff=cutoff,
    )


def predicates(t: Marketplace) -> DataFrame:
    """b3-b6: comparisons, null tests, lists, ranges and labels."""
    score, status = F.col("review_score"), F.col("order_status")
    rated = t.order_reviews.join(t.orders.select("order_id", "order_status", "order_approved_at"), "order_id")
    tone = F.when(score <= 2, "negative").when(score >= 4, "positive").otherwise("neutral")
    return (
        rated.where(~status.isin("canceled", "unavailable") & F.col("order_approved_at").isNotNull())
        .groupBy(tone.alias("tone"))
        .agg(count_where(~score.between(2, 4)).alias("extreme"), F.count(F.lit(1)).alias("reviews"))
    )


def price_labels(t: Marketplace) -> DataFrame:
    """b7"""
    price = F.col("price")
    label = rule_case([(price >= 50_000, "premium"), (price >= 20_000, "standard")], "budget")
    return t.order_items.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("items"))


def guarded_ratios(t: Marketplace) -> DataFrame:
    """b2, b9: arithmetic and ratios that survive a 0 denominator."""
    freight, price = F.col("freight_value"), F.col("price")
    return t.order_items.groupBy("seller_id").agg(
        money(F.sum(price + freight)).alias("gross"),
        safe_ratio(F.sum(price), F.sum(freight)).alias("price_per_freight"),
        exact_ratio(F.sum(freight), count_where(freight > 0), 4).alias("paid_freight"),
    )


def coerced(t: Marketplace) -> DataFrame:
    """b10-b12: unreadable numbers and dates become null and are counted."""
    kind = F.col("payment_type")
    text = F.when(kind == "voucher", "n/a").otherwise(F.col("payment_value").cast("string"))
    stamp = F.when(kind == "boleto", "unknown").otherwise("2020-01-31 10:00:00")
    rows = t.order_payments.select(to_number(text).alias("value"), parse_timestamp(stamp).alias("at"))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("numbers"),
        F.count("at").alias("dates"),
        F.round(F.sum("value"), 2).alias("total"),
    )


def imputed(t: Marketplace) -> DataFrame:
    """b13"""
    photos = t.products.select("product_id", F.col("product_photos_qty").cast("double").alias("photos"))
    return impute_median(photos, ["photos"])


def clipped(t: Marketplace) -> DataFrame:
    """b14, h6"""
    late = days_between(DELIVERED, "order_estimated_delivery_date")
    return t.orders.where(F.col(DELIVERED).isNotNull()).select(
        "order_id", clip_zero(late).alias("days_late"), F.abs(late).alias("days_off"), F.sqrt(F.abs(late)).alias("root")
    )


def labelled(t: Marketplace) -> DataFrame:
    """b15"""
    names = {"credit_card": "Card", "boleto": "Slip"}
    label = label_map("payment_type", names, "Other")
    return t.order_payments.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("payments"))


def above_quantile(t: Marketplace) -> DataFrame:
    """b16: a one-row result as filter."""
    cut = exact_quantiles(t.order_items, "price", {"p": 0.9}).scalar()
    return t.order_items.where(F.col("price") >= cut).agg(
        F.count(F.lit(1)).alias("items"), money(F.sum("price")).alias("revenue")
    )


def key_sets(t: Marketplace) -> DataFrame:
    """c11, c12, g3: persons who bought before and after the cutoff, and only before it."""
    cutoff = ts_quantile(t.orders, TS, 0.8).scalar()
    orders = person_orders(t, TS)
    early, late = orders.where(F.col(TS) <= cutoff), orders.where(F.col(TS) > cutoff)
    both = key_common(early, late, PERSON).agg(F.count(F.lit(1)).alias("both_periods"))
    only = key_diff(early, late, PERSON).agg(F.count(F.lit(1)))
    return both.withColumn("only_early", only.scalar())


def positive_means(t: Marketplace) -> DataFrame:
    """d11: means of positive values only."""
    lateness = F.floor(days_between(DELIVERED, "order_estimated_delivery_date"))
    rows = t.orders.select("order_status", lateness.cast("double").alias("lateness"))
    return rows.groupBy("order_status").agg(avg_positive("lateness").alias("mean_positive_lateness"))


def state_medians(t: Marketplace) -> DataFrame:
    """d12: exact median per group without a per-group task."""
    orders = person_orders(t, "customer_state").join(t.order_items.select("order_id", "price"), "order_id")
    return grouped_quantile(orders, ["customer_state"], "price", 0.5, "m").select(
        "customer_state", F.round("m", 4).cast("double").alias("median_price")
    )


def repeated_lines(t: Marketplace) -> DataFrame:
    """d17"""
    return duplicate_rows(t.order_items.select("order_id", "product_id"))


def status_counts(t: Marketplace) -> DataFrame:
    """d20: fixed levels, absent ones with 0."""
    return value_counts_fixed(t.orders, "order_status", [*STATES, "invoiced"])


def status_by_state(t: Marketplace) -> DataFrame:
    """d21"""
    return crosstab_pct(person_orders(t, "customer_state", "order_status"), "customer_state", "order_status", STATES)


def freight_histogram(t: Marketplace) -> DataFrame:
    """d22"""
    return histogram(t.order_items, "freight_value", 25).withColumn("bin_start", F.round("bin_start", 6))


def product_sellers(t: Marketplace) -> DataFrame:
    """d23, h9: sets as arrays, here as text."""
    sets = history_sets(t.order_items, "seller_id", "order_item_id")
    return sets.select(
        "seller_id",
        F.array_join(F.col("items").cast("array<string>"), ",").alias("line_numbers"),
        F.array_contains("items", 7).alias("has_line_7"),
    )


def _spend(t: Marketplace) -> DataFrame:
    return stable(customer_spend(t).select(PERSON, F.col("total_spend").cast("double").alias("spend"), "order_count"))


def spend_tiles(t: Marketplace) -> DataFrame:
    """e4"""
    return ntile_global(_spend(t), [F.desc("spend"), F.col(PERSON)], 7, "tile").select(PERSON, "tile")


def running_orders(t: Marketplace) -> DataFrame:
    """e5"""
    return running_sum(_spend(t), [F.col("spend"), F.col(PERSON)], "order_count").select(
        PERSON, "running_order_count", "total_order_count"
    )


def tied_percentiles(t: Marketplace) -> DataFrame:
    """e8"""
    return pct_rank_avg(_spend(t), PERSON, "order_count", "pct").select(PERSON, "order_count", "pct")


def first_ranks(t: Marketplace) -> DataFrame:
    """e9"""
    return rank_first(_spend(t), [F.desc("order_count"), F.col(PERSON)], "rank").select(PERSON, "rank")


def order_bins(t: Marketplace) -> DataFrame:
    """e10"""
    bins = quantile_bin(_spend(t), [F.col("order_count"), F.col(PERSON)], 5, "bin")
    return bins.select(PERSON, "bin")


def far_off_deliveries(t: Marketplace, k: int = 25) -> DataFrame:
    """f5: largest by absolute value."""
    return top_k(clipped(t).select("order_id", "days_off"), [F.desc("days_off"), F.col("order_id")], k)


def best_seller(t: Marketplace) -> DataFrame:
    """f6"""
    revenue = t.order_items.groupBy("seller_id").agg(F.sum("price").alias("revenue"))
    return arg_max(revenue, "revenue", "seller_id")


def state_shares(t: Marketplace) -> DataFrame:
    """d9, e6, e7"""
    counts = t.customers.groupBy("customer_state").agg(F.count(F.lit(1)).alias("accounts"))
    return share_of_total(counts, "accounts", "share_pct")


def scalars(t: Marketplace) -> DataFrame:
    """h1-h8, h10: dates, rounding, logarithms, text and JSON per order."""
    status = F.lower(F.upper("order_status"))
    micro = F.expm1(F.log1p((F.col("order_id") % 100).cast("double")))
    return t.orders.select(
        "order_id",
        month_of(TS).alias("month"),
        F.round(micro, 6).alias("round_trip"),
        status.startswith("s").alias("starts_s"),
        status.endswith("d").alias("ends_d"),
        as_json(F.col("order_id").alias("id"), F.col("order_status").alias("state")).alias("json"),
        prompt_text("order %s", F.col("order_id").cast("string")).alias("text"),
    )


QUERIES = {
    "a3_sql_over_views": sql_over_views,
    "a4_parameterised_sql": parameterised_sql,
    "b3_predicates": predicates,
    "b7_rule_labels": price_labels,
    "b9_guarded_ratios": guarded_ratios,
    "b11_coercion": coerced,
    "b13_median_imputation": imputed,
    "b14_clipping": clipped,
    "b15_label_map": labelled,
    "b16_scalar_filter": above_quantile,
    "c11_key_sets": key_sets,
    "d09_share_of_total": state_shares,
    "d11_positive_means": positive_means,
    "d12_group_medians": state_medians,
    "d17_repeated_lines": repeated_lines,
    "d20_fixed_levels": status_counts,
    "d21_crosstab": status_by_state,
    "d22_histogram": freight_histogram,
    "d23_sets": product_sellers,
    "e04_ntile": spend_tiles,
    "e05_running_sum": running_orders,
    "e08_average_rank_percentile": tied_percentiles,
    "e09_first_rank": first_ranks,
    "e10_quantile_bins": order_bins,
    "f05_top_by_size": far_off_deliveries,
    "f06_arg_max": best_seller,
    "h01_scalars": scalars,
}
