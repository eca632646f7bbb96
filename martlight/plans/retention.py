"""Retention rules: thresholds, priority, action, strategy and opportunity score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlight.functions.columns import label_map, level_order, rule_case, to_number
from martlight.operators.checks import value_counts_fixed
from martlight.operators.ordering import column_ranks, quantiles_of
from martlight.plans.segments import rounded, with_rule_clusters
from martlight.plans.value import PREDICTED, modelling_set
from martlight.session import stable
from martlight.sources.tables import Marketplace, require_columns

PERSON = "customer_unique_id"
# fixed values: priorities and the columns of the retention table
PRIORITIES = ["Critical", "High", "Medium", "Low"]

FEATURE_COLUMNS = [
    "recency_days",
    "order_count",
    "total_revenue",
    "average_order_value",
    "total_items",
    "average_review_score",
    "negative_review_rate",
    "average_delivery_days",
    "average_delivery_vs_estimate_days",
    "rfm_score",
    "customer_segment",
]
NUMERIC = [PREDICTED, "recency_days", "order_count", "total_revenue", "average_review_score"]

# fixed values: action, reason and strategy texts
ACTIONS = {
    "Win-back campaign": "High predicted future value combined with long purchase inactivity.",
    "Service recovery outreach": "High predicted value but weak review performance.",
    "VIP loyalty offer": "High predicted value and strong purchase frequency.",
    "Cross-sell recommendation": (
        "Customer is recently active and is a good candidate for additional product recommendations."
    ),
    "First-to-second-purchase campaign": "Customer has limited purchase history and low predicted value.",
    "Low-cost engagement": "Predicted future value is relatively low, so retention spend should remain limited.",
    "Standard retention nurture": "Customer shows moderate value and engagement.",
}
STRATEGIES = {
    "Win-back campaign": (
        "Personalized reactivation message with a relevant product recommendation and time-limited incentive."
    ),
    "Service recovery outreach": (
        "Contact the customer, identify service friction, and offer recovery support before promotional selling."
    ),
    "VIP loyalty offer": (
        "Prioritize loyalty benefits, early access, bundles, or exclusive product recommendations."
    ),
    "Cross-sell recommendation": "Recommend complementary products based on purchase history.",
    "First-to-second-purchase campaign": (
        "Use a low-cost follow-up campaign focused on converting the first purchase into a repeat purchase."
    ),
    "Low-cost engagement": "Use inexpensive personalized content rather than high-cost incentives.",
    "Standard retention nurture": "Maintain relevant product recommendations and periodic customer engagement.",
}


def retention_base(features: DataFrame, clv: DataFrame, segments: DataFrame) -> DataFrame:
    """Features with prediction and segment, one row per person; missing numbers count as 0."""
    require_columns(features, [PERSON, *FEATURE_COLUMNS], "feature table")
    predicted = require_columns(clv, [PERSON, PREDICTED], "prediction table").select(PERSON, PREDICTED)
    grouped = require_columns(segments, [PERSON, "cluster_id", "segment"], "segment table")
    joined = (
        features.select(PERSON, *FEATURE_COLUMNS)
        .join(predicted, PERSON, "left")
        .join(grouped.select(PERSON, "cluster_id", "segment"), PERSON, "left")
    )
    return joined.withColumns({c: F.coalesce(to_number(c), F.lit(0.0)) for c in NUMERIC}).dropDuplicates([PERSON])


def retention_thresholds(base: DataFrame) -> DataFrame:
    """Six exact quantiles as one row; review scores of 0 mean no review and are left out.

    A threshold without data stays null, so that every comparison with it is false.
    """
    rated = base.select(
        PREDICTED, "recency_days", "order_count", F.nullif(F.col("average_review_score"), F.lit(0.0)).alias("review")
    )
    return quantiles_of(
        rated,
        {
            PREDICTED: {"high_value": 0.75, "low_value": 0.25},
            "recency_days": {"high_recency": 0.75, "recent_activity": 0.25},
            "order_count": {"high_frequency": 0.75},
            "review": {"low_review": 0.25},
        },
    )


def with_thresholds(base: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The one threshold row as a struct column ``t`` on every row."""
    return base.withColumn("t", thresholds.select(F.struct(*thresholds.columns)).scalar())


def _conditions() -> dict[str, Column]:
    value, recency, review = F.col(PREDICTED), F.col("recency_days"), F.col("average_review_score")
    return {
        "valuable": value >= F.col("t.high_value"),
        "low_value": value <= F.col("t.low_value"),
        "not_low": value >= F.col("t.low_value"),
        "inactive": recency >= F.col("t.high_recency"),
        "recent": recency <= F.col("t.recent_activity"),
        "frequent": F.col("order_count") >= F.col("t.high_frequency"),
        "unhappy": (review > 0) & (review <= F.col("t.low_review")),
    }


def retention_priority() -> Column:
    """Valuable and inactive is critical; valuable with weak reviews is high."""
    c = _conditions()
    return rule_case(
        [
            (c["valuable"] & c["inactive"], "Critical"),
            (c["valuable"] & c["unhappy"], "High"),
            (c["not_low"] | c["recent"], "Medium"),
        ],
        "Low",
    )


def retention_action() -> Column:
    """Action name; the first rule that holds."""
    c = _conditions()
    return rule_case(
        [
            (c["valuable"] & c["inactive"], "Win-back campaign"),
            (c["valuable"] & c["unhappy"], "Service recovery outreach"),
            (c["valuable"] & c["frequent"], "VIP loyalty offer"),
            (c["recent"], "Cross-sell recommendation"),
            ((F.col("order_count") <= 1) & c["low_value"], "First-to-second-purchase campaign"),
            (c["low_value"], "Low-cost engagement"),
        ],
        "Standard retention nurture",
    )


def opportunity_score(base: DataFrame) -> DataFrame:
    """0-100 from average-rank percentiles of value, recency and (inverted) orders."""
    ranks = column_ranks(base, PERSON, [PREDICTED, "recency_days", "order_count"])

    def pct(column: str) -> Column:
        return F.col(f"average_{column}") / F.col(f"size_{column}")

    mix = pct(PREDICTED) * 0.5 + pct("recency_days") * 0.35 + (1 - pct("order_count")) * 0.15
    return base.join(ranks.select(PERSON, (mix * 100).alias("opportunity_score")), PERSON)


def retention_table(base: DataFrame) -> DataFrame:
    """Base with priority, action, reason, strategy and opportunity score."""
    base = stable(base)
    ruled = with_thresholds(base, retention_thresholds(base)).withColumns(
        {"retention_priority": retention_priority(), "recommended_action": retention_action()}
    )
    ruled = ruled.drop("t").withColumns(
        {
            "recommendation_reason": label_map("recommended_action", ACTIONS),
            "retention_strategy": label_map("recommended_action", STRATEGIES),
        }
    )
    return opportunity_score(ruled)


def priority_distribution(retention: DataFrame) -> DataFrame:
    return value_counts_fixed(retention, "retention_priority", PRIORITIES)


def priority_profile(retention: DataFrame) -> DataFrame:
    """Means per priority, in fixed order."""
    return (
        retention.groupBy("retention_priority")
        .agg(
            F.count(PERSON).alias("customers"),
            F.avg(PREDICTED).alias("average_predicted_value"),
            F.sum(PREDICTED).alias("total_predicted_value"),
            F.avg("recency_days").alias("average_recency_days"),
            F.avg("order_count").alias("average_orders"),
            F.avg("opportunity_score").alias("average_opportunity_score"),
        )
        .orderBy(level_order("retention_priority", PRIORITIES))
    )


def action_counts(retention: DataFrame) -> DataFrame:
    return (
        retention.groupBy("retention_priority", "recommended_action")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("retention_priority", F.desc("customers"), "recommended_action")
    )


# ---- registered queries -----------------------------------------------------


def trend_base(t: Marketplace) -> DataFrame:
    """Base with rule clusters and a tenth of the historical revenue as prediction."""
    features = stable(with_rule_clusters(t))
    clv = modelling_set(t).select(PERSON, (F.col("historical_revenue") * 0.1).alias(PREDICTED))
    return retention_base(features, clv, features)


def trend_retention(t: Marketplace) -> DataFrame:
    return stable(retention_table(trend_base(t)))


def base_query(t: Marketplace) -> DataFrame:
    return trend_base(t)


def thresholds_query(t: Marketplace) -> DataFrame:
    return rounded(retention_thresholds(stable(trend_base(t))))


def retention_query(t: Marketplace) -> DataFrame:
    return trend_retention(t).withColumn("opportunity_score", F.round("opportunity_score", 8))


def distribution_query(t: Marketplace) -> DataFrame:
    return priority_distribution(trend_retention(t))


def profile_query(t: Marketplace) -> DataFrame:
    return rounded(priority_profile(trend_retention(t)))


def actions_query(t: Marketplace) -> DataFrame:
    return action_counts(trend_retention(t))


QUERIES = {
    "k6_1_retention_base": base_query,
    "k6_2_thresholds": thresholds_query,
    "k6_3_retention_table": retention_query,
    "k6_7_priority_distribution": distribution_query,
    "k6_8_priority_profile": profile_query,
    "k6_9_action_counts": actions_query,
}
