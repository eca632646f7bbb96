"""The three-row order frame with exact expectations, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from martlight.plans.features import customer_features, order_level

SCHEMA = (
    "customer_unique_id string, order_id string, order_status string, order_purchase_timestamp string, "
    "order_delivered_customer_date string, order_estimated_delivery_date string, product_revenue double, "
    "freight_revenue double, item_count int, unique_products int, average_review_score double, review_count int, "
    "negative_review_count int, payment_value double, payment_record_count int, payment_type_count int"
)
ROWS = [
    ("c1", "o1", "delivered", "2024-01-01", "2024-01-03", "2024-01-04", 100.0, 10.0, 2, 2, 5.0, 1, 0, 110.0, 1, 1),
    ("c1", "o2", "delivered", "2024-01-11", "2024-01-14", "2024-01-15", 50.0, 5.0, 1, 1, 4.0, 1, 0, 55.0, 1, 1),
    ("c2", "o3", "delivered", "2024-01-21", "2024-01-23", "2024-01-24", 25.0, 2.0, 1, 1, 3.0, 1, 1, 27.0, 1, 1),
]
EXPECTED = {
    "c1": dict(order_count=2, total_revenue=165.0, total_items=3, is_repeat_customer=1, recency_days=10.0,
               customer_age_days=10.0, average_order_value=82.5, average_items_per_order=1.5,
               average_freight_per_order=7.5, revenue_per_item=50.0, orders_per_active_day=0.2, average_review_score=4.5,
               negative_review_rate=0.0, average_delivery_days=2.5, median_delivery_days=2.5,
               average_delivery_vs_estimate_days=-1.0, late_delivery_order_count=0, delivered_order_count=2,
               spend_percentile=1.0, recency_percentile=1.0, recency_score=1, frequency_score=5, monetary_score=5,
               rfm_score=11, customer_segment="At Risk High Value"),
    "c2": dict(order_count=1, total_revenue=27.0, total_items=1, is_repeat_customer=0, recency_days=0.0,
               customer_age_days=0.0, average_order_value=27.0, average_items_per_order=1.0,
               average_freight_per_order=2.0, revenue_per_item=25.0, orders_per_active_day=0.0, average_review_score=3.0,
               negative_review_rate=1.0, average_delivery_days=2.0, median_delivery_days=2.0,
               average_delivery_vs_estimate_days=-1.0, late_delivery_order_count=0, delivered_order_count=1,
               spend_percentile=0.5, recency_percentile=0.5, recency_score=5, frequency_score=1, monetary_score=1,
               rfm_score=7, customer_segment="Needs Attention"),
}


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_expected_values(frame):
    rows = {r["customer_unique_id"]: r.asDict() for r in customer_features(frame).collect()}
    assert set(rows) == {"c1", "c2"}
    for person, values in EXPECTED.items():
        assert len(rows[person]) == 36
        for name, value in values.items():
            assert rows[person][name] == value, (person, name)


def test_numbers_are_finite(frame):
    for row in customer_features(frame).collect():
        assert all(math.isfinite(v) for v in row.asDict().values() if isinstance(v, (int, float)))


def test_no_purchase_dates(frame):
    with pytest.raises(ValueError, match="No valid order_purchase_timestamp"):
        customer_features(frame.withColumn("order_purchase_timestamp", F.lit("soon")))


def test_nothing_delivered_and_no_reviews(frame):
    bare = frame.withColumns(
        {"order_delivered_customer_date": F.lit(None).cast("string"), "average_review_score": F.lit(0.0)}
    )
    for row in customer_features(bare).collect():
        assert row["average_delivery_days"] == row["median_delivery_days"] == 0
        assert row["delivered_order_count"] == row["late_delivery_order_count"] == 0
        assert row["average_review_score"] == 0


def test_one_customer_has_no_scores(frame):
    row = customer_features(frame.where("customer_unique_id = 'c2'")).head()
    assert row["rfm_score"] is None and row["spend_percentile"] == 1.0
    assert row["customer_segment"] == "Needs Attention"


def test_orders_without_items_count(star):
    level = order_level(star)
    assert level.count() == star.orders.count()
    assert level.where("item_count = 0 AND product_revenue <> 0").isEmpty()
    assert not level.where("item_count = 0").isEmpty()
