from oracle.features import STEPS as FEATURE_STEPS
from oracle.value import STEPS as VALUE_STEPS
from oracle.base import pct, quantile, with_ctes

LOG = """recency_days order_count total_revenue total_items unique_products_purchased average_order_value
    average_delivery_days""".split()
PLAIN = "average_review_score negative_review_rate average_delivery_vs_estimate_days".split()
LABELS = ["High Value", "At Risk High Value", "Recently Active", "Core / Developing"]

CLUSTERED = """SELECT *, rfm_score % 4 AS cluster_id, CASE rfm_score % 4 WHEN 0 THEN 'High Value'
    WHEN 1 THEN 'At Risk High Value' WHEN 2 THEN 'Recently Active' ELSE 'Core / Developing' END AS segment FROM features"""
STEPS = {**FEATURE_STEPS, "clustered": CLUSTERED}


def over(body: str, **more: str) -> str:
    return with_ctes("po item rev pay sale", body, **STEPS, **more)


def mean(column: str, alias: str) -> str:
    return f"round(avg({column}), 6) AS {alias}"


COMMON = ", ".join([
    "count(*) AS customers", mean("recency_days", "average_recency_days"), mean("order_count", "average_orders"),
    mean("total_revenue", "average_revenue"), "round(sum(total_revenue), 4) AS total_revenue",
    mean("average_order_value", "average_order_value"),
])
CUSTOMER_SHARE = "round(count(*) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS customer_share_pct"
REVENUE_SHARE = "round(sum(f.total_revenue) * 100 / sum(sum(f.total_revenue)) OVER (), 6) AS revenue_share_pct"

PROFILE = f"""SELECT cluster_id, {COMMON}, {mean('total_items', 'average_items')},
    {mean('unique_products_purchased', 'average_unique_products')}, {mean('average_review_score', 'average_review_score')},
    {mean('average_delivery_days', 'average_delivery_days')}, {CUSTOMER_SHARE}, {REVENUE_SHARE} FROM clustered f GROUP BY 1"""

RAW = """SELECT cluster_id, avg(total_revenue) AS v, avg(recency_days) AS d, count(*) AS customers FROM clustered GROUP BY 1"""

SQL = {
    # The clusters differ from fit to fit; every person is in that of the nearest centre.
    "k2_4_fitted_segments": over("SELECT customer_unique_id, true AS nearest FROM features"),
    "k2_1_cluster_matrix": over("SELECT customer_unique_id, "
        + ", ".join(f"round(ln(1 + greatest({c}, 0)), 8) AS {c}" for c in LOG) + ", "
        + ", ".join(f"round({c}, 8) AS {c}" for c in PLAIN) + " FROM features"),
    "k2_6_cluster_profile": over(PROFILE),
    "k2_7_cluster_labels": over("""SELECT cluster_id, CASE
        WHEN cluster_id = (SELECT cluster_id FROM raw ORDER BY v DESC, cluster_id LIMIT 1) THEN 'High Value'
        WHEN cluster_id = (SELECT cluster_id FROM raw WHERE v >= (SELECT median(v) FROM raw) ORDER BY d DESC, cluster_id LIMIT 1)
            THEN 'At Risk High Value'
        WHEN cluster_id = (SELECT cluster_id FROM raw ORDER BY d, cluster_id LIMIT 1) THEN 'Recently Active'
        ELSE 'Core / Developing' END AS segment, customers FROM raw""", raw=RAW),
    "k2_8_segment_summary": over(f"""SELECT cluster_id, segment, {COMMON}, {CUSTOMER_SHARE}, {REVENUE_SHARE}
        FROM clustered f GROUP BY 1, 2"""),
    "k2_8_rfm_profile": over(f"""SELECT customer_segment, {COMMON}, {mean('average_review_score', 'average_review_score')},
        {REVENUE_SHARE} FROM features f GROUP BY 1"""),
    "k2_8_rfm_distribution": over(f"""SELECT customer_segment AS segment, count(*) AS customer_count,
        {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM features GROUP BY 1"""),
    "k2_8_rfm_by_cluster": over("SELECT customer_segment, " + ", ".join(
        f"{pct(f'''count(*) FILTER (WHERE segment = '{s}')''', 'count(*)')} AS \"{s}\"" for s in LABELS)
        + " FROM clustered GROUP BY 1"),
}

# ---- retention ----

from martlight.plans.retention import ACTIONS, STRATEGIES  # noqa: E402  fixed texts


def texts(labels: dict) -> str:
    return "CASE recommended_action " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


VALUE = {k: VALUE_STEPS[k] for k in ("cut", "data", "model", "trend")}
KEPT = """customer_unique_id, recency_days, CAST(order_count AS DOUBLE) AS order_count, total_revenue, average_order_value,
    total_items, average_review_score, negative_review_rate, average_delivery_days, average_delivery_vs_estimate_days,
    rfm_score, customer_segment, cluster_id, segment"""
RBASE = f"""SELECT {KEPT}, coalesce(predicted_future_revenue, 0) AS predicted_future_revenue FROM clustered
    LEFT JOIN (SELECT customer_unique_id, predicted_future_revenue FROM trend) USING (customer_unique_id)"""
LIMITS = f"""SELECT {quantile('predicted_future_revenue', 0.75)} AS high_value,
    {quantile('predicted_future_revenue', 0.25)} AS low_value, {quantile('recency_days', 0.75)} AS high_recency,
    {quantile('recency_days', 0.25)} AS recent_activity, {quantile('order_count', 0.75)} AS high_frequency,
    {quantile('nullif(average_review_score, 0)', 0.25)} AS low_review FROM rbase"""


def pct_of(column: str) -> str:
    return (f"((rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0) "
            f"/ count(*) OVER ())")


RULED = f"""SELECT rbase.*, CASE
      WHEN predicted_future_revenue >= high_value AND recency_days >= high_recency THEN 'Critical'
      WHEN predicted_future_revenue >= high_value AND average_review_score > 0 AND average_review_score <= low_review THEN 'High'
      WHEN predicted_future_revenue >= low_value OR recency_days <= recent_activity THEN 'Medium' ELSE 'Low' END
      AS retention_priority, CASE
      WHEN predicted_future_revenue >= high_value AND recency_days >= high_recency THEN 'Win-back campaign'
      WHEN predicted_future_revenue >= high_value AND average_review_score > 0 AND average_review_score <= low_review
          THEN 'Service recovery outreach'
      WHEN predicted_future_revenue >= high_value AND order_count >= high_frequency THEN 'VIP loyalty offer'
      WHEN recency_days <= recent_activity THEN 'Cross-sell recommendation'
      WHEN order_count <= 1 AND predicted_future_revenue <= low_value THEN 'First-to-second-purchase campaign'
      WHEN predicted_future_revenue <= low_value THEN 'Low-cost engagement' ELSE 'Standard retention nurture' END
      AS recommended_action,
    100 * (0.5 * {pct_of('predicted_future_revenue')} + 0.35 * {pct_of('recency_days')}
      + 0.15 * (1 - {pct_of('order_count')})) AS opportunity_score FROM rbase CROSS JOIN limits"""
RET = f"SELECT *, {texts(ACTIONS)} AS recommendation_reason, {texts(STRATEGIES)} AS retention_strategy FROM ruled"
RETENTION_STEPS = {**VALUE, "rbase": RBASE, "limits": LIMITS, "ruled": RULED, "ret": RET}


def over_retention(body: str, **more: str) -> str:
    return over(body, **RETENTION_STEPS, **more)


PRIORITY = "(VALUES ('Critical', 1), ('High', 2), ('Medium', 3), ('Low', 4)) AS p(level, place)"

SQL.update({
    "k6_1_retention_base": over_retention("SELECT * FROM rbase"),
    "k6_2_thresholds": over_retention("SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in (
        "high_value", "low_value", "high_recency", "recent_activity", "high_frequency", "low_review")) + " FROM limits"),
    "k6_3_retention_table": over_retention("SELECT * REPLACE (round(opportunity_score, 8) AS opportunity_score) FROM ret"),
    "k6_7_priority_distribution": over_retention(f"""SELECT level AS retention_priority, count(retention_priority) AS customers,
        {pct('count(retention_priority)', '(SELECT count(*) FROM ret)')} AS percentage
        FROM {PRIORITY} LEFT JOIN ret ON level = retention_priority GROUP BY 1"""),
    "k6_8_priority_profile": over_retention(f"""SELECT retention_priority, count(*) AS customers,
        {mean('predicted_future_revenue', 'average_predicted_value')},
        round(sum(predicted_future_revenue), 4) AS total_predicted_value, {mean('recency_days', 'average_recency_days')},
        {mean('order_count', 'average_orders')}, {mean('opportunity_score', 'average_opportunity_score')}
        FROM ret GROUP BY 1"""),
    "k6_9_action_counts": over_retention("""SELECT retention_priority, recommended_action, count(*) AS customers
        FROM ret GROUP BY 1, 2"""),
})
