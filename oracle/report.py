from martlight.plans.report import CUSTOMER_PROMPT, PORTFOLIO_PROMPT, RETENTION_FIELDS
from oracle import attribution, recommender, value
from oracle.base import pct, quantile, with_ctes
from oracle.segments import RETENTION_STEPS, STEPS, mean

P = "predicted_future_revenue"
ALL_STEPS = {**STEPS, **RETENTION_STEPS}
RISK = f"""SELECT * FROM ret WHERE {P} >= (SELECT {quantile(P, 0.75)} FROM ret)
    AND recency_days >= (SELECT {quantile('recency_days', 0.75)} FROM ret)"""


def over(body: str, **more: str) -> str:
    return with_ctes("po item rev pay sale cat", body, **ALL_STEPS, risk=RISK, **more)


def total(column: str, alias: str) -> str:
    return f"round(sum({column}), 4) AS {alias}"


def steady(column: str, alias: str) -> str:
    """Mean rounded half up at six digits, in whole numbers of 1e-10."""
    whole = f"CAST(sum(CAST({column} AS DECIMAL(28,10))) * 10000000000 AS HUGEINT)"
    return f"CAST(({whole} * 2 + count({column}) * 10000) // (count({column}) * 20000) AS DOUBLE) / 1000000 AS {alias}"


def six(expr: str, digits: int = 6) -> str:
    """Number text with fixed decimals."""
    return f"CAST(CAST({expr} AS DECIMAL(26,{digits})) AS VARCHAR)"


def text(template: str, value_sql: str) -> str:
    before, after = template.split("%s")
    return f"'{before}' || {value_sql} || '{after}'".replace("\n", "' || chr(10) || '")


def pairs(parts: list[tuple[str, str, bool]]) -> str:
    """JSON object text of (name, SQL text value, quoted?)."""
    shown = []
    for name, expr, quoted in parts:
        shown.append(f"""'"{name}":' || """ + (f"""'"' || {expr} || '"'""" if quoted else expr))
    return "'{' || " + " || ',' || ".join(shown) + " || '}'"


def spread(column: str) -> str:
    return f"""(SELECT '{{' || string_agg('"' || {column} || '":' || n, ',' ORDER BY {column}) || '}}' FROM
        (SELECT {column}, count(*) AS n FROM ret GROUP BY 1))"""


METRIC = "SELECT '{0}' AS metric, round(CAST({1} AS DOUBLE), 4) AS value FROM {2}".format
OPPORTUNITY = " UNION ALL ".join([
    METRIC("High-value inactive customers", "count(*)", "risk"),
    METRIC("Predicted revenue at opportunity", f"coalesce(sum({P}), 0)", "risk"),
    METRIC("Average predicted value", f"coalesce(avg({P}), 0)", "risk"),
    METRIC("Average recency", "coalesce(avg(recency_days), 0)", "risk"),
])
KPIS = " UNION ALL ".join([
    METRIC("Customers", "count(DISTINCT customer_unique_id)", "ret"),
    METRIC("Predicted Future Revenue", f"sum({P})", "ret"),
    METRIC("Average Predicted Customer Value", f"avg({P})", "ret"),
    METRIC("Critical Retention Customers", "count(*) FILTER (WHERE retention_priority = ''Critical'')", "ret").replace("''", "'"),
    METRIC("High Retention Customers", "count(*) FILTER (WHERE retention_priority = ''High'')", "ret").replace("''", "'"),
    METRIC("High-Value Inactive Customers", "count(*)", "risk"),
    METRIC("Recommendation Rows", "count(*)", "(SELECT * FROM mixed WHERE customer_unique_id IN (SELECT customer_unique_id FROM elig))"),
])

CONTEXT = pairs([
    ("customer_unique_id", "CAST(customer_unique_id AS VARCHAR)", True), (P, six(P), False),
    ("recency_days", six("recency_days"), False), ("order_count", six("order_count"), False),
    ("retention_priority", "retention_priority", True), ("recommended_action", "recommended_action", True),
    ("recommendation_reason", "recommendation_reason", True), ("retention_strategy", "retention_strategy", True),
    ("opportunity_score", six("opportunity_score"), False), ("total_revenue", six("total_revenue"), False),
    ("average_order_value", six("average_order_value"), False), ("segment", "segment", True),
    ("customer_segment", "customer_segment", True), ("cluster_id", "CAST(cluster_id AS VARCHAR)", False),
])

SEGMENT_LIST = "(SELECT '[' || string_agg(" + pairs([
    ("segment", "segment", True), ("customers", "customers", False), ("total_revenue", six("tr", 2), False),
    ("average_recency_days", six("ar", 2), False), ("average_order_count", six("ao", 2), False),
]) + """, ',' ORDER BY segment) || ']' FROM (SELECT segment, count(*) AS customers, sum(total_revenue) AS tr,
    avg(recency_days) AS ar, avg(order_count) AS ao FROM ret GROUP BY 1))"""

DRIVER_LIST = "(SELECT '[' || string_agg(" + pairs([
    ("feature", "feature", True), ("mean_abs_shap", six("mean_abs_shap"), False),
]) + f", ',' ORDER BY mean_abs_shap DESC, feature) || ']' FROM ({attribution.SUMMARY}))"

PORTFOLIO = pairs([
    ("customer_count", "count(DISTINCT customer_unique_id)", False),
    ("predicted_future_revenue_total", six(f"sum({P})", 2), False),
    ("average_predicted_customer_value", six(f"avg({P})", 2), False), ("average_recency_days", six("avg(recency_days)", 2), False),
    ("retention_priority_distribution", spread("retention_priority"), False),
    ("recommended_action_distribution", spread("recommended_action"), False),
    ("segment_distribution", spread("segment"), False), ("segment_summary", SEGMENT_LIST, False),
    ("top_model_drivers", DRIVER_LIST, False), ("high_value_inactive_customers", "(SELECT count(*) FROM risk)", False),
    ("predicted_value_at_risk_opportunity", six(f"(SELECT coalesce(sum({P}), 0) FROM risk)", 2), False),
])

ARTIFACTS = {"features": "ret", "segments": "ret", "clv": "trend", "retention": "ret"}

SQL = {
    "k7_1_portfolio_summary": over(f"""SELECT count(DISTINCT customer_unique_id) AS customer_count,
        {total(P, P)}, {steady(P, 'average_predicted_customer_value')}, {steady('recency_days', 'average_recency_days')}, """
        + ", ".join(f"count(*) FILTER (WHERE retention_priority = '{p}') AS {p.lower()}_retention_customers"
                    for p in ("Critical", "High", "Medium", "Low")) + " FROM ret"),
    "k7_2_priority_summary": over(f"""SELECT retention_priority, count(DISTINCT customer_unique_id) AS customers,
        {total(P, P)}, {steady(P, 'average_predicted_value')}, {steady('recency_days', 'average_recency_days')},
        {steady('opportunity_score', 'average_opportunity_score')} FROM ret GROUP BY 1"""),
    "k7_3_action_summary": over(f"""SELECT retention_priority, recommended_action,
        count(DISTINCT customer_unique_id) AS customers, {total(P, P)} FROM ret GROUP BY 1, 2"""),
    "k7_4_inactive_high_value": over(f"""SELECT customer_unique_id, {P}, recency_days, order_count, retention_priority,
        recommended_action, recommendation_reason, round(opportunity_score, 6) AS opportunity_score FROM risk
        ORDER BY {P} DESC, customer_unique_id LIMIT 50"""),
    "k7_5_segment_summary": over(f"""SELECT segment, count(DISTINCT customer_unique_id) AS customers,
        round(sum(f.total_revenue), 4) AS total_revenue, {mean('f.total_revenue', 'average_revenue')},
        {mean('recency_days', 'average_recency_days')}, {mean('order_count', 'average_order_count')},
        round(count(*) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS customer_share_pct,
        round(sum(f.total_revenue) * 100 / sum(sum(f.total_revenue)) OVER (), 6) AS revenue_share_pct
        FROM clustered f GROUP BY 1"""),
    "k7_7_evaluation_report": over(f"""SELECT 'CLV' AS category, metric, value FROM ({value.REPORT})
        UNION ALL SELECT 'Retention Opportunity', metric, value FROM ({OPPORTUNITY})
        UNION ALL SELECT 'Portfolio KPI', metric, value FROM ({KPIS})""",
        **{("act_cut" if k == "cut" else k): v.replace("CROSS JOIN cut ", "CROSS JOIN act_cut ")
           for k, v in recommender.STEPS.items()}),
    "k7_8_uniqueness": over(" UNION ALL ".join(
        f"SELECT '{n}' AS artifact, count(*) AS rows, count(DISTINCT customer_unique_id) AS unique_customers, "
        f"count(*) - count(DISTINCT customer_unique_id) AS duplicate_customer_rows, "
        f"count(*) FILTER (WHERE customer_unique_id IS NULL) AS missing_customer_ids FROM {s}" for n, s in ARTIFACTS.items())),
    "k7_8_coverage": over(" UNION ALL ".join(
        f"SELECT '{n}' AS artifact, count(DISTINCT customer_unique_id) AS customers, count(DISTINCT customer_unique_id) "
        f"FILTER (WHERE customer_unique_id NOT IN (SELECT customer_unique_id FROM ret)) AS missing_from_feature_table, "
        + pct("count(DISTINCT customer_unique_id) FILTER (WHERE customer_unique_id IN (SELECT customer_unique_id FROM ret))",
              "count(DISTINCT customer_unique_id)") + f" AS coverage_pct FROM {s}" for n, s in ARTIFACTS.items())),
    "k7_8_retention_completeness": over(" UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f} IS NULL) AS missing_values FROM ret" for f in RETENTION_FIELDS)),
    "k7_9_opportunity_summary": over(OPPORTUNITY),
    "k7_11_portfolio_context": over(f"SELECT context, {text(PORTFOLIO_PROMPT, 'context')} AS prompt FROM ("
        f"SELECT {PORTFOLIO} AS context FROM ret)", step=attribution.STEP, long=attribution.LONG),
    "k7_12_customer_context": over(f"SELECT customer_unique_id, {CONTEXT} AS context FROM ret"),
    "k7_12_customer_prompts": over(
        f"SELECT customer_unique_id, {text(CUSTOMER_PROMPT, CONTEXT)} AS prompt FROM ret"),
}
