from oracle.base import big, cents, cutoff, days, with_ctes
from oracle.explore import profile

DATA = f"""SELECT customer_unique_id, historical_order_count, historical_revenue, historical_item_count,
    historical_unique_products, first_purchase_date, last_purchase_date, coalesce(future_revenue, 0) AS future_revenue FROM (
    SELECT customer_unique_id, count(DISTINCT order_id) AS historical_order_count,
    {cents('coalesce(sum(v), 0)')} AS historical_revenue, {big('coalesce(sum(n), 0)')} AS historical_item_count,
    {big('coalesce(sum(u), 0)')} AS historical_unique_products, min(ts) AS first_purchase_date, max(ts) AS last_purchase_date
    FROM po LEFT JOIN (SELECT order_id, sum(pc + fc) AS v, count(*) AS n, count(DISTINCT product_id) AS u FROM item
    GROUP BY 1) USING (order_id) CROSS JOIN cut WHERE ts <= cutoff GROUP BY 1)
    LEFT JOIN (SELECT customer_unique_id, {cents('sum(pc + fc)')} AS future_revenue FROM sale CROSS JOIN cut
    WHERE ts > cutoff GROUP BY 1) USING (customer_unique_id)"""

MODEL = f"""SELECT *, coalesce(CAST(historical_order_count AS DOUBLE) / nullif(historical_customer_age_days, 0), 0)
    AS historical_orders_per_active_day FROM (
    SELECT data.*, {days('cutoff', 'last_purchase_date')} AS historical_recency_days,
    {days('last_purchase_date', 'first_purchase_date')} AS historical_customer_age_days,
    historical_revenue / historical_order_count AS historical_average_order_value,
    CAST(historical_item_count AS DOUBLE) / historical_order_count AS historical_average_items_per_order
    FROM data CROSS JOIN cut)"""

TREND = "SELECT *, historical_revenue * CAST(0.1 AS DOUBLE) AS predicted_future_revenue FROM model"
STEPS = {"cut": cutoff("ord"), "data": DATA, "model": MODEL, "trend": TREND}

FEATURES = """historical_recency_days historical_order_count historical_revenue historical_item_count
    historical_unique_products historical_average_order_value historical_average_items_per_order
    historical_orders_per_active_day""".split()

BAND = """SELECT *, CASE (greatest(0, ((r - 1) * 4 + n - 2) // (n - 1) - 1)) WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium'
    WHEN 2 THEN 'High' ELSE 'Very High' END AS predicted_value_band FROM (SELECT *, count(*) OVER () AS n,
    row_number() OVER (ORDER BY predicted_future_revenue, customer_unique_id) AS r,
    row_number() OVER (ORDER BY predicted_future_revenue DESC, customer_unique_id) AS predicted_value_rank FROM trend)"""


def over(body: str, **more: str) -> str:
    return with_ctes("po sale item", body, **STEPS, **more)


def metric(name: str, expr: str, source: str = "trend") -> str:
    return f"SELECT '{name}' AS metric, round({expr}, 4) AS value FROM {source}"


REPORT = " UNION ALL ".join([
    metric("MAE", "avg(abs(future_revenue - predicted_future_revenue))"),
    metric("RMSE", "sqrt(avg(power(future_revenue - predicted_future_revenue, 2)))"),
    metric("R2", "1 - sum(power(future_revenue - predicted_future_revenue, 2)) / (var_pop(future_revenue) * count(*))"),
    metric("Mean Actual Future Revenue", "avg(future_revenue)"),
    metric("Mean Predicted Future Revenue", "avg(predicted_future_revenue)"),
    metric("Total Actual Future Revenue", "sum(future_revenue)"),
    metric("Total Predicted Future Revenue", "sum(predicted_future_revenue)"),
])

ERRORS = """SELECT *, abs(error) AS absolute_error, abs(error) / nullif(future_revenue, 0) * 100 AS absolute_percentage_error
    FROM (SELECT *, predicted_future_revenue - future_revenue AS error FROM trend)"""

SQL = {
    "fq02_cutoff": with_ctes("ord", "SELECT cutoff AS cutoff_timestamp FROM cut", cut=STEPS["cut"]),
    "fq03_modelling_set": over("SELECT * FROM data"),
    "k3_3_value_features": over("SELECT * FROM model"),
    # Models: what holds for every fit.
    "k3_5_model_metrics": "SELECT unnest(['MAE', 'RMSE', 'R2', 'Mean Actual Future Revenue', "
        "'Mean Predicted Future Revenue', 'Total Actual Future Revenue', 'Total Predicted Future Revenue']) AS metric, "
        "true AS holds",
    "k3_6_scored_customers": over(f"""SELECT customer_unique_id, {', '.join(FEATURES)}, future_revenue,
        true AS predicted_valid FROM model"""),
    "k3_10_importance": f"SELECT unnest({FEATURES!r}) AS feature, true AS share_valid",
    "k3_7_scoring_validation": over(" UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) AS rows, count(*) FILTER (WHERE {f} IS NULL) AS missing_or_non_numeric, "
        f"count(*) FILTER (WHERE {f} < 0) AS negative FROM model" for f in FEATURES)),
    "k3_8_regression_report": over(REPORT),
    "k3_9_error_columns": over("""SELECT customer_unique_id, round(future_revenue, 4) AS future_revenue,
        round(predicted_future_revenue, 4) AS predicted_future_revenue, round(error, 4) AS error,
        round(absolute_error, 4) AS absolute_error, round(absolute_percentage_error, 4) AS absolute_percentage_error
        FROM e""", e=ERRORS),
    "k3_9_error_profile": over("SELECT * REPLACE (round(min, 6) AS min, round(max, 6) AS max) FROM ("
        + profile("e", "future_revenue", "predicted_future_revenue", "error", "absolute_error") + ")", e=ERRORS),
    "k3_11_value_bands": over("""SELECT customer_unique_id, predicted_future_revenue, predicted_value_rank,
        predicted_value_band FROM b""", b=BAND),
    "k3_11_band_summary": over("""SELECT predicted_value_band, count(*) AS customers,
        round(avg(predicted_future_revenue), 4) AS average_predicted_value,
        round(sum(predicted_future_revenue), 4) AS total_predicted_value FROM b GROUP BY 1""", b=BAND),
    "k3_12_calibration": over("""SELECT predicted_value_band, count(*) AS customers,
        round(avg(future_revenue), 4) AS average_actual, round(avg(predicted_future_revenue), 4) AS average_predicted,
        round(sum(future_revenue), 4) AS total_actual, round(sum(predicted_future_revenue), 4) AS total_predicted
        FROM b GROUP BY 1""", b=BAND),
    "k3_13_fixed_bands": over("""SELECT CASE WHEN historical_revenue >= 100000 THEN 'Very High Value'
        WHEN historical_revenue >= 50000 THEN 'High Value' WHEN historical_revenue >= 20000 THEN 'Medium Value'
        ELSE 'Lower Value' END AS band, count(*) AS customers FROM model GROUP BY 1"""),
    "k3_14_target_balance": over("""SELECT count(*) FILTER (WHERE future_revenue = 0) AS zero_future_revenue,
        count(*) FILTER (WHERE future_revenue > 0) AS with_future_revenue FROM model"""),
}
