"""Future-revenue modelling: data set, boosted trees, scoring, metrics and value bands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.functions.columns import clip_zero, count_where, days_between, fixed_value_band, safe_ratio
from martlight.operators.checks import profile_numeric
from martlight.operators.impute import clean_numeric, impute_median, validate_scoring_input
from martlight.operators.ordering import quantile_bin, rank_first
from martlight.plans.facts import person_orders
from martlight.plans.recommend import order_cutoff
from martlight.session import stable
from martlight.sources.tables import Marketplace, require_columns

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"
ACTUAL, PREDICTED = "future_revenue", "predicted_future_revenue"

# fixed values: model features in model order, and band names from low to high
FEATURES = [
    "historical_recency_days",
    "historical_order_count",
    "historical_revenue",
    "historical_item_count",
    "historical_unique_products",
    "historical_average_order_value",
    "historical_average_items_per_order",
    "historical_orders_per_active_day",
]
BANDS = ["Low", "Medium", "High", "Very High"]


def clv_dataset(t: Marketplace, cutoff) -> DataFrame:
    """Persons with an order up to ``cutoff``: history sums, and revenue after it (0 if none)."""
    items = t.order_items.groupBy("order_id").agg(
        F.sum(F.col("price") + F.col("freight_value")).alias("revenue"),
        F.count(F.lit(1)).alias("item_count"),
        F.countDistinct("product_id").alias("unique_products"),
    )
    past = F.col(TS) <= F.lit(cutoff).cast("timestamp_ntz")
    zero = F.lit(0)

    def money(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("revenue"))).cast("double"), zero.cast("double"))

    def past_sum(column: str) -> Column:
        return F.coalesce(F.sum(F.when(past, F.col(column))), zero)

    return (
        person_orders(t, TS)
        .join(items, "order_id", "left")
        .groupBy(PERSON)
        .agg(
            F.count_if(past).alias("historical_order_count"),
            money(past).alias("historical_revenue"),
            past_sum("item_count").alias("historical_item_count"),
            past_sum("unique_products").alias("historical_unique_products"),
            F.min(F.when(past, F.col(TS))).alias("first_purchase_date"),
            F.max(F.when(past, F.col(TS))).alias("last_purchase_date"),
            money(~past).alias(ACTUAL),
        )
        .where(F.col("historical_order_count") > 0)
    )


def clv_features(dataset: DataFrame, cutoff) -> DataFrame:
    """History features as of ``cutoff``; ratios without a denominator are 0."""
    limit = F.lit(cutoff).cast("timestamp_ntz")
    age = F.greatest(days_between("last_purchase_date", "first_purchase_date"), F.lit(0.0))
    orders = "historical_order_count"
    return dataset.withColumns(
        {
            "historical_recency_days": days_between(limit, "last_purchase_date"),
            "historical_customer_age_days": age,
            "historical_average_order_value": safe_ratio("historical_revenue", orders),
            "historical_average_items_per_order": safe_ratio("historical_item_count", orders),
        }
    ).withColumn("historical_orders_per_active_day", safe_ratio(orders, "historical_customer_age_days"))


def hash_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key, the same whatever the partitioning."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000).cast("long"))
    limit = int(round(share * 10_000))
    return df.where(bucket < limit), df.where(bucket >= limit)


@dataclass(frozen=True)
class ValueModel:
    """Boosted trees over log revenue with the feature order they were fitted on."""

    trees: GBTRegressionModel
    features: list[str] = field(default_factory=lambda: list(FEATURES))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_clv(
    train: DataFrame,
    features: Sequence[str] = FEATURES,
    trees: int = 500,
    depth: int = 6,
    rate: float = 0.05,
    row_share: float = 0.85,
    column_share: float = 0.85,
    bins: int = 256,
    seed: int = 42,
) -> ValueModel:
    """Squared-error boosted trees on ``log1p`` of the future revenue; ``bins`` candidate limits per feature."""
    features = list(features)
    require_columns(train, [*features, ACTUAL], "training table")
    matrix = impute_median(clean_numeric(train, features), features)
    data = stable(_assembled(matrix, features).select("features", F.log1p(clip_zero(ACTUAL)).alias("label")))
    learner = GBTRegressor(
        maxIter=trees,
        maxDepth=depth,
        stepSize=rate,
        maxBins=bins,
        subsamplingRate=row_share,
        featureSubsetStrategy=str(column_share),
        # Trees are shallow: finding a row's node anew is cheaper than a stored table of nodes per level.
        cacheNodeIds=False,
        seed=seed,
    )
    return ValueModel(learner.fit(data), features)


def score(model: ValueModel, df: DataFrame, keep_log: bool = False) -> DataFrame:
    """Input columns plus the predicted revenue, never negative.

    Features are parsed and imputed from the medians of the scored table itself.
    """
    missing = [c for c in model.features if c not in df.columns]
    if missing:
        raise ValueError("Missing required prediction features: " + ", ".join(missing))
    names = {c: f"_feature_{c}" for c in model.features}
    parsed = clean_numeric(df.withColumns({n: F.col(c) for c, n in names.items()}), list(names.values()))
    matrix = impute_median(parsed, list(names.values()))
    raw = model.trees.transform(_assembled(matrix, list(names.values())))
    scored = raw.withColumn(PREDICTED, clip_zero(F.expm1("prediction")))
    columns = [*df.columns, PREDICTED] + (["prediction"] if keep_log else [])
    return scored.select(*columns)


def importance(model: ValueModel) -> DataFrame:
    """Impurity importance per feature, largest first; one row per feature."""
    values = model.trees.featureImportances.toArray()
    rows = [
        F.struct(F.lit(name).alias("feature"), F.lit(float(value)).alias("importance"))
        for name, value in zip(model.features, values)
    ]
    listed = SparkSession.active().range(1).select(F.inline(F.array(*rows)))
    return listed.orderBy(F.desc("importance"), "feature")


def regression_report(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """MAE, RMSE, R2 (null without variance), means and totals as (metric, value)."""
    y = F.coalesce(F.col(actual).cast("double"), F.lit(0.0))
    p = F.coalesce(F.col(predicted).cast("double"), F.lit(0.0))
    squares = F.sum(F.pow(y - p, 2))
    spread = F.var_pop(y) * F.count(F.lit(1))
    wide = df.agg(
        F.avg(F.abs(y - p)).alias("MAE"),
        F.sqrt(F.avg(F.pow(y - p, 2))).alias("RMSE"),
        (1 - squares / F.nullif(spread, F.lit(0.0))).alias("R2"),
        F.avg(y).alias("Mean Actual Future Revenue"),
        F.avg(p).alias("Mean Predicted Future Revenue"),
        F.sum(y).alias("Total Actual Future Revenue"),
        F.sum(p).alias("Total Predicted Future Revenue"),
    )
    return wide.unpivot([], [f"`{c}`" for c in wide.columns], "metric", "value")


def error_columns(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Error, absolute error and absolute percentage error (null for an actual of 0)."""
    error = F.col(predicted) - F.col(actual)
    return df.withColumns(
        {
            "error": error,
            "absolute_error": F.abs(error),
            "absolute_percentage_error": F.abs(error) / F.nullif(F.col(actual), F.lit(0.0)) * 100,
        }
    )


def error_profile(df: DataFrame) -> DataFrame:
    return profile_numeric(error_columns(df), [ACTUAL, PREDICTED, "error", "absolute_error"])


def value_bands(df: DataFrame) -> DataFrame:
    """Rank by predicted value (ties by person) and its quartile band."""
    person, value = F.col(PERSON), F.col(PREDICTED)
    narrow = df.select(PERSON, PREDICTED)
    ranks = rank_first(narrow, [value.desc(), person], "predicted_value_rank").drop(PREDICTED)
    bands = quantile_bin(narrow, [value, person], 4, "predicted_value_band", BANDS).drop(PREDICTED)
    return df.join(ranks, PERSON).join(bands, PERSON)


def band_summary(banded: DataFrame) -> DataFrame:
    return banded.groupBy("predicted_value_band").agg(
        F.count(PERSON).alias("customers"),
        F.avg(PREDICTED).alias("average_predicted_value"),
        F.sum(PREDICTED).alias("total_predicted_value"),
    )


def calibration(df: DataFrame) -> DataFrame:
    """Actual against predicted revenue per quartile band of the prediction."""
    narrow = df.select(PERSON, ACTUAL, PREDICTED)
    banded = quantile_bin(narrow, [F.col(PREDICTED), F.col(PERSON)], 4, "predicted_value_band", BANDS)
    return banded.groupBy("predicted_value_band").agg(
        F.count(PERSON).alias("customers"),
        F.avg(ACTUAL).alias("average_actual"),
        F.avg(PREDICTED).alias("average_predicted"),
        F.sum(ACTUAL).alias("total_actual"),
        F.sum(PREDICTED).alias("total_predicted"),
    )


def target_balance(df: DataFrame) -> DataFrame:
    y = F.col(ACTUAL)
    return df.agg(count_where(y == 0).alias("zero_future_revenue"), count_where(y > 0).alias("with_future_revenue"))


# ---- registered queries -----------------------------------------------------


def modelling_set(t: Marketplace) -> DataFrame:
    """Features and target as of the 80th percentile of purchase time."""
    cutoff = order_cutoff(t).head()[0]
    return clv_features(clv_dataset(t, cutoff), cutoff)


def dataset_table(t: Marketplace) -> DataFrame:
    """fq03"""
    return clv_dataset(t, order_cutoff(t).head()[0])


def with_trend_prediction(t: Marketplace) -> DataFrame:
    """A tenth of the historical revenue as prediction: lets the reports be compared without a model."""
    return modelling_set(t).withColumn(PREDICTED, F.col("historical_revenue") * 0.1)


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, dtype in df.dtypes if dtype == "double"})


def regression_query(t: Marketplace) -> DataFrame:
    return _rounded(regression_report(with_trend_prediction(t)))


def error_query(t: Marketplace) -> DataFrame:
    columns = [PERSON, ACTUAL, PREDICTED, "error", "absolute_error", "absolute_percentage_error"]
    return _rounded(error_columns(with_trend_prediction(t)).select(*columns))


def error_profile_query(t: Marketplace) -> DataFrame:
    return _rounded(error_profile(with_trend_prediction(t)), 6)


def bands_query(t: Marketplace) -> DataFrame:
    banded = value_bands(stable(with_trend_prediction(t)))
    return banded.select(PERSON, PREDICTED, "predicted_value_rank", "predicted_value_band")


def band_summary_query(t: Marketplace) -> DataFrame:
    return _rounded(band_summary(value_bands(stable(with_trend_prediction(t)))))


def calibration_query(t: Marketplace) -> DataFrame:
    return _rounded(calibration(with_trend_prediction(t)))


def balance_query(t: Marketplace) -> DataFrame:
    return target_balance(modelling_set(t))


def validation_query(t: Marketplace) -> DataFrame:
    return validate_scoring_input(modelling_set(t), FEATURES)


def fixed_bands_query(t: Marketplace) -> DataFrame:
    banded = modelling_set(t).select(fixed_value_band("historical_revenue").alias("band"))
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("customers"))


#: The last fitted model by session and input, so that the queries about it share one fit.
_FITTED: dict[tuple, tuple[ValueModel, DataFrame]] = {}


def fitted(t: Marketplace, **options) -> tuple[ValueModel, DataFrame]:
    """Model fitted on the hash split and the whole modelling set scored, once per session, input and options."""
    session = t.orders.sparkSession
    key = (session.sparkContext.applicationId, t.orders.semanticHash(), t.order_items.semanticHash(), t.customers.semanticHash(), *options.items())
    if key not in _FITTED:
        data = stable(modelling_set(t))
        train, _ = hash_split(data, PERSON)
        model = fit_clv(train, **options)
        _FITTED.clear()
        _FITTED[key] = model, stable(score(model, data, keep_log=True))
    return _FITTED[key]


def scored_query(t: Marketplace) -> DataFrame:
    """k3_6: scored persons; of the prediction itself only what holds for any fit."""
    scored = fitted(t)[1]
    return scored.select(PERSON, *FEATURES, ACTUAL, (F.col(PREDICTED) >= 0).alias("predicted_valid"))


def importance_query(t: Marketplace) -> DataFrame:
    """k3_10: every feature has a share, and the shares add up to one."""
    shares = importance(fitted(t)[0])
    total = shares.agg(F.sum("importance")).head()[0]
    valid = F.col("importance").between(0, 1) & F.lit(abs(total - 1) < 1e-9)
    return shares.select("feature", valid.alias("share_valid"))


def metrics_query(t: Marketplace) -> DataFrame:
    """k3_5: metrics of the held-out persons, each with the condition that binds it to the others."""
    _, scored = fitted(t)
    report = stable(regression_report(hash_split(scored, PERSON)[1]))
    value = {r["metric"]: r["value"] for r in report.collect()}
    holds = {
        "MAE": 0 <= value["MAE"] <= value["RMSE"] + 1e-9,
        "RMSE": value["RMSE"] >= 0,
        "R2": value["R2"] is None or value["R2"] <= 1,
        "Mean Predicted Future Revenue": value["Mean Predicted Future Revenue"] >= 0,
    }
    bound = F.create_map(*(F.lit(x) for kv in holds.items() for x in kv))
    return report.select("metric", F.coalesce(F.try_element_at(bound, F.col("metric")), F.col("value") >= 0).alias("holds"))


QUERIES = {
    "fq02_cutoff": order_cutoff,
    "fq03_modelling_set": dataset_table,
    "k3_3_value_features": modelling_set,
    "k3_5_model_metrics": metrics_query,
    "k3_6_scored_customers": scored_query,
    "k3_7_scoring_validation": validation_query,
    "k3_8_regression_report": regression_query,
    "k3_9_error_columns": error_query,
    "k3_9_error_profile": error_profile_query,
    "k3_10_importance": importance_query,
    "k3_11_value_bands": bands_query,
    "k3_11_band_summary": band_summary_query,
    "k3_12_calibration": calibration_query,
    "k3_13_fixed_bands": fixed_bands_query,
    "k3_14_target_balance": balance_query,
}
