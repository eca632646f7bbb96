"""Customer segmentation: feature matrix, k-means with chosen k, profiles and labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlight.functions.columns import clip_zero, label_map
from martlight.operators.checks import crosstab_pct
from martlight.operators.impute import clean_numeric, impute_median
from martlight.plans.features import features_table
from martlight.session import for_fitting, stable
from martlight.sources.tables import Marketplace, require_columns

PERSON = "customer_unique_id"

# fixed values: clustering features, the skewed ones among them, and the labels
CLUSTER_FEATURES = [
    "recency_days",
    "order_count",
    "total_revenue",
    "total_items",
    "unique_products_purchased",
    "average_order_value",
    "average_review_score",
    "negative_review_rate",
    "average_delivery_days",
    "average_delivery_vs_estimate_days",
]
LOG_FEATURES = [
    "recency_days",
    "order_count",
    "total_revenue",
    "total_items",
    "unique_products_purchased",
    "average_order_value",
    "average_delivery_days",
]
RFM_SEGMENTS = ["Champions", "Loyal Active", "At Risk High Value", "High Value", "Needs Attention"]
#: Starts of k-means that run side by side, as folds do in Spark's own cross-validation.
PARALLEL = 8
CLUSTER_SEGMENTS = ["High Value", "At Risk High Value", "Recently Active", "Core / Developing"]


def log_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(clip_zero(c)) for c in columns})


def cluster_matrix(features: DataFrame) -> DataFrame:
    """Person and the ten clustering features, imputed and with the skewed ones on a log scale."""
    require_columns(features, [PERSON, *CLUSTER_FEATURES], "feature table")
    matrix = clean_numeric(features.select(PERSON, *CLUSTER_FEATURES), CLUSTER_FEATURES)
    return log_scale(impute_median(matrix, CLUSTER_FEATURES), LOG_FEATURES)


def standardize(df: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """Fitted assembling and z-scoring (sample deviation: a common factor, so clusters are the same)."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return PipelineModel([assembler, scaler.fit(assembler.transform(df))])


@dataclass(frozen=True)
class SegmentModel:
    scaler: PipelineModel
    clusters: KMeansModel
    k: int
    silhouette: dict[int, float]
    iterations: int = 0
    measure: str = "squaredEuclidean"


def fit_kmeans(
    scaled: DataFrame, ks: Iterable[int], restarts: int = 10, seed: int = 42, iterations: int = 300, parallel: int = PARALLEL
) -> dict[int, KMeansModel]:
    """Per k the best of ``restarts`` starts by training cost; a start ends when its centres rest.

    A step of one start is a short job, so ``parallel`` starts share the cluster; each is the same as by itself.
    """
    starts = [(k, i) for k in ks for i in range(restarts)]

    def run(start: tuple[int, int]) -> KMeansModel:
        k, i = start
        return KMeans(k=k, seed=seed + i, maxIter=iterations, featuresCol="features").fit(scaled)

    with ThreadPool(min(parallel, len(starts))) as pool:
        fits = pool.map(inheritable_thread_target(scaled.sparkSession)(run), starts, chunksize=1)
    found: dict[int, list[KMeansModel]] = {}
    for (k, _), model in zip(starts, fits):
        found.setdefault(k, []).append(model)
    return {k: min(models, key=lambda m: m.summary.trainingCost) for k, models in found.items()}


def fit_segments(
    features: DataFrame, k_range: Iterable[int] = range(2, 9), restarts: int = 10, seed: int = 42
) -> SegmentModel:
    """k-means for every k; the k with the best silhouette is kept, the smallest one on ties."""
    matrix = stable(cluster_matrix(features))
    scaler = standardize(matrix, CLUSTER_FEATURES)
    scaled = for_fitting(scaler.transform(matrix).select(PERSON, "features")).persist()
    try:
        evaluator = ClusteringEvaluator(featuresCol="features", metricName="silhouette")
        fits = fit_kmeans(scaled, k_range, restarts, seed)
        silhouette = {k: evaluator.evaluate(m.transform(scaled)) for k, m in fits.items()}
    finally:
        scaled.unpersist()
    best = max(fits, key=lambda k: (silhouette[k], -k))
    return SegmentModel(scaler, fits[best], best, silhouette, fits[best].summary.numIter)


def assign_clusters(model: SegmentModel, features: DataFrame) -> DataFrame:
    scaled = model.scaler.transform(cluster_matrix(features))
    assigned = model.clusters.transform(scaled).select(PERSON, F.col("prediction").alias("cluster_id"))
    return features.join(assigned, PERSON)


def cluster_profile(df: DataFrame) -> DataFrame:
    """Counts, means and shares per cluster."""
    profile = df.groupBy("cluster_id").agg(
        F.count(PERSON).alias("customers"),
        F.avg("recency_days").alias("average_recency_days"),
        F.avg("order_count").alias("average_orders"),
        F.avg("total_revenue").alias("average_revenue"),
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("average_order_value").alias("average_order_value"),
        F.avg("total_items").alias("average_items"),
        F.avg("unique_products_purchased").alias("average_unique_products"),
        F.avg("average_review_score").alias("average_review_score"),
        F.avg("average_delivery_days").alias("average_delivery_days"),
    )
    return with_shares(profile).orderBy(F.desc("total_revenue"), "cluster_id")


def with_shares(profile: DataFrame) -> DataFrame:
    """Customer and revenue percentages of a report-sized table; 0 where the total is 0."""
    whole = Window.partitionBy()

    def share(column: str) -> Column:
        total = F.nullif(F.sum(column).over(whole).cast("double"), F.lit(0.0))
        return F.coalesce(F.col(column) * 100 / total, F.lit(0.0))

    return profile.withColumns(
        {"customer_share_pct": share("customers"), "revenue_share_pct": share("total_revenue")}
    )


def label_clusters(profile: DataFrame) -> dict[int, str]:
    """Labels from a profile of at most eight rows; ties go to the smaller cluster id.

    The oldest cluster with at least median revenue is at risk unless it is also the
    most valuable one, in which case no cluster is.
    """
    rows = profile.select("cluster_id", "average_revenue", "average_recency_days").collect()
    rows = sorted(rows, key=lambda r: r["cluster_id"])
    revenue = sorted(r["average_revenue"] for r in rows)
    middle = (revenue[(len(revenue) - 1) // 2] + revenue[len(revenue) // 2]) / 2
    highest = max(rows, key=lambda r: r["average_revenue"])["cluster_id"]
    recent = min(rows, key=lambda r: r["average_recency_days"])["cluster_id"]
    valued = [r for r in rows if r["average_revenue"] >= middle]
    oldest = max(valued, key=lambda r: r["average_recency_days"])["cluster_id"]
    labels = {r["cluster_id"]: "Core / Developing" for r in rows}
    labels[recent] = "Recently Active"
    labels[oldest] = "At Risk High Value"
    labels[highest] = "High Value"
    return labels


def assign_segments(model: SegmentModel, features: DataFrame) -> DataFrame:
    """Features with cluster id and business label."""
    assigned = stable(assign_clusters(model, features))
    labels = label_clusters(cluster_profile(assigned))
    return assigned.withColumn("segment", label_map("cluster_id", labels))


def segment_summary(df: DataFrame, keys: Sequence[str] = ("cluster_id", "segment")) -> DataFrame:
    """Counts, means and shares per segment."""
    summary = df.groupBy(*keys).agg(
        F.count(PERSON).alias("customers"),
        F.avg("recency_days").alias("average_recency_days"),
        F.avg("order_count").alias("average_orders"),
        F.avg("total_revenue").alias("average_revenue"),
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("average_order_value").alias("average_order_value"),
    )
    return with_shares(summary).orderBy(F.desc("total_revenue"), *keys)


def rfm_profile(df: DataFrame) -> DataFrame:
    """Business profile of the rule segments."""
    profile = df.groupBy("customer_segment").agg(
        F.count(PERSON).alias("customers"),
        F.avg("recency_days").alias("average_recency_days"),
        F.avg("order_count").alias("average_orders"),
        F.avg("total_revenue").alias("average_revenue"),
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("average_order_value").alias("average_order_value"),
        F.avg("average_review_score").alias("average_review_score"),
    )
    return with_shares(profile).drop("customer_share_pct").orderBy(F.desc("total_revenue"), "customer_segment")


def rfm_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy(F.col("customer_segment").alias("segment")).agg(F.count(F.lit(1)).alias("customer_count"))
    total = F.sum("customer_count").over(Window.partitionBy())
    share = F.round(F.col("customer_count") * 100 / total, 2)
    return counts.withColumn("percentage", share).orderBy(F.desc("customer_count"), "segment")


def rfm_by_cluster(df: DataFrame) -> DataFrame:
    return crosstab_pct(df, "customer_segment", "segment", CLUSTER_SEGMENTS)


# ---- registered queries -----------------------------------------------------


def rounded(df: DataFrame) -> DataFrame:
    """Doubles of a report without the noise of summation order: sums to 4 decimals, the rest to 6."""
    sums = ("total_", "predicted_")
    return df.withColumns(
        {c: F.round(c, 4 if c.startswith(sums) else 6) for c, dtype in df.dtypes if dtype == "double"}
    )


def with_rule_clusters(t: Marketplace) -> DataFrame:
    """Features with a rule in place of the fitted clusters, for comparing the reports without a model."""
    features = features_table(t)
    cluster = F.col("rfm_score") % 4
    return features.withColumn("cluster_id", cluster).withColumn(
        "segment", label_map("cluster_id", dict(enumerate(CLUSTER_SEGMENTS)))
    )


def matrix_query(t: Marketplace) -> DataFrame:
    matrix = cluster_matrix(features_table(t))
    return matrix.withColumns({c: F.round(c, 8) for c in CLUSTER_FEATURES})


def profile_query(t: Marketplace) -> DataFrame:
    return rounded(cluster_profile(with_rule_clusters(t)))


def summary_query(t: Marketplace) -> DataFrame:
    return rounded(segment_summary(with_rule_clusters(t)))


def labels_query(t: Marketplace) -> DataFrame:
    clustered = stable(with_rule_clusters(t))
    labels = label_clusters(cluster_profile(clustered))
    counts = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("customers"))
    return counts.select("cluster_id", label_map("cluster_id", labels).alias("segment"), "customers")


def rfm_profile_query(t: Marketplace) -> DataFrame:
    return rounded(rfm_profile(features_table(t)))


def rfm_distribution_query(t: Marketplace) -> DataFrame:
    return rfm_distribution(features_table(t))


def rfm_by_cluster_query(t: Marketplace) -> DataFrame:
    return rfm_by_cluster(with_rule_clusters(t))


#: The last fitted segments by session and input.
_FITTED: dict[tuple, tuple[SegmentModel, DataFrame]] = {}


def fitted_segments(t: Marketplace, **options) -> tuple[SegmentModel, DataFrame]:
    """Fitted segments and the features they rest on, once per session, input and options."""
    session = t.orders.sparkSession
    key = (session.sparkContext.applicationId, t.orders.semanticHash(), t.order_items.semanticHash(), t.customers.semanticHash(), *options.items())
    if key not in _FITTED:
        features = stable(features_table(t))
        _FITTED.clear()
        _FITTED[key] = fit_segments(features, **options), features
    return _FITTED[key]


def segments_query(t: Marketplace) -> DataFrame:
    """k2_4, k2_5: persons of the fitted segments; each is in the cluster of the nearest stored centre."""
    model, features = fitted_segments(t)
    scaled = model.scaler.transform(cluster_matrix(features))
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusters.clusterCenters()))
    apart = F.transform(
        centres,
        lambda c: F.aggregate(
            F.zip_with(vector_to_array("features"), c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x
        ),
    )
    assigned = model.clusters.transform(scaled).withColumn("apart", apart)
    own = F.element_at("apart", F.col("prediction") + 1)
    return assigned.select(PERSON, (own <= F.array_min("apart") + 1e-9).alias("nearest"))


QUERIES = {
    "k2_1_cluster_matrix": matrix_query,
    "k2_4_fitted_segments": segments_query,
    "k2_6_cluster_profile": profile_query,
    "k2_7_cluster_labels": labels_query,
    "k2_8_segment_summary": summary_query,
    "k2_8_rfm_profile": rfm_profile_query,
    "k2_8_rfm_distribution": rfm_distribution_query,
    "k2_8_rfm_by_cluster": rfm_by_cluster_query,
}
