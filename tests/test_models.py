"""Scoring input, metrics, boosted trees, attribution and segmentation."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from martlight.operators.impute import clean_numeric, impute_median, split_valid, validate_scoring_input
from martlight.plans import attribution as a
from martlight.plans import segments as s
from martlight.plans import value as v


@pytest.fixture(scope="module")
def fitted(star):
    return v.fitted(star, trees=4)


def test_missing_feature(spark):
    with pytest.raises(ValueError, match="Missing required prediction features"):
        validate_scoring_input(spark.createDataFrame([(1,)], "feature_a int"), ["feature_a", "feature_b"])


def test_text_and_null_are_prepared(spark):
    frame = spark.createDataFrame([("1.0", None), ("2.0", "4.0")], "feature_a string, feature_b string")
    names = ["feature_a", "feature_b"]
    rows = impute_median(clean_numeric(frame, names), names).orderBy("feature_a").collect()
    assert [tuple(r) for r in rows] == [(1.0, 4.0), (2.0, 4.0)]


def test_all_null_column(spark):
    frame = spark.createDataFrame([(None,), (None,)], "feature_a double")
    with pytest.raises(ValueError, match="Unable to prepare numeric values"):
        impute_median(frame, ["feature_a"])


def test_validation_report(spark):
    frame = spark.createDataFrame([("1", -2.0), ("x", float("nan")), (None, 3.0)], "a string, b double")
    report = {r["feature"]: (r["missing_or_non_numeric"], r["negative"]) for r in validate_scoring_input(frame, ["a", "b"]).collect()}
    assert report == {"a": (2, 0), "b": (1, 1)}
    with pytest.raises(ValueError):
        validate_scoring_input(frame, ["a"], strict=True)
    good, bad = split_valid(frame, ["a", "b"])
    assert (good.count(), bad.count()) == (0, 3)


def test_report_without_variance(spark):
    frame = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "future_revenue double, predicted_future_revenue double")
    report = {r["metric"]: r["value"] for r in v.regression_report(frame).collect()}
    assert report["R2"] is None and report["MAE"] == 1.0 and report["RMSE"] == 1.0


def test_split_is_stable(star):
    data = v.modelling_set(star)
    train, test = v.hash_split(data, v.PERSON)
    again = v.hash_split(data.repartition(7), v.PERSON)[0]
    assert train.count() + test.count() == data.count()
    assert train.select(v.PERSON).exceptAll(again.select(v.PERSON)).isEmpty()


def test_scores_are_not_negative_and_keep_rows(fitted, star):
    _, scored = fitted
    assert scored.count() == v.modelling_set(star).count()
    assert scored.where(F.col(v.PREDICTED) < 0).isEmpty()
    assert v.importance(fitted[0]).count() == len(v.FEATURES)


def test_trees_keep_no_node_table_and_are_the_same(star, monkeypatch):
    data = v.stable(v.modelling_set(star))
    model = v.fit_clv(data, trees=2, depth=3).trees
    assert not model.getCacheNodeIds()
    monkeypatch.setattr(v, "GBTRegressor", lambda **options: GBTRegressor(**options | {"cacheNodeIds": True}))
    assert v.fit_clv(data, trees=2, depth=3).trees.toDebugString.split("\n")[1:] == model.toDebugString.split("\n")[1:]


def test_attribution_adds_up(fitted):
    model, scored = fitted
    rows = a.attribute(model, scored).withColumn(
        "gap",
        F.abs(F.col("base_value") + sum(F.col(f"shap_{c}") for c in v.FEATURES) - F.col("prediction")),
    )
    assert rows.agg(F.max("gap")).head()[0] < 1e-8
    assert rows.where(F.abs(F.col("model_output") - F.col("prediction")) > 1e-8).isEmpty()


def test_attribution_equals_coalitions(spark, fitted):
    """Shapley values by enumeration of feature sets over the same trees."""
    model, scored = fitted
    nodes = a.tree_nodes(model, spark)
    trees = [{n.id: n for n in t.itertuples(index=False)} for _, t in nodes.groupby("tree")]

    def expected(tree, row, known, at=0):
        node = tree[at]
        if node.left < 0:
            return node.prediction * node.weight
        if node.feature in known:
            return expected(tree, row, known, node.left if row[node.feature] <= node.threshold else node.right)
        return sum(tree[c].cover / node.cover * expected(tree, row, known, c) for c in (node.left, node.right))

    attributed = a.attribute(model, scored).orderBy(v.PERSON).limit(3).collect()
    size = len(v.FEATURES)
    for record in attributed:
        row = [float(record[c]) for c in v.FEATURES]
        value = {}
        for k in range(size + 1):
            for known in combinations(range(size), k):
                value[known] = sum(expected(t, row, known) for t in trees)
        for j, name in enumerate(v.FEATURES):
            others = [i for i in range(size) if i != j]
            phi = 0.0
            for k in range(size):
                weight = factorial(k) * factorial(size - k - 1) / factorial(size)
                for known in combinations(others, k):
                    phi += weight * (value[tuple(sorted((*known, j)))] - value[known])
            assert abs(phi - record[f"shap_{name}"]) < 1e-9


def test_driver_limits(fitted):
    with pytest.raises(ValueError):
        a.top_drivers(fitted[1], 0)
    with pytest.raises(ValueError):
        a.inactive_high_value(fitted[1], 501)


def profile(spark, rows):
    return spark.createDataFrame(rows, "cluster_id int, average_revenue double, average_recency_days double")


def test_cluster_labels(spark):
    labels = s.label_clusters(profile(spark, [(0, 10.0, 5.0), (1, 90.0, 30.0), (2, 50.0, 80.0), (3, 20.0, 40.0)]))
    assert labels == {0: "Recently Active", 1: "High Value", 2: "At Risk High Value", 3: "Core / Developing"}


def test_oldest_is_most_valuable_leaves_no_risk_label(spark):
    labels = s.label_clusters(profile(spark, [(0, 10.0, 5.0), (1, 90.0, 99.0), (2, 50.0, 80.0)]))
    assert labels == {0: "Recently Active", 1: "High Value", 2: "Core / Developing"}


def test_segmentation_finds_separated_groups(spark):
    rng = np.random.default_rng(1)
    centre = np.where(np.arange(120) % 2, 1.0, 400.0)
    rows = [(i, *[float(centre[i] + x) for x in rng.random(len(s.CLUSTER_FEATURES))]) for i in range(120)]
    schema = "customer_unique_id int, " + ", ".join(f"{c} double" for c in s.CLUSTER_FEATURES)
    features = spark.createDataFrame(rows, schema)
    model = s.fit_segments(features, k_range=range(2, 4), restarts=2)
    assert model.k == 2 and max(model.silhouette.values()) > 0.9
    sizes = s.assign_segments(model, features).groupBy("segment").count().collect()
    assert sorted(r["count"] for r in sizes) == [60, 60]


def test_starts_side_by_side_overlap_and_equal_single_ones(spark, monkeypatch):
    import threading

    rows = [(float(i % 5 * 10 + i % 3), float(i % 5 * 7)) for i in range(200)]
    df = s.VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(rows, "x double, y double"))
    scaled = s.for_fitting(df).persist()
    assert scaled.rdd.getNumPartitions() == 1 and s.for_fitting(df.repartition(6), rows=50).rdd.getNumPartitions() == 4
    meet, fit = threading.Barrier(2, timeout=60), s.KMeans.fit
    one = s.fit_kmeans(scaled, [2, 5], restarts=2, parallel=1)
    monkeypatch.setattr(s.KMeans, "fit", lambda self, data: (meet.wait(), fit(self, data))[1])
    two = s.fit_kmeans(scaled, [2, 5], restarts=2, parallel=2)
    for k in (2, 5):
        assert [c.tolist() for c in one[k].clusterCenters()] == [c.tolist() for c in two[k].clusterCenters()]
