"""Additive attribution of boosted-tree predictions, and reports over attributions.

Contributions are in the model's log-revenue space: ``base_value`` plus the
contributions of a row equals ``model_output``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlight.functions.columns import count_where
from martlight.operators.checks import concat_reports
from martlight.operators.impute import clean_numeric, impute_median, validate_scoring_input
from martlight.operators.ordering import quantiles_of, top_k
from martlight.plans.value import ACTUAL, FEATURES, PREDICTED, ValueModel, fitted, modelling_set
from martlight.session import ensure_checkpoint_dir, stable
from martlight.sources.tables import Marketplace

PERSON = "customer_unique_id"


# ---- the model as leaf tables -----------------------------------------------


def tree_nodes(model: ValueModel, spark) -> pd.DataFrame:
    """Nodes of all trees with weights; its size is set by the model, not by the data."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/trees-{uuid.uuid4().hex}"
    model.trees.write().save(folder)
    saved = spark.read.parquet(f"{folder}/data")
    saved = saved.select("treeID", "nodeData.*") if "nodeData" in saved.columns else saved
    nodes = saved.select(
        F.col("treeID").alias("tree"),
        "id",
        "prediction",
        F.col("rawCount").alias("cover"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
    ).toPandas()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    nodes["weight"] = nodes["tree"].map(dict(enumerate(model.trees.treeWeights)))
    return nodes


def leaf_paths(nodes: pd.DataFrame) -> list[tuple]:
    """Per leaf: features on its path, their lower and upper limits, cover shares, weighted value."""
    leaves = []
    for _, tree in nodes.groupby("tree"):
        rows = {row.id: row for row in tree.itertuples(index=False)}
        stack = [(0, {})]
        while stack:
            at, path = stack.pop()
            node = rows[at]
            if node.left < 0:
                names = list(path)
                low, high, share = (np.array([path[f][i] for f in names], dtype=float) for i in range(3))
                leaves.append((names, low, high, share, node.prediction * node.weight))
                continue
            low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
            for child, limits in (
                (node.left, (low, min(high, node.threshold))),
                (node.right, (max(low, node.threshold), high)),
            ):
                part = share * rows[child].cover / node.cover
                stack.append((child, {**path, node.feature: (*limits, part)}))
    return leaves


def shapley(share: np.ndarray, satisfied: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Contribution of every path feature of leaves with paths of one length.

    ``share`` and ``satisfied`` have the features on their last axis and are broadcast against each other; ``value``
    lacks it.  Per feature, the polynomial over the others whose k-th coefficient sums the coalitions of size k is
    built factor by factor, for all leaves and patterns at once.
    """
    size = share.shape[-1]
    weights = np.array([factorial(k) * factorial(size - 1 - k) / factorial(size) for k in range(size)])
    shape = np.broadcast_shapes(share.shape, satisfied.shape)
    out = np.empty(shape)
    for j in range(size):
        mixed = np.zeros((*shape[:-1], size))
        mixed[..., 0] = 1.0
        for i in range(size):
            if i != j:
                grown = mixed * share[..., i, None]
                grown[..., 1:] += mixed[..., :-1] * satisfied[..., i, None]
                mixed = grown
        out[..., j] = value * (satisfied[..., j] - share[..., j]) * (mixed @ weights)
    return out


@dataclass(frozen=True)
class Leaves:
    """Leaves with paths of one length: features, limits, shares (leaf x feature), values, and tables of contributions
    (leaf x pattern x feature) where they are small enough to be made beforehand."""

    names: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    table: np.ndarray | None


#: Bytes of all tables together up to which they are made; beyond, contributions are computed per row.
TABLE_BYTES = 256 << 20
#: Numbers handled at once in a task.
CHUNK = 1 << 20


def group_leaves(paths: list[tuple], table_bytes: int = TABLE_BYTES) -> list[Leaves]:
    by_size: dict[int, list[tuple]] = {}
    for path in paths:
        if path[0]:
            by_size.setdefault(len(path[0]), []).append(path)
    needed = sum(len(group) * 2**size * size * 8 for size, group in by_size.items())
    found = []
    for size, group in sorted(by_size.items()):
        names, low, high, share = (np.array([p[i] for p in group]) for i in range(4))
        value = np.array([p[4] for p in group], dtype=float)
        table = None
        if needed <= table_bytes:
            patterns = (np.arange(2**size)[:, None] >> np.arange(size) & 1).astype(float)
            table = shapley(share[:, None, :], patterns[None], value[:, None])
        found.append(Leaves(names.astype(int), low, high, share, value, table))
    return found


def contributions(matrix: np.ndarray, groups: list[Leaves]) -> np.ndarray:
    """Row by feature contributions of one batch."""
    out = np.zeros(matrix.shape)
    for g in groups:
        leaves, size = g.names.shape
        place = np.zeros((leaves * size, matrix.shape[1]))
        place[np.arange(leaves * size), g.names.ravel()] = 1.0
        step = max(1, CHUNK // (leaves * size))
        for at in range(0, len(matrix), step):
            values = matrix[at : at + step][:, g.names]
            inside = (values > g.low) & (values <= g.high)
            if g.table is not None:
                found = g.table[np.arange(leaves)[None], inside @ (1 << np.arange(size))]
            else:
                found = shapley(g.share[None], inside.astype(float), g.value[None])
            out[at : at + step] += found.reshape(len(values), -1) @ place
    return out


def attribute(model: ValueModel, df: DataFrame) -> DataFrame:
    """Input columns plus ``shap_<feature>`` columns, ``base_value`` and ``model_output``.

    What is sent to the executors depends on the model alone and is bounded by ``TABLE_BYTES``.
    """
    spark = df.sparkSession
    paths = leaf_paths(tree_nodes(model, spark))
    base = float(sum(np.prod(share) * value for _, _, _, share, value in paths))
    shared = spark.sparkContext.broadcast(group_leaves(paths))
    features = list(model.features)
    shap = [f"shap_{c}" for c in features]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix = batch[[f"_feature_{c}" for c in features]].to_numpy(dtype=float)
            found = contributions(matrix, shared.value)
            result = batch.drop(columns=[f"_feature_{c}" for c in features])
            result[shap] = found
            result["base_value"] = base
            result["model_output"] = base + found.sum(axis=1)
            yield result

    prepared = df.withColumns({f"_feature_{c}": F.col(c) for c in features})
    prepared = clean_numeric(prepared, [f"_feature_{c}" for c in features])
    prepared = impute_median(prepared, [f"_feature_{c}" for c in features])
    added = ", ".join(f"`{c}` double" for c in [*shap, "base_value", "model_output"])
    schema = ", ".join(f"`{c}` {dtype}" for c, dtype in df.dtypes) + ", " + added
    return prepared.mapInPandas(run, schema)


# ---- reports over attribution tables ----------------------------------------


def attribution_wide(df: DataFrame, features: Sequence[str] = FEATURES, extra: Sequence[str] = ()) -> DataFrame:
    """The saved table: person, contributions, prediction and actual, and ``extra`` columns."""
    return df.select(PERSON, *[f"shap_{c}" for c in features], PREDICTED, ACTUAL, *extra)


def attribution_long(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(person, feature, feature_value, shap_value)."""
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("feature_value"),
            F.col(f"shap_{c}").alias("shap_value"),
        )
        for c in features
    ]
    return df.select(PERSON, F.inline(F.array(*entries)))


def attribution_summary(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean absolute, mean, smallest and largest contribution per feature."""
    packed = []
    for c in features:
        value = F.col(f"shap_{c}")
        packed.append(
            F.struct(
                F.avg(F.abs(value)).alias("mean_abs_shap"),
                F.avg(value).alias("mean_shap"),
                F.min(value).alias("min_shap"),
                F.max(value).alias("max_shap"),
            ).alias(c)
        )
    wide = df.agg(*packed).unpivot([], list(features), "feature", "stats")
    return wide.select("feature", "stats.*").orderBy(F.desc("mean_abs_shap"), "feature")


def global_importance(df: DataFrame, n: int = 10, features: Sequence[str] = FEATURES) -> DataFrame:
    """Features by mean absolute contribution."""
    if not 1 <= n <= 50:
        raise ValueError("n counts features: 1 to 50")
    return attribution_summary(df, features).select("feature", "mean_abs_shap").limit(n)


def top_drivers(
    df: DataFrame, n: int = 5, by: str = "sign", signed: bool = True, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Strongest features per person; ties by feature name.

    ``by="sign"`` lists the ``n`` largest as positive and the ``n`` smallest as negative
    drivers (only values of that sign if ``signed``); ``by="abs"`` the ``n`` largest by
    size.  Sorting happens inside the row, so there is no exchange.
    """
    if not 1 <= n <= 20:
        raise ValueError("n counts drivers: 1 to 20")

    def listed(key, keep=None):
        entries = F.array(
            *[
                F.struct(key(F.col(f"shap_{c}")).alias("k"), F.lit(c).alias("feature"), F.col(f"shap_{c}").alias("shap_value"))
                for c in features
            ]
        )
        if keep is not None:
            entries = F.filter(entries, lambda e: keep(e["shap_value"]))
        return F.slice(F.array_sort(entries), 1, n)

    if by == "abs":
        sides = {"absolute": listed(lambda v: -F.abs(v))}
    else:
        sides = {
            "positive": listed(lambda v: -v, (lambda v: v > 0) if signed else None),
            "negative": listed(lambda v: v, (lambda v: v < 0) if signed else None),
        }
    rows = [
        df.select(PERSON, F.lit(side).alias("direction"), F.posexplode(entries)).select(
            PERSON, "direction", (F.col("pos") + 1).alias("rank"), "col.feature", "col.shap_value"
        )
        for side, entries in sides.items()
    ]
    return concat_reports(rows)


def inactive_high_value(df: DataFrame, n: int | None = 1, recency: str = "recency_days") -> DataFrame:
    """Rows at or above the 75th percentile of value and of recency, most valuable first."""
    if n is not None and not 1 <= n <= 500:
        raise ValueError("n counts persons: 1 to 500, or None for all")
    cuts = quantiles_of(df, {PREDICTED: {"value_cut": 0.75}, recency: {"recency_cut": 0.75}})
    value_cut, recency_cut = (cuts.select(name).scalar() for name in cuts.columns)
    found = df.where((F.col(PREDICTED) >= value_cut) & (F.col(recency) >= recency_cut))
    return top_k(found, [F.desc(PREDICTED), F.col(PERSON)], n) if n else found


def dependence(df: DataFrame, features: Sequence[str], bins: int = 20) -> DataFrame:
    """Mean contribution per equal-width bin of the feature value."""
    long = attribution_long(df, features)
    spans = long.groupBy("feature").agg(F.min("feature_value").alias("low"), F.max("feature_value").alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    place = F.when(width > 0, F.floor((F.col("feature_value") - F.col("low")) / width))
    value_bin = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1).cast("long")).cast("int")
    return (
        long.join(spans, "feature")
        .groupBy("feature", value_bin.alias("value_bin"))
        .agg(F.avg("shap_value").alias("avg_shap"), F.count(F.lit(1)).alias("count"))
    )


def completeness(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Rows, persons, contribution columns and missing contributions."""
    missing = sum((count_where(F.col(f"shap_{c}").isNull()) for c in features), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("shap_customer_rows"),
        F.countDistinct(PERSON).alias("unique_customers"),
        F.lit(len(features)).alias("shap_feature_columns"),
        missing.cast("long").alias("missing_shap_values"),
    )


# ---- registered queries -----------------------------------------------------


def attribution_query(t: Marketplace) -> DataFrame:
    """k4_1, k4_2: the saved table's persons; the contributions add up to the model's own output."""
    model, scored = fitted(t)
    found = attribute(model, scored)
    wide = attribution_wide(found.withColumn("gap", F.abs(F.col("model_output") - F.col("prediction"))), extra=["gap"])
    complete = reduce(lambda a, b: a & b, (F.col(f"shap_{c}").isNotNull() for c in FEATURES))
    return wide.select(PERSON, (complete & (F.col("gap") < 1e-8)).alias("additive"), ACTUAL)


def with_step_attribution(t: Marketplace) -> DataFrame:
    """Contributions cut from the feature values, for comparing the reports without a model."""
    base = modelling_set(t).withColumn(PREDICTED, F.col("historical_revenue") * 0.1)
    return base.withColumns(
        {f"shap_{c}": (F.floor(F.col(c) * 100) % 7 - 3).cast("double") / F.lit(10.0) for c in FEATURES}
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def importance_query(t: Marketplace) -> DataFrame:
    return _rounded(global_importance(with_step_attribution(t)), "mean_abs_shap")


def summary_query(t: Marketplace) -> DataFrame:
    return _rounded(attribution_summary(with_step_attribution(t)), "mean_abs_shap", "mean_shap")


def drivers_query(t: Marketplace) -> DataFrame:
    return top_drivers(with_step_attribution(t), 3)


def drivers_unsigned_query(t: Marketplace) -> DataFrame:
    return top_drivers(with_step_attribution(t), 3, signed=False)


def drivers_abs_query(t: Marketplace) -> DataFrame:
    return top_drivers(with_step_attribution(t), 5, by="abs")


def strict_validation_query(t: Marketplace) -> DataFrame:
    return validate_scoring_input(modelling_set(t), FEATURES, strict=True)


def inactive_query(t: Marketplace) -> DataFrame:
    scored = stable(with_step_attribution(t))
    return inactive_high_value(scored, 1, "historical_recency_days").select(
        PERSON, PREDICTED, "historical_recency_days"
    )


def dependence_query(t: Marketplace) -> DataFrame:
    """Top five features by global importance (a report of eight rows is read to pick them)."""
    data = stable(with_step_attribution(t))
    top = [row["feature"] for row in global_importance(data, 5).collect()]
    return _rounded(dependence(data, top), "avg_shap")


def completeness_query(t: Marketplace) -> DataFrame:
    return completeness(with_step_attribution(t))


QUERIES = {
    "k4_1_attribution": attribution_query,
    "k4_3_global_importance": importance_query,
    "k4_4_attribution_summary": summary_query,
    "k4_5_top_drivers": drivers_query,
    "k4_5_top_drivers_unsigned": drivers_unsigned_query,
    "k4_6_top_drivers_absolute": drivers_abs_query,
    "k4_7_strict_validation": strict_validation_query,
    "k4_8_inactive_high_value": inactive_query,
    "k4_9_dependence": dependence_query,
    "k7_8_attribution_completeness": completeness_query,
}
