"""Profiles, integrity checks, frequency tables and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlight.functions.columns import count_where, share_ratio
from martlight.operators.ordering import quantiles_of


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def label_union(counts: dict[str, DataFrame], label: str, value: str) -> DataFrame:
    """One-row, one-column tables stacked under their labels."""
    rows = [df.toDF(value).select(F.lit(name).alias(label), value) for name, df in counts.items()]
    return reduce(DataFrame.unionByName, rows)


def concat_reports(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def duplicate_keys(df: DataFrame, keys: Sequence[str], out: str = "duplicate_count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).where(F.col(out) > 1)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows without a parent (a null key has none)."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def orphan_count(child: DataFrame, key: str, parent: DataFrame, parent_key: str, out: str) -> DataFrame:
    """Orphan rows, counted per key first so that a hot key costs one row in the join."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return orphans(per_key, key, parent, parent_key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(out))


def missing_parent_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Different non-null child keys that are not in the parent."""
    keys = child.select(key).where(F.col(key).isNotNull()).distinct()
    return row_count(orphans(keys, key, parent, parent_key))


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Different keys of ``a`` that ``b`` does not have."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def key_common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Different keys both tables have."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def coverage(tables: dict[str, DataFrame], base: DataFrame, key: str) -> DataFrame:
    """Per table: different keys, keys unknown to ``base`` and the covered percentage."""
    known = base.select(key, F.lit(1).alias("known")).distinct()
    reports = []
    for name, df in tables.items():
        marked = df.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left")
        reports.append(
            marked.agg(
                F.lit(name).alias("artifact"),
                F.count(F.lit(1)).alias("customers"),
                count_where(F.col("known").isNull()).alias("missing_from_feature_table"),
                F.coalesce(share_ratio(F.count("known"), F.count(F.lit(1))), F.lit(0.0)).alias("coverage_pct"),
            )
        )
    return concat_reports(reports)


def profile_nulls(df: DataFrame) -> DataFrame:
    """Per column: type, missing values and their percentage, from one pass."""
    packed = [
        F.struct(
            F.lit(dtype).alias("dtype"),
            count_where(F.col(f"`{name}`").isNull()).alias("missing"),
            F.count(F.lit(1)).alias("rows"),
        ).alias(name)
        for name, dtype in df.dtypes
    ]
    wide = df.agg(*packed).unpivot([], [f"`{c}`" for c in df.columns], "column_name", "stats")
    pct = F.coalesce(share_ratio("stats.missing", "stats.rows"), F.lit(0.0))
    return wide.select("column_name", "stats.dtype", "stats.missing", pct.alias("missing_pct"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column."""
    counts = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return counts.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, different keys and rows beyond the first of their key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"),
    )


def value_counts(df: DataFrame, column: str, n: int | None = 20, dropna: bool = False) -> DataFrame:
    """Most frequent values, as text, ties by value."""
    source = df.where(F.col(column).isNotNull()) if dropna else df
    counts = source.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    return ordered.limit(n) if n else ordered


def value_counts_fixed(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Counts for a fixed list of levels in its order, 0 where a level is absent, with percentages."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_all"), *[count_where(F.col(column) == level).alias(level) for level in levels]
    )
    entries = [
        F.struct(F.lit(i).alias("place"), F.lit(v).alias(column), F.col(f"`{v}`").alias("customers"))
        for i, v in enumerate(levels)
    ]
    rows = counts.select("_all", F.inline(F.array(*entries)))
    return rows.orderBy("place").select(
        column, "customers", F.coalesce(share_ratio("customers", "_all"), F.lit(0.0)).alias("percentage")
    )


def crosstab_pct(df: DataFrame, rows: str, columns: str, levels: Sequence[str]) -> DataFrame:
    """Row percentages of ``columns`` within ``rows``; the levels are given, so the plan needs no extra job."""
    counts = df.groupBy(rows).agg(
        F.count(columns).alias("_n"), *[count_where(F.col(columns) == v).alias(v) for v in levels]
    )
    shares = [share_ratio(F.col(f"`{v}`"), F.col("_n")).alias(v) for v in levels]
    return counts.select(rows, *shares).orderBy(rows)


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample standard deviation, minimum, quartiles and maximum per column."""
    points = {c: {f"{c}|25": 0.25, f"{c}|50": 0.5, f"{c}|75": 0.75} for c in columns}
    quartiles = quantiles_of(df, points)
    packed = quartiles.select(F.struct(*[f"`{c}`" for c in quartiles.columns])).scalar()
    stats = []
    for name in columns:
        value = F.col(name).cast("double")
        stats.append(
            F.struct(
                F.count(value).alias("count"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
            ).alias(name)
        )
    wide = df.agg(*stats).withColumn("q", packed)
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            *[F.col(f"`{name}`")[part].alias(part) for part in ("count", "mean", "std", "min")],
            *[F.col("q")[f"{name}|{p}"].alias(f"p{p}") for p in (25, 50, 75)],
            F.col(f"`{name}`")["max"].alias("max"),
        )
        for name in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, bins: int, log1p: bool = False) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin includes the maximum."""
    value = F.col(column).cast("double")
    value = F.log1p(value) if log1p else value
    data = df.select(value.alias("v")).where(F.col("v").isNotNull())
    span = data.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")))
    placed = data.withColumn("span", span.scalar())
    width = (F.col("span.high") - F.col("span.low")) / F.lit(float(bins))
    place = F.when(F.col("span.high") > F.col("span.low"), F.floor((F.col("v") - F.col("span.low")) / width))
    bin_no = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1).cast("long")).cast("int")
    return (
        placed.groupBy(bin_no.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.first("span.low").alias("low"),
            F.first(width).alias("width"),
        )
        .select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"), "count")
        .orderBy("bin")
    )


def share_of_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percentage of the column total, for report-sized tables."""
    return df.withColumn(out, share_ratio(value, F.sum(value).over(Window.partitionBy())))
