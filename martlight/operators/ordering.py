"""Global and per-group order operators that never sort one key in one task.

A window without partition columns, or one partitioned by a hot key, puts all of
those rows into a single task.  Here the rows are range-partitioned on the full
sort order instead, so ties and hot keys are spread as well; each range computes
its local positions and sums, and the per-range totals (one row per range) are
added back as offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlight.session import stable

_RANGE = "_range"


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return df.repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id())


def ordered_prefix(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """Position and running sums of every row in the total order ``order``.

    Adds ``position`` (1-based), ``total_count`` and, for each column ``c`` of
    ``sums``, ``running_c`` (inclusive) and ``total_c``.  ``order`` must end in a
    unique key, otherwise ties are placed arbitrarily.
    """
    order = list(order)
    ranged = _ranged(df, order)
    if sums:
        in_range = Window.partitionBy(_RANGE).orderBy(*order)
        upto = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = ranged.withColumn("position", F.row_number().over(in_range).cast("long"))
        for name in sums:
            placed = placed.withColumn(f"running_{name}", F.sum(name).over(upto))
    else:
        # The low 33 bits count the rows of a partition, here in sorted order.
        index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        placed = ranged.sortWithinPartitions(*order).withColumn("position", index + 1)
    placed = stable(placed)

    # One row per range: as many rows as there are shuffle partitions.
    per_range = placed.groupBy(_RANGE).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(name).alias(f"sum_{name}") for name in sums]
    )
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = per_range.select(
        _RANGE,
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("rows").over(whole).alias("total_count"),
        *[F.coalesce(F.sum(f"sum_{name}").over(before), F.lit(0)).alias(f"before_{name}") for name in sums],
        *[F.sum(f"sum_{name}").over(whole).alias(f"total_{name}") for name in sums],
    )
    joined = placed.join(F.broadcast(offsets), _RANGE)
    shifted = {"position": F.col("position") + F.col("rows_before")}
    for name in sums:
        shifted[f"running_{name}"] = F.col(f"running_{name}") + F.col(f"before_{name}")
    return joined.withColumns(shifted).drop(_RANGE, "rows_before", *[f"before_{name}" for name in sums])


def rank_first(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Rank 1..n in the total order ``order`` (equal values ranked by the tie columns)."""
    return ordered_prefix(df, order).withColumnRenamed("position", out).drop("total_count")


def running_sum(df: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """Running sum from the start to the current row, and the total."""
    return ordered_prefix(df, order, [value]).drop("position", "total_count")


def ntile_global(df: DataFrame, order: Sequence[Column], tiles: int, out: str) -> DataFrame:
    """SQL NTILE over the whole table: the first ``n % tiles`` tiles hold one row more."""
    placed = ordered_prefix(df, order)
    return placed.withColumn(out, F.expr(_ntile_text(tiles)).cast("int")).drop("position", "total_count")


def _ntile_text(tiles: int) -> str:
    size = f"(total_count div {tiles})"
    extra = f"(total_count % {tiles})"
    return (
        f"CASE WHEN position <= {extra} * ({size} + 1) THEN (position - 1) div ({size} + 1) + 1 "
        f"ELSE {extra} + (position - 1 - {extra} * ({size} + 1)) div greatest({size}, 1L) + 1 END"
    )


def bin_of_rank(rank: str, size: str, bins: int) -> Column:
    """Quantile bin 0..bins-1 of a first-rank among ``size`` rows."""
    return F.expr(
        f"CASE WHEN {size} > 1 THEN greatest(0L, (({rank} - 1) * {bins} + {size} - 2) div ({size} - 1) - 1) END"
    ).cast("int")


def quantile_bin(
    df: DataFrame, order: Sequence[Column], bins: int, out: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """Quantile bins of first-ranks: bin edges at the linear quantiles of 1..n, right-closed.

    Unlike NTILE the edges are interpolated ranks, so the bin of position r among n
    rows is ``ceil((r - 1) * bins / (n - 1)) - 1`` with the lowest edge included.
    A single row has no bin (null).
    """
    placed = ordered_prefix(df, order)
    code = bin_of_rank("position", "total_count", bins)
    if labels is not None:
        code = F.element_at(F.array(*[F.lit(label) for label in labels]), code + 1)
    return placed.withColumn(out, code).drop("position", "total_count")


def _long(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """Non-null values of the columns as rows (kept columns, ``c`` column number, ``v`` value)."""
    entries = [F.struct(F.lit(i).alias("c"), F.col(name).cast("double").alias("v")) for i, name in enumerate(columns)]
    return df.select(*keep, F.inline(F.array(*entries))).where(F.col("v").isNotNull())


def quantiles_of(df: DataFrame, wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Exact linear-interpolated quantiles of several columns as one row.

    ``wanted`` maps a column to its output names and points.  Values are counted
    before they are ordered, so repeated values cost one row, all columns share one
    ordering pass, and no task holds a column.  A column without values gives null.
    """
    counts = _long(df, list(wanted)).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = ordered_prefix(counts, [F.col("c"), F.col("v")], ["n"]).select("c", "v", "n", "running_n")
    # One row per wanted column.
    sizes = placed.groupBy("c").agg(F.min(F.col("running_n") - F.col("n")).alias("start"), F.sum("n").alias("size"))
    placed = placed.join(F.broadcast(sizes), "c")
    first = F.col("running_n") - F.col("n") - F.col("start")
    last = F.col("running_n") - 1 - F.col("start")
    picks, results = [], []
    for i, points in enumerate(wanted.values()):
        mine = F.col("c") == i
        for name, p in points.items():
            at = F.lit(float(p)) * (F.col("size") - 1)
            picks += [
                F.max(F.when(mine & F.floor(at).between(first, last), F.col("v"))).alias(f"lo_{name}"),
                F.max(F.when(mine & F.ceil(at).between(first, last), F.col("v"))).alias(f"hi_{name}"),
                F.max(F.when(mine, at - F.floor(at))).alias(f"f_{name}"),
            ]
            low, high = F.col(f"lo_{name}"), F.col(f"hi_{name}")
            results.append((low + (high - low) * F.col(f"f_{name}")).alias(name))
    return placed.agg(*picks).select(*results)


def exact_quantiles(df: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """``quantiles_of`` for one column."""
    return quantiles_of(df, {value: points})


def column_ranks(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Ranks of several columns, one row per key, from one ordering pass.

    For each column ``c``: ``first_c`` (1..n, ties by key), ``average_c`` (mean rank of
    ties) and ``size_c`` (number of non-null values).  ``key`` must be unique.
    """
    placed = ordered_prefix(_long(df, columns, key), [F.col("c"), F.col("v"), F.col(key)]).drop("total_count")
    # One row per ranked column.
    sizes = placed.groupBy("c").agg((F.min("position") - 1).alias("start"), F.count(F.lit(1)).alias("size"))
    ties = placed.groupBy("c", "v").agg(((F.min("position") + F.max("position")) / F.lit(2.0)).alias("middle"))
    ranked = placed.join(F.broadcast(sizes), "c").join(ties, ["c", "v"])
    picks = []
    for i, name in enumerate(columns):
        mine = F.col("c") == i
        picks += [
            F.max(F.when(mine, F.col("position") - F.col("start"))).alias(f"first_{name}"),
            F.max(F.when(mine, F.col("middle") - F.col("start"))).alias(f"average_{name}"),
            F.max(F.when(mine, F.col("size"))).alias(f"size_{name}"),
        ]
    return ranked.groupBy(key).agg(*picks)


def pct_rank_avg(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Average rank of ties divided by the number of non-null values."""
    ranks = column_ranks(df, key, [value])
    return df.join(ranks.select(key, (F.col(f"average_{value}") / F.col(f"size_{value}")).alias(out)), key, "left")


def ts_quantile(df: DataFrame, ts: str, p: float, out: str = "cutoff_timestamp") -> DataFrame:
    """Linear-interpolated quantile of a timestamp column as a one-row table."""
    micros = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    found = exact_quantiles(micros, "us", {"q": p})
    return found.select(F.timestamp_micros(F.round("q").cast("long")).cast("timestamp_ntz").alias(out))


def grouped_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """ROW_NUMBER per group without a per-group task; ``order`` must be total within a group."""
    keys = list(keys)
    placed = ordered_prefix(df, [*[F.col(k) for k in keys], *order]).drop("total_count")
    starts = placed.groupBy(*keys).agg(F.min("position").alias("_start"))
    return (
        placed.join(starts, keys)
        .withColumn(out, (F.col("position") - F.col("_start") + 1).cast("long"))
        .drop("position", "_start")
    )


def dense_rank_in(df: DataFrame, keys: Sequence[str], value: str, out: str, ascending: bool = False) -> DataFrame:
    """DENSE_RANK of ``value`` within ``keys``: position among the distinct values of the group."""
    keys = list(keys)
    order = F.col(value).asc() if ascending else F.col(value).desc()
    ranks = grouped_position(df.select(*keys, value).distinct(), keys, [order], out)
    return df.join(ranks, [*keys, value])


def grouped_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str) -> DataFrame:
    """Exact linear-interpolated quantile per group, one row per group."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    placed = ordered_prefix(counts, [*[F.col(k) for k in keys], F.col(value)], ["n"])
    placed = placed.select(*keys, value, "n", "running_n")
    groups = placed.groupBy(*keys).agg(
        F.min(F.col("running_n") - F.col("n")).alias("_start"), F.sum("n").alias("_size")
    )
    at = F.lit(float(p)) * (F.col("_size") - 1)
    first = F.col("running_n") - F.col("n") - F.col("_start")
    last = F.col("running_n") - 1 - F.col("_start")
    picked = (
        placed.join(groups, keys)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.floor(at).between(first, last), F.col(value))).alias("_lo"),
            F.max(F.when(F.ceil(at).between(first, last), F.col(value))).alias("_hi"),
            F.max(at - F.floor(at)).alias("_f"),
        )
    )
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out))


def prev_value(df: DataFrame, key: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """LAG of ``value`` within ``key`` in ascending ``order``; a hot key is spread over ranges.

    The row before a range boundary is carried over as one row per range.
    """
    order = list(order)
    by = [F.col(key), *[F.col(c) for c in order]]
    tagged = _ranged(df, by)
    before = F.lag(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).over(
        Window.partitionBy(_RANGE).orderBy(*by)
    )
    tagged = stable(tagged.withColumn("_prev", before))
    last = tagged.groupBy(_RANGE).agg(
        F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), F.struct(*by)).alias("_tail")
    )
    tails = last.select(_RANGE, F.lag("_tail").over(Window.orderBy(_RANGE)).alias("_tail"))
    prev = F.coalesce("_prev", "_tail")
    return (
        tagged.join(F.broadcast(tails), _RANGE)
        .withColumn(out, F.when(prev["k"] == F.col(key), prev["v"]))
        .drop(_RANGE, "_prev", "_tail")
    )


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group.  Spark keeps only n rows per group before the exchange."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= n)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def arg_max(df: DataFrame, value: str, key: str) -> DataFrame:
    """Key of the row with the largest value; ties go to the smallest key."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))
    return df.where(F.col(value).isNotNull()).agg(best.alias("best")).select(F.col("best.k").alias(key))
