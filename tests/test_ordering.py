"""Order operators against pandas, with ties, hot keys and several ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martlight.operators import ordering as o

pytestmark = pytest.mark.usefixtures("many_ranges")


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 997
    frame = pd.DataFrame({"id": rng.permutation(n), "v": rng.integers(0, 40, n) / 2.0, "w": rng.normal(size=n)})
    # a third of all rows under one key
    frame["k"] = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 30, n))
    return frame.sort_values("id").reset_index(drop=True)


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5)


def by_id(result):
    return result.toPandas().sort_values("id").reset_index(drop=True)


def test_positions_and_running_sums(df, pdf):
    got = by_id(o.ordered_prefix(df, [F.desc("v"), F.col("id")], ["k"]))
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    running = want["k"].cumsum()
    assert (got["position"] == pd.Series(range(1, len(want) + 1), index=want.index).sort_index()).all()
    assert (got["running_k"] == running.sort_index()).all()
    assert (got["total_k"] == pdf["k"].sum()).all()


@pytest.mark.parametrize("bins", [4, 5])
def test_quantile_bins_equal_qcut_of_first_ranks(df, pdf, bins):
    got = by_id(o.quantile_bin(df, [F.col("v"), F.col("id")], bins, "bin"))
    want = pd.qcut(pdf["v"].rank(method="first"), q=bins, labels=False)
    assert (got["bin"] == want).all()


def test_single_row_has_no_bin(spark):
    one = spark.createDataFrame([(1, 2.0)], "id long, v double")
    assert o.quantile_bin(one, [F.col("v"), F.col("id")], 5, "bin").head()["bin"] is None


def test_column_ranks_equal_pandas(df, pdf):
    got = by_id(o.column_ranks(df, "id", ["v", "w"]))
    for c in ("v", "w"):
        assert (got[f"first_{c}"] == pdf[c].rank(method="first")).all()
        assert (got[f"average_{c}"] == pdf[c].rank(method="average")).all()
        assert (got[f"size_{c}"] == len(pdf)).all()


def test_pct_rank(df, pdf):
    got = by_id(o.pct_rank_avg(df, "id", "v", "pct"))
    assert np.allclose(got["pct"], pdf["v"].rank(method="average", pct=True))


@pytest.mark.parametrize("tiles", [1, 7, 10, 2000])
def test_ntile(spark, df, tiles):
    df.createOrReplaceTempView("tile_rows")
    want = spark.sql(f"SELECT id, ntile({tiles}) OVER (ORDER BY v, id) AS t FROM tile_rows")
    got = o.ntile_global(df, [F.col("v"), F.col("id")], tiles, "t").select("id", "t")
    assert got.exceptAll(want).isEmpty()


def test_quantiles_equal_numpy(df, pdf):
    got = o.quantiles_of(df, {"v": {"a": 0.25, "b": 0.8}, "w": {"c": 0.5, "d": 0.0, "e": 1.0}}).head()
    want = [*np.quantile(pdf["v"], [0.25, 0.8]), *np.quantile(pdf["w"], [0.5, 0, 1])]
    assert np.allclose(list(got), want)


def test_quantiles_of_nothing_are_null(df):
    assert o.exact_quantiles(df.where("id < 0"), "v", {"m": 0.5}).head()["m"] is None


def test_grouped_quantile_with_a_hot_key(df, pdf):
    got = o.grouped_quantile(df, ["k"], "w", 0.5, "m").toPandas().set_index("k")["m"].sort_index()
    assert np.allclose(got, pdf.groupby("k")["w"].median())


def test_previous_value_with_a_hot_key(df, pdf):
    got = by_id(o.prev_value(df, "k", ["v", "id"], "w", "prev"))
    want = pdf.sort_values(["k", "v", "id"]).groupby("k")["w"].shift().sort_index()
    assert np.allclose(got["prev"], want, equal_nan=True)


def test_dense_rank_and_position_per_group(df, pdf):
    got = by_id(o.dense_rank_in(df, ["k"], "v", "r"))
    assert (got["r"] == pdf.groupby("k")["v"].rank(method="dense", ascending=False)).all()
    placed = by_id(o.grouped_position(df, ["k"], [F.col("id")], "p"))
    assert (placed["p"] == pdf.groupby("k")["id"].rank()).all()


def test_arg_max_prefers_the_smallest_key(spark):
    rows = spark.createDataFrame([(3, 5.0), (1, 5.0), (2, 1.0), (0, None)], "id long, v double")
    assert o.arg_max(rows, "v", "id").head()["id"] == 1
