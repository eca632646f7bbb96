"""Reading, loading, reconciling, checking, and the artifact checks."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from martlight.operators.checks import duplicate_rows, key_report, profile_numeric, value_counts
from martlight.plans import report as p
from martlight.plans import value as v
from martlight.plans.attribution import with_step_attribution
from martlight.sources import tables as s
from martlight.sources.schema import CSV_FILES, TABLES, struct_of


def csv_folder(spark, tmp_path):
    for name, file in CSV_FILES.items():
        schema = struct_of(name)
        row = spark.range(1).select(*[F.lit("7").try_cast(f.dataType).alias(f.name) for f in schema])
        row.write.option("header", True).csv(str(tmp_path / file))
    return str(tmp_path)


def test_csv_tables_have_the_fixed_schema(spark, tmp_path):
    market = s.read_commerce(spark, csv_folder(spark, tmp_path), "csv")
    for name, df in market.items().items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in struct_of(name)]
        assert df.count() == 1
    assert set(market.items()) == set(TABLES)


def test_missing_files_are_listed(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="orders"):
        s.read_commerce(spark, str(tmp_path))


def test_load_and_reconcile(spark, star, tmp_path):
    source = {"sellers": star.sellers, "products": star.products}
    s.load_tables(source, str(tmp_path))
    stored = {n: spark.read.parquet(str(tmp_path / n)) for n in source}
    report = s.reconcile_counts(source, stored)
    assert report.where("match").count() == 2
    s.assert_reconciled(report)
    s.load_tables({"sellers": star.sellers}, str(tmp_path), "append")
    stored["sellers"] = spark.read.parquet(str(tmp_path / "sellers"))
    with pytest.raises(ValueError, match="sellers"):
        s.assert_reconciled(s.reconcile_counts(source, stored))


def test_export_as_csv(spark, star, tmp_path):
    s.write_table(star.sellers, str(tmp_path / "out"), "csv")
    s.write_table(star.sellers, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == star.sellers.count()


def test_required_columns(star):
    with pytest.raises(ValueError, match="nothing, none"):
        s.require_columns(star.sellers, ["seller_id", "nothing", "none"])


def test_model_and_metadata_survive(spark, star, tmp_path):
    model, _ = v.fitted(star, trees=2)
    s.save_model(model.trees, str(tmp_path / "m"), {"features": model.features, "trees": 2})
    assert s.load_meta(spark, str(tmp_path / "m"))["features"] == v.FEATURES
    loaded = type(model.trees).load(str(tmp_path / "m" / "model"))
    assert loaded.getNumTrees == 2


def test_left_joins_of_unused_parts_are_pruned(star):
    """Counting orders must not read the item table behind the delivery dates."""
    plan = star.orders.groupBy("order_status").count()._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "b")], "x int, y string")
    assert duplicate_rows(df).head()[0] == 1
    assert tuple(key_report(df, ["x"]).head()) == (4, 3, 1)
    assert [tuple(r) for r in value_counts(df, "y").collect()] == [("a", 2), ("b", 1), (None, 1)]
    stats = profile_numeric(df, ["x"]).head()
    assert (stats["count"], stats["min"], stats["p50"], stats["max"]) == (3, 1.0, 1.0, 2.0)


def test_customer_lookup(spark):
    df = spark.createDataFrame([(1, "x")], "customer_unique_id long, label string")
    assert p.for_customer(df, "1").head()["label"] == "x"
    with pytest.raises(KeyError):
        p.for_customer(df, "2")


def test_artifact_checks(spark, star):
    ret = spark.createDataFrame(
        [(1, "Low", "a", "b", "c", 1.0)], "customer_unique_id long, " + ", ".join(
            f"{c} {'double' if c == 'opportunity_score' else 'string'}" for c in p.RETENTION_FIELDS[1:])
    )
    shap = with_step_attribution(star)
    p.assert_artifacts({"features": ret, "retention": ret}, shap, v.FEATURES)
    with pytest.raises(ValueError, match="several rows"):
        p.assert_artifacts({"features": ret, "retention": ret.union(ret)}, shap, v.FEATURES)
    with pytest.raises(ValueError, match="feature table lacks"):
        p.assert_artifacts({"features": ret.where("false"), "retention": ret}, shap, v.FEATURES)
    with pytest.raises(ValueError, match="retention fields are empty"):
        empty = ret.withColumn("retention_strategy", F.lit(None).cast("string"))
        p.assert_artifacts({"features": ret, "retention": empty}, shap, v.FEATURES)


def test_unreadable_cells_are_counted(spark, tmp_path):
    folder = csv_folder(spark, tmp_path)
    orders = s.table_path(folder, "orders", "csv")
    from martlight.plans.quality import TIMESTAMP_COLUMNS, timestamp_report

    good = {r["table"]: (r["rows"], r["corrupt_rows"]) for r in s.corrupt_rows(spark, folder).collect()}
    assert all(bad == 0 for _, bad in good.values())
    target = next(f for f in Path(orders).glob("part*.csv") if f.read_text().count("\n") > 1) if Path(orders).is_dir() else Path(orders)
    lines = target.read_text().splitlines()
    cells = lines[1].split(",")
    cells[3] = "notadate"
    for crc in target.parent.glob(f".{target.name}.crc"):
        crc.unlink()
    target.write_text("\n".join([lines[0], ",".join(cells), *lines[2:]]) + "\n")
    bad = {r["table"]: (r["rows"], r["corrupt_rows"]) for r in s.corrupt_rows(spark, folder).collect()}
    assert bad["orders"] == (good["orders"][0], 1) and bad["sellers"] == good["sellers"]
    with pytest.raises(ValueError, match="orders .1 of"):
        s.read_commerce(spark, folder, "csv", most_corrupt=0.0)
    assert s.read_commerce(spark, folder, "csv", most_corrupt=None).orders.count() == good["orders"][0]
    raw = s.read_commerce(spark, folder, "csv", as_text=True).items()
    report = timestamp_report({t: raw[t] for t in TIMESTAMP_COLUMNS}).where("table_name = 'orders'").collect()
    assert {r["column_name"]: r["invalid"] for r in report}["order_purchase_timestamp"] == 1


def test_lost_rows_are_reported(spark, star, tmp_path):
    assert all(r["match"] for r in s.reload_report(star.items(), str(tmp_path / "copy")).collect())
    assert not (tmp_path / "copy").exists()
    stored = {"sellers": star.sellers.limit(3)}
    assert not s.reconcile_counts({"sellers": star.sellers}, stored).head()["match"]


def test_batch_sent_twice_is_stored_once(spark, star, tmp_path):
    target, batch = str(tmp_path), {"sellers": star.sellers, "products": star.products}
    with pytest.raises(FileNotFoundError):
        s.read_batches(spark, target, "sellers")
    assert s.append_batch(batch, target, "day-1")
    assert not s.append_batch(batch, target, "day-1")
    assert s.read_batches(spark, target, "sellers").count() == star.sellers.count()
    assert s.append_batch({"sellers": star.sellers.limit(3)}, target, "day-2")
    assert s.read_batches(spark, target, "sellers").count() == star.sellers.count() + 3
    assert s.read_batches(spark, target, "products").columns == star.products.columns
    with pytest.raises(ValueError, match="batch"):
        s.append_batch(batch, target, "../day")


def test_batch_that_fails_midway_is_not_seen(spark, star, tmp_path):
    target = str(tmp_path)
    assert s.append_batch({"sellers": star.sellers}, target, "a")
    broken = star.products.withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        s.append_batch({"sellers": star.sellers, "products": broken}, target, "b")
    assert s.read_batches(spark, target, "sellers").count() == star.sellers.count()
    assert s.append_batch({"sellers": star.sellers, "products": star.products}, target, "b")
    assert s.read_batches(spark, target, "sellers").count() == 2 * star.sellers.count()
    assert s.read_batches(spark, target, "products").count() == star.products.count()
