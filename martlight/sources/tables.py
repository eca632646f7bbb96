"""Reading, checking, loading and writing marketplace tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from martlight.sources.schema import CSV_FILES, TABLES, struct_of


@dataclass(frozen=True)
class Marketplace:
    """The nine raw tables under their canonical names."""

    customers: DataFrame
    geolocation: DataFrame
    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    category_translation: DataFrame

    def items(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register(self) -> None:
        """Expose the tables to ``spark.sql`` as temporary views."""
        for name, df in self.items().items():
            df.createOrReplaceTempView(name)


def table_path(path: str, name: str, fmt: str) -> str:
    return f"{path.rstrip('/')}/{CSV_FILES[name] if fmt == 'csv' else name}"


def check_inputs(spark: SparkSession, paths: Iterable[str]) -> None:
    """Fail with the list of missing paths, on whatever file system they name."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(conf).exists(target):
            missing.append(path)
    if missing:
        raise FileNotFoundError("Missing required files: " + ", ".join(missing))


# Tables with free text, in which a quoted cell may hold line breaks; such a file cannot be split.
MULTI_LINE = {"order_reviews"}
CORRUPT = "_corrupt_record"


def _csv_reader(spark: SparkSession, name: str):
    return spark.read.options(header=True, multiLine=name in MULTI_LINE, escape='"')


def read_commerce(
    spark: SparkSession, path: str, fmt: str = "parquet", as_text: bool = False, most_corrupt: float | None = 0.01
) -> Marketplace:
    """Read the nine tables with their fixed schemas (no inference).

    A CSV cell that does not fit its type becomes null.  If more than ``most_corrupt`` of a table's rows hold such a cell,
    reading fails; None saves the scan that counts them.  ``as_text`` reads every CSV column as it is written.
    """
    check_inputs(spark, [table_path(path, name, fmt) for name in TABLES])
    if fmt == "csv" and not as_text and most_corrupt is not None:
        wrong = corrupt_rows(spark, path).where(F.col("corrupt_rows") > most_corrupt * F.col("rows")).collect()
        if wrong:
            found = ", ".join(f"{r['table']} ({r['corrupt_rows']} of {r['rows']} rows)" for r in wrong)
            raise ValueError("Cells that do not fit their type in: " + found)
    tables = {}
    for name in TABLES:
        schema = struct_of(name)
        if as_text:
            schema = StructType([StructField(f.name, StringType()) for f in schema])
        reader = _csv_reader(spark, name) if fmt == "csv" else spark.read
        tables[name] = reader.schema(schema).format(fmt).load(table_path(path, name, fmt))
    return Marketplace(**tables)


def corrupt_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows per CSV table, and those with a cell that does not fit its type or too few or many cells."""
    reports = []
    for name in TABLES:
        schema = struct_of(name).add(CORRUPT, "string")
        rows = _csv_reader(spark, name).option("columnNameOfCorruptRecord", CORRUPT).schema(schema)
        df = rows.csv(table_path(path, name, "csv"))
        # Only columns that are used are parsed, so all of them are.
        used = F.max(F.xxhash64(*(c for c in df.columns if c != CORRUPT)))
        counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("corrupt_rows"), used.alias("used"))
        reports.append(counts.where("used is not null or rows = 0").select(F.lit(name).alias("table"), "rows", "corrupt_rows"))
    return reduce(DataFrame.unionByName, reports)


def sql_source(spark: SparkSession, text: str, **args) -> DataFrame:
    """A query over registered views; ``:name`` markers are bound from ``args``."""
    return spark.sql(text, args=args) if args else spark.sql(text)


def jdbc_source(spark: SparkSession, url: str, query: str, partition: Mapping[str, object] | None = None) -> DataFrame:
    """A query of an external database.  ``partition`` names column, bounds and count for parallel reads."""
    reader = spark.read.format("jdbc").option("url", url)
    if partition:
        reader = reader.option("dbtable", f"({query}) source").options(**partition)
    else:
        reader = reader.option("query", query)
    return reader.load()


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Check column names before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns in {what}: " + ", ".join(missing))
    return df


def load_tables(dfs: Mapping[str, DataFrame], target: str, mode: str = "overwrite") -> None:
    """Store each table as parquet under ``target``.  Appending twice stores rows twice; :func:`append_batch` does not."""
    for name, df in dfs.items():
        df.write.mode(mode).parquet(f"{target.rstrip('/')}/{name}")


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path of ``path`` and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_batch(dfs: Mapping[str, DataFrame], target: str, batch: str) -> bool:
    """Store a batch of rows under ``target`` once; False if ``batch`` was stored before.

    Each table is written to a folder of the batch, and a marker is created last: :func:`read_batches` sees all tables of a
    batch or none.  A batch that failed midway is written anew when it is sent again.  One writer per batch is assumed.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"A batch is named by letters, digits, _ and -, not {batch!r}")
    spark = next(iter(dfs.values())).sparkSession
    root = target.rstrip("/")
    marker, files = _file_system(spark, f"{root}/_batches/{batch}")
    if files.exists(marker):
        return False
    for name, df in dfs.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch-{batch}")
    return bool(files.createNewFile(marker))


def read_batches(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The rows of table ``name`` in all stored batches under ``target``."""
    root = target.rstrip("/")
    folder, files = _file_system(spark, f"{root}/_batches")
    stored = sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []
    paths = [f"{root}/{name}/batch-{batch}" for batch in stored]
    held = [path for path in paths if files.exists(_file_system(spark, path)[0])]
    if not held:
        raise FileNotFoundError(f"No stored batch holds {name} under {target}")
    return spark.read.parquet(*held)


def reconcile_counts(source: Mapping[str, DataFrame], stored: Mapping[str, DataFrame]) -> DataFrame:
    """Source rows against stored rows per table."""
    report = None
    for name, df in source.items():
        left = df.agg(F.count(F.lit(1)).alias("source_rows"))
        right = stored[name].agg(F.count(F.lit(1)).alias("database_rows"))
        row = left.select(F.lit(name).alias("table"), "source_rows", right.scalar().alias("database_rows"))
        report = row if report is None else report.unionByName(row)
    return report.withColumn("match", F.col("source_rows") == F.col("database_rows"))


def assert_reconciled(report: DataFrame) -> None:
    """Fail when a stored table differs from its source (one row per table is read)."""
    wrong = [row["table"] for row in report.where(~F.col("match")).collect()]
    if wrong:
        raise ValueError("Row counts differ after loading: " + ", ".join(wrong))


def reload_report(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Store the tables under ``folder``, read them back and compare counts (one row per table); the copy is deleted."""
    spark = next(iter(tables.values())).sparkSession
    load_tables(tables, folder)
    try:
        stored = {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
        rows = reconcile_counts(tables, stored)
        return spark.createDataFrame(rows.collect(), rows.schema)
    finally:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def save_model(model, path: str, meta: dict) -> None:
    """Write a fitted Spark ML model and one row of metadata next to it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    row = spark.range(1).select(F.lit(json.dumps(meta, sort_keys=True, default=str)).alias("value"))
    row.write.mode("overwrite").text(f"{path}/meta")


def load_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").head()[0])
