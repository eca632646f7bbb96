"""Helpers the operators share: reading tables, Arrow maps over texts, joins with a small side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.session import FREE_SHUFFLES

#: Rows of a side that may be broadcast; one row here is a key and a few numbers.
BROADCAST_ROWS = 50_000
#: Texts handled at once inside a task.
SLICE = 256
#: Texts of an Arrow batch, which Spark and the worker hold at the same time; Spark's default is 10,000.
BATCH = 1_000

#: What workers keep from task to task, by operator.
_KEPT: dict[str, dict] = {}


def worker_store(operator: str) -> dict:
    """A dict that outlives a task in its worker, until the worker gets a task of another operator."""
    return _KEPT.setdefault(operator, {})


def release(operator: str | None = None) -> None:
    """Empty the stores of all other operators, and give back what Arrow holds in reserve."""
    for name, store in _KEPT.items():
        if name != operator:
            store.clear()
    pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, operator: str | None = None) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH`` texts, with no store in the worker but that of ``operator``."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(operator)
        yield from run(batches)

    return df.mapInArrow(alone, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  Shuffles of the operators' steps are removed with the end of each, as in :func:`tune`."""
    spark.conf.set(FREE_SHUFFLES, "true")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the named columns, under the operator's own names; others cannot clash then."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()))


def map_slices(
    df: DataFrame,
    handle: Callable[[list[list]], list[list]],
    schema: str,
    start: Callable[[], Callable[[list[list]], list[list]]] | None = None,
    rows: int = SLICE,
    operator: str | None = None,
) -> DataFrame:
    """:func:`map_texts` over slices of at most ``rows`` rows, so that a worker holds few texts at a time.

    ``handle`` turns lists (one per input column) into lists (one per output column).  ``start``
    makes the handler once per task, for handlers that keep state.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = start() if start else handle
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = apply([part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(out, arrow, strict=True)],
                    schema=arrow,
                )

    return map_texts(df, run, schema, operator)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def key_of(column: str) -> Column:
    """A group key that null can take part in."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


def join_rates(big: DataFrame, small: DataFrame, key: str, small_rows: int, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join of ``big`` with one row per key.

    Up to ``BROADCAST_ROWS`` keys the small side is sent to every task.  Beyond, it is repeated
    once per salt, so that a key with a third of all rows meets ``salts`` tasks instead of one.
    """
    if small_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns[:1], F.spark_partition_id()), F.lit(salts)).cast("int"))
    return spread.join(salted, [key, "_salt"], how).drop("_salt")
