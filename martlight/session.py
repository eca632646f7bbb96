"""Session helpers: SQL settings the jobs rely on, and reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings changed on an existing session.  Everything else (memory, cores,
# shuffle width) belongs to the cluster and is left as the caller set it.
RUNTIME_SETTINGS = {
    # NTZ columns are compared and subtracted through UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join partitions even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffles of a step go with its end instead of with the driver's next garbage collection; later steps read checkpoints.
    FREE_SHUFFLES: "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the jobs rely on."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and the local bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("martlight")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; fall back to a temporary one only in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="martlight-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and every executor can reach, for tables between jobs."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder so that later reads see the same rows.

    Needed wherever a value depends on the physical placement of rows (partition
    ids, sampled range bounds): a lost executor must not lead to a different
    placement on recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition below which a step of a fit costs more to start than to run.
FIT_ROWS = 20_000


def for_fitting(df: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows, or as many as it has: a fit starts one task per partition and step."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def settled(df: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """:func:`stable`, in partitions of about ``rows`` rows: what follows a small table takes few tasks and files, and no
    exchange if one partition holds it."""
    return for_fitting(stable(df), rows)
