"""Spark session defaults and lineage helpers.

The library itself never creates a session: every operator takes and
returns DataFrames.  ``local_session`` is for tests, ``bench.py`` and
notebooks; on a cluster the user's own session is used as is.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on.  They are applied by ``tune`` to any session
# (also a cluster one) because they change plan shape, not resources.
PLAN_CONF = {
    # runtime re-planning: small sides become broadcasts from measured
    # shuffle sizes, skewed partitions are split, tiny partitions merged
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins on (sentence, x) may reuse a hash partitioning on the sentence alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # broadcast only what is measured: no broadcast from planner estimates,
    # AQE converts a join once the shuffled side is known to be small
    # (explicit broadcast() hints are kept for tables of fixed size)
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
}


def tune(spark: SparkSession) -> SparkSession:
    for k, v in PLAN_CONF.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "minpairs") -> SparkSession:
    """Local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", os.path.join(os.environ.get("TMPDIR", "/tmp"), "minpairs-warehouse"))
        .config("spark.driver.memory", os.environ.get("MINPAIRS_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # remove checkpoint files of frames that are no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in PLAN_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder (``spark.checkpoint.dir``).

    Where none is set, a scratch folder is made, but only for a session whose
    driver and executors are one process (``local[...]``): on a cluster, files in
    a folder of one machine are lost to all others, so that raises."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set on {master}: name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="minpairs-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, under this application's own sub-folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder and read back.

    Used where one expensive frame feeds several outputs; a lost executor
    then re-reads the table instead of recomputing the whole plan.  Unlike an
    RDD checkpoint it is compressed, later reads take only the columns they
    need, and the planner knows its size."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables this application has stored; call it when results are."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")
    base.getFileSystem(spark._jsc.hadoopConfiguration()).delete(base, True)
