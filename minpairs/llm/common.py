"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import sys
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# fixed values: the word class and the letters that lower-casing touches
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# a side of a join is broadcast only if it was counted and has at most so many narrow rows
BROADCAST_ROWS = 500_000

# whole texts cross to Python in Arrow batches of about so many bytes
TEXT_BATCH_BYTES = 4 << 20


_scopes: list[str] = []  # open scopes on the driver, innermost last


def scratch_base(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, under this application's own sub-folder (and the open scope's)."""
    return "/".join([scratch_base(spark), *_scopes, f"{name}-{uuid.uuid4().hex}"])


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; results must be stored outside by then."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    folder = "/".join([scratch_base(spark), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the table. Unlike an RDD
    checkpoint it is compressed, and later reads take only their columns."""
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables this application has staged; call it when results are stored."""
    _delete(spark, scratch_base(spark))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged
    (then the planner shuffles). ``df`` should be a staged table: it is counted."""
    return F.broadcast(df) if df.count() <= rows else df


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, for a Python step over whole texts. A worker holds a batch several times
    over, so its session's limit on the bytes of an Arrow batch is lowered, whatever the
    number of rows; a plan setting like those of ``session.tune``, it stays lowered."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get(key))
    if not 0 < limit <= TEXT_BATCH_BYTES:
        df.sparkSession.conf.set(key, str(TEXT_BATCH_BYTES))
    return df


def worker_memory() -> dict:
    """What a Python worker keeps over its tasks: a dict in a module of its own, as this
    package's code is unpickled anew for every task."""
    return vars(sys.modules.setdefault("minpairs_worker_memory", types.ModuleType("minpairs_worker_memory")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_sample(df: DataFrame, rows: int, *on: str) -> DataFrame:
    """At most ``rows`` rows, the same on every run: those with the least hash of ``on``.

    A cut on the hash, set from the row count, comes first: all tasks together
    then pass on about four times ``rows``, not ``rows`` each."""
    h = F.xxhash64(*on)
    cut = -2**63 + int(2**64 * min(1.0, 4 * rows / max(1, df.count())))
    return (df.where(h < F.lit(cut)) if cut < 2**63 else df).orderBy(h, *on).limit(rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    Pure ASCII strings take the byte-wise path of ``lower``; others are
    translated letter by letter, as ``lower`` would change É or ẞ too."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
