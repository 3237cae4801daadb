"""Sharding by extendible hashing: shards are hash prefixes, split only where too large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extendible
from .common import bounded, stage

ID_BITS = 40  # leading key bits, from the id; the rest tells repeated ids apart
ROW_BITS = extendible.KEY_BITS - ID_BITS


def shard(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, shard_depth, shard_prefix``.

    A shard is all rows whose key begins with the ``shard_depth`` bits
    ``shard_prefix``; the key is the md5 of the id as text. Shards hold at most
    ``limit_bytes`` of text and are as large as that allows.

    * null or empty text: 0 bytes; null id: the key of the empty string;
    * repeated ids: told apart by further bits hashed from the row's place, so
      that they can be split too; a text over the limit has a shard of its own;
    * empty table: empty result; extra columns of any name are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "shard_rows")
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, ID_BITS // 4)
    key = F.shiftleft(F.conv(digits, 16, 10).cast("long"), ROW_BITS).bitwiseOR(F.pmod(F.xxhash64("row"), F.lit(1 << ROW_BITS)))
    rows = rows.withColumn("key", key)
    directory, bits = extendible.build(rows.select("key", F.col("n_bytes").alias("size")), limit_bytes)
    return (rows.withColumn("slot", extendible.prefix(F.col("key"), bits)).join(bounded(directory), "slot")
            .select("doc_id", "n_bytes", F.col("depth").cast("long").alias("shard_depth"), F.col("bucket").alias("shard_prefix")))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Store ``docs`` as one Parquet folder per shard. Ids must be distinct and not null."""
    side = shards.select(F.col("doc_id").alias(id_col), "shard_depth", "shard_prefix")
    docs.join(side, id_col).repartition("shard_depth", "shard_prefix").write.partitionBy("shard_depth", "shard_prefix").parquet(path)
