"""Directory of an extendible hash, built with DataFrame functions only.

Rows carry a ``key`` of 63 hash bits (a non-negative long) and a ``size``. A bucket
is a prefix of the key: the shortest one whose rows fit the limit while those of the
prefix one bit shorter do not. Only oversized buckets are split on another bit, and
the directory, indexed by the leading ``bits`` of the key, doubles until all fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

KEY_BITS = 63


def prefix(key: Column, bits: int) -> Column:
    return F.shiftright(key, KEY_BITS - bits)


def build(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``(directory, bits)`` of ``rows`` (``key``, ``size``; a stored table, it is read again per doubling).

    The directory has a row ``slot, depth, bucket`` for each used ``bits``-bit
    prefix: its bucket is the ``depth``-bit prefix ``bucket``. A single key over
    the limit cannot be split; it gets a bucket of its own."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    bits = min(KEY_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 3))
    while True:
        slots = stage(rows.groupBy(prefix(F.col("key"), bits).alias("slot"))
                      .agg(F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi")), "slots")
        over = slots.where(F.col("size") > limit).agg(F.max(F.col("lo") < F.col("hi"))).first()[0]
        if not over or bits == KEY_BITS:
            break
        bits = min(KEY_BITS, bits + 4)  # the directory doubles four times
    nodes = slots.select("slot", "size", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    nodes = nodes.withColumn("bucket", F.expr(f"shiftright(slot, {bits} - depth)"))
    sums = stage(nodes.groupBy("depth", "bucket").agg(F.sum("size").alias("size")), "buckets")
    parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"), F.col("size").alias("parent_size"))
    leaves = (sums.withColumn("parent", F.shiftright("bucket", 1)).join(parents, ["depth", "parent"], "left")
              .where(((F.col("size") <= limit) | (F.col("depth") == bits)) & F.coalesce(F.col("parent_size") > limit, F.lit(True)))
              .select("depth", "bucket"))
    return stage(nodes.join(leaves, ["depth", "bucket"]).select("slot", "depth", "bucket"), "directory"), bits
