"""Exact dedup over an extendible-hash index kept in shared files (DataFrame functions only).

1. Every row becomes an index entry ``(doc_id, key)``; ``key`` is a 64-bit hash of the
   normalised text. Entries are written to the shared folder, and those of one part
   of the table with equal keys become one partial entry (largest id, count), so that
   a text that fills a third of the table travels as one row per part.
2. An extendible directory lays the keys into buckets: a bucket is a prefix of the
   key; while a bucket holds more than its capacity of partial entries, that bucket alone
   takes one more bit.
3. Partial entries go through the directory to the owner of their bucket. Owner tasks
   hold whole buckets (key ranges), merge the entries of each key and write the
   index, sorted by key.
4. For keys that occur more than once, the parts send their least and greatest text to the
   same owners, which compare bytes: all texts of a key are equal only if
   the extremes are. Keys whose texts differ (64-bit collisions) get a chain of
   entries, one per distinct text.
5. Rows find their entry by bucket and key, and along the chain by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extendible
from .common import ascii_lower, bounded, fresh, partitions, stage


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                bucket_entries: int = 200_000, key_bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty.
    Of equal texts the largest id stays.

    * empty table: empty result; extra columns of any name are ignored;
    * null ids: never the largest; a group of null ids only has ``keep_id`` null
      and keeps all its rows (``kept`` compares null-safe);
    * repeated rows: each is returned and counted in ``group_size``; rows that
      share the largest id are all kept;
    * texts of any length are read whole; no group is gathered in one task.

    ``bucket_entries``: capacity of a bucket in partial entries (a key has at most one
    per part of the table). ``key_bits``: bits of the hash in use (fewer only to force
    collisions in tests)."""
    src = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"))
    key = F.xxhash64("norm")
    if key_bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    src = src.withColumn("key", key).withColumn("part", F.spark_partition_id())
    entries = stage(src.select("doc_id", "key", "part", F.sha2("norm", 256).alias("sha")), "entries")
    partial = stage(entries.groupBy("part", "key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "partial_entries")
    path = F.shiftrightunsigned("key", 1)  # 63 bits: a key's way through the directory
    directory, bits = extendible.build(partial.select(path.alias("key"), F.lit(1).alias("size")), bucket_entries)
    n_owners = partitions(docs.sparkSession)

    def through_directory(rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", extendible.prefix(path, bits)).join(bounded(directory), "slot").drop("slot")

    def owned(rows: DataFrame) -> DataFrame:
        """Whole buckets in one task each; grouping by bucket and key needs no further exchange."""
        return rows.repartition(n_owners, "depth", "bucket")

    at = ["depth", "bucket", "key"]
    index = stage(owned(through_directory(partial)).groupBy(*at).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
                  .sortWithinPartitions(*at), "index")

    # bytes of all texts under a repeated key: equal if the extremes are
    repeated = stage(index.where("group_size > 1").select(*at), "repeated")
    suspects = src.join(bounded(repeated), "key")
    extremes = stage(suspects.groupBy("part", *at).agg(F.min("norm").alias("a"), F.max("norm").alias("b")), "extremes")
    collided = stage(owned(extremes).groupBy(*at).agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select(*at), "collided")
    n_collided = collided.count()

    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    plain = through_directory(entries).join(index, at)
    if n_collided:
        plain = plain.join(collided, at, "left_anti")
    out = plain.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
    if n_collided:
        rows = stage(suspects.join(bounded(collided), at, "left_semi").select("doc_id", "norm", *at), "chained")
        chain = stage(rows.groupBy(*at, "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "chain")
        out = out.unionByName(rows.join(chain, [*at, "norm"]).select(
            "doc_id", "keep_id", "group_size", kept.alias("kept"), F.sha2("norm", 256).alias("text_sha256")))
    return out


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Rows that are dropped are found by id and digest; only those ids travel.
    Of repeated rows (same id, equal text) one stays; rows without an id all stay in a
    group that has none with one. Empty table: empty result; null text counts as empty."""
    found = stage(exact_dedup(docs, id_col, text_col, **options), "exact")
    sha = F.sha2(ascii_lower(F.col(text_col)), 256)
    ids, digests, own = (fresh(docs, n) for n in ("_gone_id", "_gone_sha", "_sha"))
    keep_one = found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
    again = stage(keep_one.where("n > 1").select("doc_id", "text_sha256"), "repeated_rows")
    gone = stage(found.where("not kept").select("doc_id", "text_sha256").distinct(), "gone")

    def matches(other: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        other = other.select(F.col("doc_id").alias(ids), F.col("text_sha256").alias(digests))
        return rows.join(bounded(other), F.col(id_col).eqNullSafe(F.col(ids)) & (sha == F.col(digests)), how)

    out = matches(gone, "left_anti", docs)
    if not again.isEmpty():
        one = matches(again, "left_semi", docs).withColumn(own, sha).dropDuplicates([id_col, own]).drop(own)
        out = matches(again, "left_anti", out).unionByName(one)
    return out
