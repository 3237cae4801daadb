"""Scan helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str, min_partitions: int | None = None) -> DataFrame:
    """Fan an under-split scan out over the cluster.

    A parquet file with a single row group is read by a single task no
    matter how large it is.  When the scan yields fewer partitions than the
    cluster has cores, hash-partition it on ``keys`` (deterministic, unlike
    round-robin).  On a real table with many files/row groups this is a
    no-op, so no shuffle is added at scale."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_fingerprint(spark, path: str) -> str:
    """md5 of (path, size, mtime) of every file under ``path``."""
    import hashlib

    p, fs = _fs(spark, path)
    parts = [path]
    it = fs.listFiles(p, True)
    while it.hasNext():
        st = it.next()
        parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(parts)).encode()).hexdigest()


def exists(spark, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


MANIFEST = "CURRENT"


def published(spark, folder: str) -> str | None:
    """The version of ``folder`` that its manifest names, if there is one."""
    p, fs = _fs(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{folder}/{name}" if name else None


def publish(spark, folder: str, version: str) -> str:
    """Name the finished ``folder/version`` in the manifest, which is written
    last and never replaced: of several writers the first one's version
    holds, the others delete theirs.  Returns the version that holds."""
    p, fs = _fs(spark, f"{folder}/{MANIFEST}")
    jvm = spark.sparkContext._jvm
    try:
        out = fs.create(p, False)
        try:
            out.write(bytearray(version.encode()))
        finally:
            out.close()
    except Exception as e:  # noqa: BLE001  another writer was first
        if not fs.exists(p):
            raise
        for _ in range(50):
            if held := published(spark, folder):
                delete(spark, f"{folder}/{version}")
                return held
            jvm.java.lang.Thread.sleep(100)
        raise RuntimeError(f"the manifest in {folder} is empty; delete it to start afresh") from e
    return f"{folder}/{version}"
