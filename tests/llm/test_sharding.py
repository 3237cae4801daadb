from collections import defaultdict
from hashlib import md5

import pytest

from minpairs.llm import extendible, sharding


def brute(rows, limit):
    data = [(i, len((t or "").encode()), int(md5(str("" if i is None else i).encode()).hexdigest()[:10], 16)) for i, t, *_ in rows]
    out = []
    for i, n, key in data:
        for d in range(41):
            if sum(m for _, m, k in data if k >> (40 - d) == key >> (40 - d)) <= limit:
                break
        out.append((i, n, d, key >> (40 - d)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [30, 200, 10**6])
def test_shortest_prefix_that_fits(docs_of, limit):
    rows = [(k, "x" * (k * 13 % 29)) for k in range(150)] + [(1000, None), (1001, "É")]
    got = sharding.shard(docs_of(rows, extra=True), limit)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, limit)


def test_repeated_ids_split_too(docs_of):
    rows = [(5, "y" * 10) for _ in range(200)] + [(k, "z" * 10) for k in range(100, 140)] + [(None, "n" * 10)] * 3 + [(9, "w" * 5000)]
    size = defaultdict(int)
    for r in sharding.shard(docs_of(rows), 100).collect():
        size[r["shard_depth"], r["shard_prefix"]] += r["n_bytes"]
    assert sum(size.values()) == 10 * 243 + 5000
    assert sorted(size.values())[-1] == 5000 and sorted(size.values())[-2] <= 100  # a text over the limit stands alone


def test_empty(docs_of):
    assert sharding.shard(docs_of([]), 10).collect() == []


def test_directory_covers_every_key_once(spark):
    rows = spark.createDataFrame([(k * 2**40 + k, 1) for k in range(500)] + [(2**62 + 5, 1)] * 40, "key long, size long")
    directory, bits = extendible.build(rows, 16)
    got = rows.withColumn("slot", extendible.prefix(rows.key, bits)).join(directory, "slot").groupBy("depth", "bucket").count().collect()
    assert sum(r["count"] for r in got) == 540
    assert sorted(r["count"] for r in got)[-1] == 40 and sorted(r["count"] for r in got)[-2] <= 16


def test_write(docs_of, tmp_path):
    df = docs_of([(k, "x" * k) for k in range(40)])
    sharding.write_shards(df, sharding.shard(df, 100), str(tmp_path / "out"))
    back = df.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40
