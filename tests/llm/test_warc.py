import base64
import hashlib

import pytest
from pyarrow import fs
from pyspark.sql.types import LongType, StringType, StructField, StructType

from minpairs.llm import warc

SCHEMA = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType()), StructField("sha", LongType())])


def brute(rows, min_bytes=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        keep = max(same, default=None) if len([1 for _, _, g in rows if (g or "") == (h or "")]) > 1 and len(data) >= min_bytes else None
        again = keep is not None and keep != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/x", "<p>one</p>"), (2, "http://a/y\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://ü/ß", ""), (5, "u", "É" * 50_000), (6, "u", "WARC/1.1\r\n\r\nx"),
        (7, "u", "a\r\n\r\nb"), (7, "u", "a\r\n\r\nb"), (None, "u", "<p>one</p>"), (None, "u", "z"), (8, "u", "x" * 300_000)]
ROWS += [(100 + k, f"http://h/{k}", "<html><body>" + " ".join(f"word{(k * j) % 50}" for j in range(60)) + ("" if k % 3 else "hot")) for k in range(60)]
ROWS += [(200 + k, "http://hot", "the same page") for k in range(40)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("min_bytes", "archive_bytes"), [(0, 1 << 20), (20, 2000)])
def test_round_trip(spark, min_bytes, archive_bytes):
    manifest, folder = warc.archive(table(spark, ROWS), min_bytes=min_bytes, archive_bytes=archive_bytes)
    back = warc.read_archives(manifest, folder)
    got = sorted([tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)
    assert got == brute(ROWS, min_bytes)
    html = {r["page_id"]: r["html"] for r in back.where("record_type = 'response'").collect()}
    assert all(html[i] == (h or "") for i, _, h in ROWS if i in html and i is not None)
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS)


def test_archive_layout(spark):
    manifest, folder = warc.archive(table(spark, ROWS))
    store, _ = fs.FileSystem.from_uri(folder)
    import zstandard

    for row in manifest.collect():
        with store.open_input_stream(row["path"], compression=None) as f:
            data = f.read()
        assert len(data) == row["bytes"] and data[:4] == bytes.fromhex("5d2a4d18")
        n = int.from_bytes(data[4:8], "little")
        packer = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + n]))
        rest, records = data[8 + n:], 0
        while rest:  # every record is a frame of its own
            one = packer.decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, records = one.unused_data, records + 1
        assert records == row["records"]


def test_too_few_records_for_a_dictionary(spark):
    rows = [(1, "u", "x")]
    manifest, folder = warc.archive(table(spark, rows))
    assert [r["record_type"] for r in warc.read_archives(manifest, folder).collect()] == ["response"]


def test_empty(spark):
    manifest, folder = warc.archive(table(spark, []))
    assert warc.read_archives(manifest, folder).collect() == []


def test_damage_is_noticed(spark):
    manifest, folder = warc.archive(table(spark, [(1, "u", "payload")]))
    store, _ = fs.FileSystem.from_uri(folder)
    path = manifest.first()["path"]
    import zstandard

    bad = zstandard.ZstdCompressor().compress(warc.record(1, "u", b"payload", None, "d").replace(b"payload\r\n", b"PAYLOAD\r\n"))
    with store.open_output_stream(path, compression=None) as f:
        f.write(bad)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(manifest, folder).collect()
